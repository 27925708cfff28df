"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause as classes: insult, threat, target,
negation and reported speech. They are composed into one automaton (``compose``); its
state at the end of a clause tells the clause's pattern, for example "two insults, at a
target, not negated, reported". The lexicon's arcs carry weights, a clause's weight is
their sum, and a document is scored by the weights of its clauses for each pattern and
by their density, not by words alone. Clauses without an insult or a threat have no pattern.

Insults are learned: words and word beginnings that labelled toxic documents hold far
more often than chance allows, with the log of how much more often as their weight. Threat, target, negation and reporting words are the
lists below. Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, a
sample of at most ``FIT_ROWS`` (by a hash of the id): one half gives the lexicon, the
other the weights, so that the weights do not trust the lexicon more than it deserves.

Null and empty texts have no clause and get the score of such documents. Without
labelled rows, or with one class only, every score is the share of class 1 (0 without
rows). Labels of a repeated doc_id count as toxic if one is; a null label is none.
Repeated rows, null ids and other columns change nothing; empty tables give empty frames.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import id_remainder, small_batches, str_list

FIT_ROWS = 20_000
MODULUS, HELD_OUT = 5, 0
PREFIXES = (4, 5, 6, 7, 8)  # lengths of word beginnings that may enter the lexicon
LEAST_SHARE = 0.5  # of the documents with an entry that are toxic
MOST_WEIGHT = 6.0  # of an entry; a threat word weighs half as much
EXTRA = 2  # features besides the patterns: total weight and its density
LEXICON_SIZE = 5_000  # most entries, strongest first; bounds what is broadcast

# Fixed word lists (English, German, French, Spanish).
THREAT = "kill hurt destroy shoot stab burn beat murder töten umbringen verletzen sterben tuer frapper mourir matar golpear morir"
TARGET = "you your yours he she they them him her his their du dich dir dein deine ihr euch er sie tu toi ton ta vous il elle ils tú te ti usted ustedes él ella ellos"
NEGATION = "not no never none nobody isn't aren't wasn't don't doesn't nicht nie kein keine niemand ne pas jamais aucun personne nunca jamás nadie tampoco"
REPORT = "said says say told wrote writes claimed claims quoted quote reported called sagte sagt schrieb behauptet dit écrit affirme dijo dice escribió afirma"

OTHER, INSULT, THREATS, TARGETS, NEGATES, REPORTS, QUOTE = range(7)
CLASSES = 7
_word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_token = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
_end = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """A machine over word classes: start state, moves and what a state means at the end."""

    start: int
    moves: dict[tuple[int, int], int]  # (state, class) -> state; a missing move stays
    meaning: tuple[int, ...]  # state -> value in the clause's pattern

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), state)


def _decaying(trigger: int, reach: int) -> Transducer:
    """After ``trigger`` an insult or threat within ``reach`` words moves to the last state for good."""
    caught = reach + 1
    moves = {}
    for s in range(reach + 1):
        for c in range(CLASSES):
            if c == trigger:
                moves[s, c] = reach
            elif c in (INSULT, THREATS) and s:
                moves[s, c] = caught
            else:
                moves[s, c] = max(0, s - 1)
    return Transducer(0, moves, (0,) * (reach + 1) + (1,))


MACHINES = (
    Transducer(0, {(0, INSULT): 1, (1, INSULT): 2}, (0, 1, 2)),  # none, one, more
    Transducer(0, {(0, THREATS): 1}, (0, 1)),
    Transducer(0, {(0, TARGETS): 1}, (0, 1)),
    _decaying(NEGATES, 3),
    Transducer(0, {(0, REPORTS): 1, (0, QUOTE): 1, (1, INSULT): 2, (1, THREATS): 2}, (0, 0, 1)),
)
PATTERNS = {p: i for i, p in enumerate(product(*(range(max(m.meaning) + 1) for m in MACHINES)))}
CONTEXTS = len(PATTERNS) // (max(MACHINES[0].meaning) + 1)  # patterns apart from the number of insults, which comes first


def compose(machines: tuple[Transducer, ...] = MACHINES) -> tuple[list[list[int]], list[int]]:
    """Product automaton of the machines, only states that can be reached: its table
    (state, class) -> state, state 0 first, and the pattern of each state."""
    states = [tuple(m.start for m in machines)]
    known, table = {states[0]: 0}, []
    for state in states:  # grows while it is read
        row = []
        for c in range(CLASSES):
            to = tuple(m.step(s, c) for m, s in zip(machines, state))
            if to not in known:
                known[to] = len(states)
                states.append(to)
            row.append(known[to])
        table.append(row)
    return table, [PATTERNS[tuple(m.meaning[s] for m, s in zip(machines, state))] for state in states]


@dataclass
class Model:
    """Learned entries (a word, or a beginning with a trailing ``*``) with their arc weights, and the weights of the features."""

    entries: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(PATTERNS) + EXTRA))
    bias: float = -math.inf

    def grammar(self) -> Grammar:
        return Grammar(self.entries)


class Grammar:
    """The composed automaton with its lexicons; reads a text and counts clause patterns."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.table, self.pattern = compose()
        self.whole = {e for e in entries if not e.endswith("*")}
        self.begin = {e[:-1]: w for e, w in entries.items() if e.endswith("*")}
        self.classes = {w: (c, MOST_WEIGHT / 2 if c == THREATS else 0.0) for c, ws in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORT)) for w in ws.split()}
        self.classes |= {w: (INSULT, entries[w]) for w in self.whole}
        self.sizes = sorted({len(b) for b in self.begin})
        self.finder = ahocorasick.Automaton()
        for w in {*self.whole, *self.begin, *THREAT.split()}:
            self.finder.add_word(w, len(w))
        if len(self.finder):
            self.finder.make_automaton()

    def arc(self, token: str) -> tuple[int, float]:
        """Class and weight of a word; of several beginnings the heaviest counts."""
        if not token[0].isalpha():
            return QUOTE, 0.0
        weight = max((self.begin.get(token[:n], 0.0) for n in self.sizes), default=0.0)
        return (INSULT, weight) if weight else self.classes.get(token, (OTHER, 0.0))

    def clauses(self, text: str) -> Iterator[str]:
        """Clauses with the letters of a lexicon entry at a word's start, in lower case."""
        low, done = text.lower(), 0
        if not len(self.finder):
            return
        for last, size in self.finder.iter(low):
            at = last - size + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            begin = done
            for m in _end.finditer(low, done, at):
                begin = m.end()
            m = _end.search(low, at)
            done = m.end() if m else len(low)
            yield low[begin:done]

    def patterns(self, text: str) -> dict[int, float]:
        """pattern -> weight of the clauses that hold an insult or a threat. A word weighs once
        in each context (the pattern without its number of insults), so a line that is repeated
        many times says no more than once, but an attack after a quoted or negated word counts.
        A clause without a new word still counts, in full, where its pattern is new."""
        found: dict[int, float] = {}
        heard: set[tuple[str, int]] = set()
        for clause in self.clauses(text):
            state, words = 0, {}
            for token in _token.findall(clause):
                c, w = self.arc(token)
                if w:
                    words[token] = w
                state = self.table[state][c]
            p = self.pattern[state]
            context = p % CONTEXTS
            weight = sum(w for token, w in words.items() if (token, context) not in heard)
            if words and not weight and p not in found:
                weight = sum(words.values())
            heard.update((token, context) for token in words)
            if weight:
                found[p] = found.get(p, 0.0) + weight
        return found

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(PATTERNS) + EXTRA))
        for row, text in zip(out, texts):
            found = self.patterns(text)
            for p, w in found.items():
                row[p] = math.log1p(w)
            if found:
                total = sum(found.values())
                row[-2], row[-1] = math.log1p(total), math.log1p(1000 * total / (text.count(" ") + 20))
        return out


# --- learning ---------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, y, half): a bounded sample of the labelled rows that may be learned from; of
    equal texts one (it is toxic if one of them is), as copies say nothing new."""
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .filter(id_remainder(F.col("doc_id"), MODULUS) != HELD_OUT)
        .withColumn("h", F.xxhash64("doc_id"))
    )
    total = known.count()
    if total > fit_rows:  # by a hash, a little below the bound
        known = known.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * fit_rows * 0.97 / total))
    known = known.select("doc_id", "y", F.pmod(F.shiftright("h", 40), F.lit(2)).cast("int").alias("half"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("text").agg(F.max("y").alias("y"), F.min("half").alias("half"))


def _candidates(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean): documents of the first half that hold the entry, by class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0)]], names=["entry", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(str_list(batch.column(0)), batch.column(1).to_pylist()):
                seen[int(y > 0)].update(_candidates({w for w in _word.findall(text.lower()) if len(w) > 2}))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield from out()
                    seen[0].clear(), seen[1].clear()
        yield from out()

    partial = sample.filter("half = 0").select("text", "y").mapInArrow(count, "entry string, toxic long, clean long")
    return partial.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Entries that toxic documents hold more often than chance allows for any entry tried."""
    base = toxic / (toxic + clean)
    counts = _entry_counts(sample).filter(F.col("toxic") >= 3)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    p = F.least(share, F.lit(1 - 1e-9))
    # n times the divergence of the share from the base rate: minus the log of a bound on the chance
    strength = (F.col("toxic") + F.col("clean")) * (p * F.log(p / base) + (1 - p) * F.log((1 - p) / (1 - base)))
    lift = F.log((F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / (clean + 1)))
    scored = counts.select("entry", share.alias("share"), strength.alias("strength"), F.least(lift, F.lit(MOST_WEIGHT)).alias("weight")).persist()
    tried = scored.count()
    rows = scored.filter((F.col("share") >= LEAST_SHARE) & (F.col("weight") > 0) & (F.col("strength") > math.log(100 * max(1, tried)))).orderBy(F.desc("strength"), "entry").limit(LEXICON_SIZE).collect()
    scored.unpersist()
    kept: dict[str, float] = {}  # strongest first; of entries on one path only the first
    begins: set[str] = set()  # beginnings of kept entries of every length
    for r in rows:
        name = r.entry.rstrip("*")
        above = any(name[:n] + "*" in kept for n in PREFIXES if n <= len(name))
        if not above and name not in kept and not (r.entry.endswith("*") and name in begins):
            kept[r.entry] = r.weight
            begins |= {name[:n] for n in range(1, len(name) + 1)}
    return kept


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn the lexicon and the pattern weights from the labelled rows."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, fit_rows).persist()
    try:
        return _fit(sample)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame) -> Model:
    sizes = {(r.half, r.y > 0): r.n for r in sample.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sizes.get((0, True), 0), sizes.get((0, False), 0))
    ones, zeros = toxic + sizes.get((1, True), 0), clean + sizes.get((1, False), 0)
    if not ones or not zeros:
        return Model({}, bias=math.inf if ones else -math.inf)
    entries = _lexicon(sample, toxic, clean) if toxic and clean else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(entries)
        for batch in batches:
            x = grammar.features(str_list(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # equal rows are counted: the other half's features are few different vectors
    rows = sample.filter("half = 1").select("text", "y").mapInArrow(read, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if not {r.y > 0 for r in rows} == {True, False}:
        return Model(entries, bias=math.log(ones / zeros))
    rows = sorted(rows, key=lambda r: (r.x, r.y))
    x, y, n = np.asarray([r.x for r in rows]), np.asarray([float(r.y > 0) for r in rows]), np.asarray([float(r.n) for r in rows])
    weights, bias = _logistic(x, y, n)
    return Model(entries, weights.tolist(), bias)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge on the weights, by Newton's steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (p - y)) + penalty * w
        step = np.linalg.solve(z.T @ (z * (n * p * (1 - p))[:, None]) + np.diag(penalty), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


# --- scoring ----------------------------------------------------------------


class _Scorer:
    def __init__(self, model: Model):
        self.grammar, self.weights, self.bias = model.grammar(), np.asarray(model.weights), model.bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        z = np.clip(self.grammar.features(str_list(texts)) @ self.weights + np.clip(self.bias, -700, 700), -700, 700)
        return np.where(self.bias == -math.inf, 0.0, np.where(self.bias == math.inf, 1.0, 1 / (1 + np.exp(-z))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1)))], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; learned from ``docs`` and ``labels``."""
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
