"""Quality rules with an isolation forest over rule statistics.

``statistics`` gives the rule statistics of every text. Random trees split them at random
values; a document that few splits set apart from the rest (a short mean path) is anomalous.
As in every isolation forest the splits of a tree are drawn for ``TREE_ROWS`` rows of its own:
those of the least hashes among all rows, another hash for each tree. The sizes of its leaves,
which the paths depend on, are then counted over all rows. The score's threshold is calibrated
on all labelled rows: of the thresholds that reject at most ``CLEAN_LOSS`` of the good ones, the
one that parts good from bad best. Equal rows count once; the partitioning changes nothing.
``fit`` takes bounds for callers who want a quick fit; by default, and in the query, there are none.

Null texts are empty; texts without a word have zero for every statistic and fail the
base rules. Without labelled rows of both classes, or if no threshold helps, the forest
rejects nothing. Repeated rows and null ids count as they are; a repeated id in the
labels counts with its lowest quality; other columns are ignored; empty tables give
empty frames. Ties of the score with the threshold are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import small_batches, str_list, word_parts
from scrubspark.session import shared_folder

TREES, TREE_ROWS = 100, 256
CLEAN_LOSS = 0.01
SEED = 11

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
LEAST_WORDS = 50
MOST_REPEATED = (50, 100)  # share of words in repeated windows

STATISTICS = 10
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_upper = re.compile("[A-Z]")
_digit = re.compile("[0-9]")
_stop = re.compile(r"[.!?]")


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; ids: a number for each word."""
    n = len(ids)
    if n < 4:
        return 0
    if n < 1 << 21:
        code = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # three numbers don't fit: number the pairs first
        _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        code = pair[:-1] * n + ids[2:]
    order = np.argsort(code)
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    window = np.zeros(n - 2, bool)
    window[order[1:][same]] = True
    window[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= window
    return int(covered.sum())


def statistics(text: str) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines with a word,
    different words, capitals, digits and sentence ends."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, chain.from_iterable(word_parts(text.encode())), count()), np.int64)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return [
        len(ids),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(seen),
        len(_upper.findall(text)),
        len(_digit.findall(text)),
        len(_stop.findall(text)),
    ]


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that the forest looks at, one row per row of statistics."""
    words, chars, symbols, dup, repeat, lines, different, upper, digit, stop = stats.T.astype(float)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack(
        [np.log1p(words), chars / w, symbols / w, dup / np.maximum(lines, 1), repeat / w, np.log1p(w / np.maximum(different, 1)), upper / c, digit / c, stop / w], axis=1
    )


def base_failed(stats: np.ndarray) -> np.ndarray:
    part, whole = MOST_REPEATED
    return (stats[:, 0] < LEAST_WORDS) | (whole * stats[:, 4] > part * stats[:, 0])


# --- the forest -------------------------------------------------------------


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points in a random tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _path_of_share(n: np.ndarray, most: int) -> np.ndarray:
    """The same for sizes up to ``most`` that need not be whole."""
    whole = np.arange(1, max(most, 1) + 1)
    return np.interp(n, whole, _mean_path(whole))


@dataclass
class Forest:
    """Trees as arrays (tree, node): split feature (-1: leaf), value, children, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    norm: float
    rows: int
    depth: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        return cls.grow([x[rng.choice(len(x), min(rows, len(x)), replace=False)] for _ in range(trees)], seed)

    @classmethod
    def grow(cls, drawn: list[np.ndarray], seed: int = SEED) -> Forest:
        """A tree for each of the drawn sets of rows, all of one size."""
        rng = np.random.default_rng(seed)
        trees, rows = len(drawn), len(drawn[0])
        depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        shape = (trees, 2 ** (depth + 1))
        own = cls(np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape), float(max(_mean_path(rows), 1e-9)), rows, np.zeros(shape, np.int64))
        for t in range(trees):
            todo, used = [(0, drawn[t], 0)], 1
            while todo:
                node, part, at = todo.pop()
                low, high = part.min(0), part.max(0)
                can = np.flatnonzero(high > low)
                if at >= depth or len(part) < 2 or not len(can):
                    own.depth[t, node], own.length[t, node] = at, at + _mean_path(len(part))
                    continue
                f = int(rng.choice(can))
                v = rng.uniform(low[f], high[f])
                left = part[:, f] <= v
                own.feature[t, node], own.value[t, node], own.child[t, node] = f, v, used
                todo += [(used, part[left], at + 1), (used + 1, part[~left], at + 1)]
                used += 2
        return own

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Per tree the leaf of every row."""
        row = np.arange(len(x))
        for feature, value, child in zip(self.feature, self.value, self.child):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, child[node] + (x[row, f] > value[node]), node)
            yield node

    def recount(self, sizes: np.ndarray, total: int) -> Forest:
        """The forest with path lengths by the sizes (tree, node) of its leaves among ``total`` rows."""
        share = sizes * (self.rows / total)
        return replace(self, length=np.where(sizes > 0, self.depth + _path_of_share(share, self.rows), self.length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1; about a half for ordinary points, more for ones easily set apart."""
        total = np.zeros(len(x))
        for node, length in zip(self.leaves(x), self.length):
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def calibrate(score: np.ndarray, good: np.ndarray, clean_loss: float = CLEAN_LOSS) -> float:
    """Threshold that rejects at most ``clean_loss`` of the good rows and, of those, parts best; 2 if none helps."""
    if good.all() or not good.any():
        return 2.0
    order = np.argsort(-score, kind="stable")
    score, good = score[order], good[order]
    lost, caught = np.cumsum(good) / good.sum(), np.cumsum(~good) / (~good).sum()
    ends = np.append(score[1:] != score[:-1], True)  # a threshold takes all equal scores
    gain = np.where(ends & (lost <= clean_loss), caught - lost, 0)
    return float(score[gain.argmax()]) if gain.max() > 0 else 2.0


# --- Spark jobs -------------------------------------------------------------


def _sample(docs: DataFrame, rows: int, extra: list[str]) -> DataFrame:
    """At most ``rows`` different rows (doc_id, extra columns, text): those of the least hashes of id and
    text, so the same whatever the partitioning; equal rows count once, unlike ones of one id
    each. All of them if there are fewer."""
    hashed = docs.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    least = hashed.select("h").distinct().orderBy("h").limit(rows)
    held = hashed.join(F.broadcast(least), "h")  # at most ``rows`` hashes
    return held.groupBy("h").agg(*[F.min(c).alias(c) for c in ["doc_id", *extra, "text"]]).drop("h")


def _thinned_ids(df: DataFrame, rows: int) -> DataFrame:
    """The same for rows of different ids, chosen by a hash of the id."""
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.97 * rows / total))


def _stats_of(docs: DataFrame, extra: list[str]) -> DataFrame:
    """(extra columns, s): the statistics of each row as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([statistics(t) for t in str_list(b.column(len(extra)))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(extra)], s], names=[*extra, "s"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(*extra, "text").mapInArrow(run, f"{kinds + ', ' if kinds else ''}s array<bigint>")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, h, s): a hash of id and text and the statistics of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text").alias("h"), "text")
    return _stats_of(docs, ["doc_id", "h"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def _mixed(h: np.ndarray, tree: int) -> np.ndarray:
    """Another order of the hashes for each tree (one-to-one on 64 bits)."""
    z = h.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)).view(np.int64)


def _drawn(rows: DataFrame, trees: int, size: int) -> DataFrame:
    """(tree, o, s): for each tree the ``size`` rows of the least mixed hashes among all rows (h, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros((0, STATISTICS), np.int64))] * trees
        for b in batches:
            h, s = b.column(0).to_numpy(), _matrix(b.column(1))
            for t, (order, kept) in enumerate(best):
                o = _mixed(h, t)
                if len(order) == size:  # only rows below the last one kept
                    low = o < order[-1]
                    if not low.any():
                        continue
                    o, part = o[low], s[low]
                else:
                    part = s
                o, part = np.concatenate([order, o]), np.concatenate([kept, part])
                by = np.argsort(o, kind="stable")[:size]
                best[t] = o[by], part[by]
        for t, (order, kept) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), t, np.int32)), pa.array(order), pa.array(list(kept), pa.list_(pa.int64()))], names=["tree", "o", "s"])

    least = F.row_number().over(Window.partitionBy("tree").orderBy("o", "s"))
    return rows.select("h", "s").mapInArrow(run, "tree int, o long, s array<bigint>").withColumn("nth", least).filter(F.col("nth") <= size).drop("nth")


def _leaf_sizes(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows (s) in every leaf (tree, node) of the forest."""
    shared, shape = rows.sparkSession.sparkContext.broadcast(forest), forest.feature.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(shape, np.int64)
        for b in batches:
            for t, node in enumerate(shared.value.leaves(features(_matrix(b.column(0))))):
                sizes[t] += np.bincount(node, minlength=shape[1])
        tree, node = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(sizes[tree, node])], names=["tree", "node", "n"])

    found = rows.select("s").mapInArrow(run, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(shape, np.int64)
    for r in found:  # at most the nodes of the forest
        sizes[r.tree, r.node] = r.n
    return sizes


def fit_forest(rows: DataFrame) -> Forest | None:
    """The forest of all different rows (h, s); none if there are no rows."""
    rows = rows.groupBy("h").agg(F.min("s").alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = rows.count()
        if not total:
            return None
        size = min(TREE_ROWS, total)
        drawn: list[list] = [[] for _ in range(TREES)]
        for r in _drawn(rows, TREES, size).collect():  # the rows that the trees are made of, by definition
            drawn[r.tree].append((r.o, r.s))
        forest = Forest.grow([features(np.asarray([s for _, s in sorted(d)])) for d in drawn])
        return forest.recount(_leaf_sizes(rows, forest), total)
    finally:
        rows.unpersist()


def best_threshold(scored: DataFrame, clean_loss: float = CLEAN_LOSS) -> float:
    """``calibrate`` over all rows (score, good): scores are dealt by ranges, whose sums go before them."""
    by = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    by = by.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = sorted((r.part, r.g, r.b) for r in by.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect())  # a row per range
        good, bad = sum(g for _, g, _ in sums), sum(b for _, _, b in sums)
        if not good or not bad:
            return 2.0
        starts, g0, b0 = [], 0, 0
        for part, g, b in sums:
            starts.append((part, g0, b0))
            g0, b0 = g0 + g, b0 + b
        before = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, g0 long, b0 long"))
        w = Window.partitionBy("part").orderBy(F.desc("score"))
        ends = by.join(before, "part").select("score", ((F.col("g0") + F.sum("g").over(w)) / F.lit(good)).alias("lost"), ((F.col("b0") + F.sum("b").over(w)) / F.lit(bad)).alias("caught"))
        gain = F.col("caught") - F.col("lost")
        best = ends.filter(F.col("lost") <= clean_loss).filter(gain > 0).orderBy(gain.desc(), F.desc("score")).first()
        return float(best.score) if best else 2.0
    finally:
        by.unpersist()


def fit_threshold(rows: DataFrame, forest: Forest | None) -> float:
    """The threshold of the score over all different labelled rows (h, quality, s)."""
    if forest is None:
        return 2.0
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, good = _matrix(b.column(1)), b.column(0).to_numpy() > 0
            judged = ~base_failed(stats)  # the forest only speaks where the base rules pass
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(features(stats[judged]))), pa.array(good[judged])], names=["score", "good"])

    rows = rows.groupBy("h").agg(F.min("quality").alias("quality"), F.min("s").alias("s"))
    return best_threshold(rows.select("quality", "s").mapInArrow(run, "score double, good boolean"))


def _known(labels: DataFrame) -> DataFrame:
    return labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))


def fit_measured(rows: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """The forest and the threshold of its score, both over all ``measured`` rows."""
    forest = fit_forest(rows)
    return forest, fit_threshold(rows.join(_known(labels), "doc_id"), forest)


def fit(docs: DataFrame, labels: DataFrame, forest_rows: int | None = None, labelled_rows: int | None = None) -> tuple[Forest | None, float]:
    """The same from documents; over at most so many rows where a bound is given."""
    if forest_rows is None and labelled_rows is None:
        rows = measured(docs).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return fit_measured(rows, labels)
        finally:
            rows.unpersist()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    forest = fit_forest(measured(docs if forest_rows is None else _sample(docs, forest_rows, [])))
    known = _known(labels)
    if labelled_rows is None:
        return forest, fit_threshold(measured(docs.join(known, "doc_id")).join(known, "doc_id"), forest)
    some = _sample(docs.join(_thinned_ids(known, labelled_rows), "doc_id"), labelled_rows, ["quality"])
    return forest, fit_threshold(measured(some).join(known, "doc_id"), forest)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double"


def judge_measured(rows: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """Base statistics, base verdict, forest score and verdict of every ``measured`` row."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            stats = _matrix(b.column(1))
            failed = base_failed(stats)
            score = shared.value.score(features(stats)) if shared.value is not None else np.zeros(len(stats))
            cols = [b.column(0), *[pa.array(c) for c in stats[:, : len(BASE)].T], pa.array(failed), pa.array(~failed & (score < threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    return rows.select("doc_id", "s").mapInArrow(run, SCHEMA)


def judge(docs: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """The same from documents."""
    return judge_measured(measured(docs), forest, threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    at = shared_folder(spark, "op9")  # texts are read once; the statistics are narrow
    measured(docs).write.parquet(at)
    rows = spark.read.parquet(at)
    return judge_measured(rows, *fit_measured(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
