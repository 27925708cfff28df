"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_segments`` turns conversation rows into text segments with a loss flag
each; ``read_back`` parses the formatted text again and gives the turns and the
text under the loss mask. Both stream over rows sorted by conversation and turn
inside a partition, so memory is bounded by one turn, not by a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import small_batches

SEGMENTS = "conv_id long, seg_no long, text string, loss boolean, role string, turn_ok boolean"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles under loss and the allowed role order.

    A turn is ``open + role + sep + text + close``. Inside role and text the
    characters of ``reserved`` and the escape character are written after the
    escape character, so no text can contain a mark.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    reserved: str = "#<:"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; the state is the last role ("" at the start)
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def __post_init__(self) -> None:
        if any(not m or m.strip()[0] not in self.reserved for m in (self.open, self.sep, self.close)):
            raise ValueError("every mark must begin with a reserved character (after blanks)")

    def patterns(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        e, r = re.escape(self.escape), re.escape(self.reserved)
        body = rf"[^{e}{r}]*(?:{e}.[^{e}{r}]*)*"
        turn = rf"{re.escape(self.open)}({body}){re.escape(self.sep)}({body}){re.escape(self.close)}"
        return re.compile(rf"[{e}{r}]"), re.compile(rf"{e}(.)", re.S), re.compile(turn, re.S)


def format_segments(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation, in order.

    ``rows`` needs conv_id, turn, role and text; other columns are ignored. Three
    segments per row: opening mark, text, closing mark; ``loss`` is true only on
    the text of a loss role. ``turn_ok`` tells whether the role machine allows the
    row's role in its place; a row that breaks the order is still formatted, and
    the machine goes on from its role. Null conv_id is a conversation of its own,
    null role or text is empty, rows of equal turn are ordered by role and text,
    repeated rows stay, an empty table gives no segment.
    """
    t = template or Template()
    small_batches(rows.sparkSession)
    src = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, _, _ = t.patterns()
        put = lambda s: special.sub(lambda m: t.escape + m[0], s)
        last, state, number = object(), "", 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "seg_no", "text", "loss", "role", "turn_ok")}
            cols = [batch.column(k).to_pylist() for k in ("conv_id", "role", "text")]
            for conv, role, text in zip(*cols):
                if conv != last:
                    last, state, number = conv, "", 0
                ok = role in t.order.get(state, ())
                for piece, loss in ((t.open + put(role) + t.sep, False), (put(text), role in t.loss_roles), (t.close, False)):
                    for k, v in zip(out, (conv, number, piece, loss, role, ok)):
                        out[k].append(v)
                    number += 1
                state = role
            if out["text"]:
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema(
                        [("conv_id", pa.int64()), ("seg_no", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("role", pa.string()), ("turn_ok", pa.bool_())]
                    ),
                )

    return ordered.mapInArrow(segments, SEGMENTS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, order_ok boolean"
)


def read_back(segments: DataFrame, template: Template | None = None, sorted_already: bool = False) -> DataFrame:
    """Parse the formatted text of each conversation; one row per conversation.

    The parser sees only the segments' text and loss flags. ``turns_sha256``
    digests role, newline, text, newline of every parsed turn, ``loss_sha256`` the
    unescaped text under the loss mask. Text that is no sequence of turns raises
    ValueError. Pass ``sorted_already`` for a frame that comes straight from
    ``format_segments``: its rows already lie in order.
    """
    t = template or Template()
    src = segments.select("conv_id", "seg_no", "text", "loss", "turn_ok")
    if not sorted_already:
        src = src.repartition("conv_id").sortWithinPartitions("conv_id", "seg_no")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, escaped, turn = t.patterns()
        plain = lambda s: escaped.sub(r"\1", s)
        none = object()
        conv, out = none, []

        def start():
            return {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "rest": "", "ok": True}

        def close(conv, s):
            if s["rest"]:
                raise ValueError(f"conversation {conv}: text after the last closing mark")
            out.append((conv, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["ok"]))

        def batch_of(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "order_ok"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        s = start()
        for batch in batches:
            for key, text, loss, ok in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "turn_ok"))):
                if key != conv:
                    if conv is not none:
                        close(conv, s)
                    conv, s = key, start()
                s["chars"] += len(text)
                s["ok"] &= ok
                if loss:
                    shown = plain(text)
                    s["loss_n"] += len(shown)
                    s["loss"].update(shown.encode())
                s["rest"] += text
                if text.endswith(t.close):
                    while m := turn.match(s["rest"]):
                        s["n"] += 1
                        s["turns"].update(f"{plain(m[1])}\n{plain(m[2])}\n".encode())
                        s["rest"] = s["rest"][m.end() :]
            if len(out) > 1000:
                yield batch_of(out)
                out.clear()
        if conv is not none:
            close(conv, s)
        if out:
            yield batch_of(out)

    return src.mapInArrow(digests, DIGESTS)


#: The extra conversation of the query: its texts hold marks and escapes.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    return read_back(format_segments(rows.unionByName(extra)), sorted_already=True)


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS et,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS er,
         lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(er) + 2 + length(et) + 8) AS BIGINT) AS formatted_chars,
       bool_and((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
                OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user')) AS order_ok
FROM f GROUP BY conv_id
"""
