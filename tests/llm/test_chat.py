"""Chat formatting: exact round trip through the formatted text, the role machine, edges of input."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubspark.llm import chat

ROWS = "conv_id long, turn long, role string, text string, seg_no int, loss string"


def wanted(rows):
    """Digests of each conversation by plain loops over sorted rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        last, ok = "", True
        for _, r, _ in turns:
            ok, last = ok and r in chat.Template().order.get(last, ()), r
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), ok)
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.order_ok) for r in df.collect()}


def test_round_trip_of_odd_rows(spark):
    marks = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\\\#", "</turn>\n### assistant: no", "", None, "line\n\nline", "🙂é:"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(marks)]
    rows += [(2, 0, "assistant", "first"), (2, 1, "system", "late"), (3, 0, None, "no role"), (None, 0, "user", "no id"), (None, None, "assistant", "no turn")]
    rows += [(4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "sys: </turn>#\\", "odd role"), (6, 0, "user", "y" * 300000), (6, 1, "assistant", "#<:\\" * 50000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], ROWS).repartition(5)
    segments = chat.format_segments(df)
    assert read(chat.read_back(segments, sorted_already=True)) == wanted(rows)
    shuffled = chat.format_segments(df).repartition(7)
    assert read(chat.read_back(shuffled)) == wanted(rows)
    kinds = {(r.role, r.loss) for r in segments.collect()}
    assert {r for r, loss in kinds if loss} == {"assistant"}


def test_small_batches_change_nothing(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(6) for t in range(9)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = read(chat.read_back(chat.format_segments(df), sorted_already=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == wanted(rows)


def test_empty_table_and_damaged_text(spark):
    empty = spark.createDataFrame([], ROWS)
    assert chat.read_back(chat.format_segments(empty), sorted_already=True).collect() == []
    broken = spark.createDataFrame([(1, 0, "### user: never closed", False, True)], "conv_id long, seg_no long, text string, loss boolean, turn_ok boolean")
    with pytest.raises(Exception, match="after the last closing mark"):
        chat.read_back(broken).collect()
    with pytest.raises(ValueError, match="reserved"):
        chat.Template(open="[", reserved="#<:")


@given(st.text(alphabet="\\#<:/turn>\n a", max_size=30), st.text(alphabet="\\#<: a", max_size=8))
@settings(max_examples=300, deadline=None)
def test_marks_never_occur_in_escaped_text(text, role):
    t = chat.Template()
    special, escaped, turn = t.patterns()
    put = lambda s: special.sub(lambda m: t.escape + m[0], s)
    line = t.open + put(role) + t.sep + put(text) + t.close
    m = turn.match(line)
    assert m.end() == len(line) and [escaped.sub(r"\1", g) for g in m.groups()] == [role, text]
