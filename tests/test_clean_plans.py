"""Cleaning: equal rows found in two phases, date formats tried by the shapes that occur."""

import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from scrubspark.functions.dates import DATE_FORMATS, DATE_SHAPES, formats_of_shapes, parse_date
from scrubspark.functions.text import DATE_HINT_PATTERN, coerce_numeric_text, date_hint, reads_as_number, strip_text
from scrubspark.operators import dedup
from scrubspark.operators.clean import clean
from scrubspark.operators.detect import detect_dates

ROWS = "a string, b double, c array<int>, keep boolean"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(5)


CASES = [("x", 1.0, [1], True), ("x", 1.0, [1], False), ("y", None, None, True), (None, 0.0, [], True), (None, -0.0, [], True),
         ("z", float("nan"), [2], False), ("z", float("nan"), [2], True), ("", 1.0, [1], True), (None, None, None, False), (None, None, None, False)]
CASES += [(f"u{i}", float(i), [i], i % 2 == 0) for i in range(200)] + [("hot", 5.0, [7], True)] * 300


@pytest.mark.parametrize("bits", [dedup.FILTER_BITS, 7])  # two words: unlike rows share bits
@pytest.mark.parametrize("checkpoint", [False, True])
def test_groups_equal_rows(spark, bits, checkpoint):
    got = dedup.group_equal(rows_of(spark, CASES), ["a", "b", "c"], "keep", checkpoint, bits)
    key = lambda a, b, c: (a, str(b + 0.0) if b is not None else None, str(c))
    n, same = Counter(key(*r[:3]) for r in CASES), Counter(key(*r[:3]) for r in CASES if r[3])
    found = {key(r.a, r.b, r.c): (r["__n"], r["__same"]) for r in got.frame.collect()}
    assert found == {k: (n[k], same[k]) for k in n} and got.frame.count() == len(n)
    for d in got.persisted:
        d.unpersist()


def test_only_possible_repeats_are_shuffled(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("wide"), F.lit(True).alias("keep"))
    rows = rows.unionAll(rows.where("k < 200"))
    got = dedup.group_equal(rows, ["k", "wide"], "keep")
    assert got.frame.count() == 20000
    assert got.groups.count() <= 210 and got.alone.count() >= 19790  # 200 pairs and few shared bits
    # whole rows meet no exchange on the way to the unique part; only hashes do
    plan = dedup.mark_repeats(rows, ["k", "wide"])._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning\([^)]*\))", plan)
    assert dealt and not [d for d in dealt if "wide" in d or "k#" in d], dealt
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    for d in got.persisted:
        d.unpersist()


def test_empty_and_unlike_types(spark):
    assert dedup.group_equal(rows_of(spark, []), ["a", "b", "c"], "keep").frame.count() == 0
    odd = spark.sql("SELECT map('k', id % 2) AS m, struct(id % 2 AS x) AS s, ' t ' AS t, cast(id % 2 AS decimal(38, 0)) AS d FROM range(10)")
    res = clean(odd)
    assert res.plan.rows_after == 2 and res.plan.raw_duplicate_rows == 8
    assert sorted(r.m["k"] for r in res.table.collect()) == [0, 1]
    res.close()


# one text of every format
PARTS = {"'T'": "T", "[.SSSSSSSSS]": ".25", "SSSSSSSSS": "250", "XXX": "+02:00", "MMMM": "March", "MMM": "Mar", "M": "3", "yyyy": "2024", "yy": "24", "H": "7", "m": "8", "s": "9", "d": "5"}
SAMPLE = {fmt: re.sub("|".join(map(re.escape, PARTS)), lambda m: PARTS[m[0]], fmt) for fmt in DATE_FORMATS}


def test_shapes_keep_every_format_that_parses(spark):
    fold = lambda t: re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", t))
    for fmt, text in SAMPLE.items():
        assert re.fullmatch(DATE_SHAPES[fmt], text), (fmt, text)
        live = formats_of_shapes([fold(text)], DATE_FORMATS)
        parses = spark.range(1).select(*[parse_date(F.lit(text), f).alias(str(i)) for i, f in enumerate(DATE_FORMATS)]).first()
        assert {f for i, f in enumerate(DATE_FORMATS) if parses[i] is not None} <= set(live), (fmt, live)
        assert fmt in live and len(live) <= 4


def test_detected_formats(spark):
    shapes = list(SAMPLE)
    df = spark.range(40).select(*[F.lit(SAMPLE[f]).alias(f"c{i}") for i, f in enumerate(shapes)], F.lit(None).cast("string").alias("none"), F.lit("on 2024-03-05 we met").alias("prose"))
    got = detect_dates(df, df.columns)
    first = {i: next(f for f in shapes if parse_ok(spark, SAMPLE[shapes[i]], f)) for i in range(len(shapes)) if f"c{i}" in got}
    assert got == {f"c{i}": f for i, f in first.items()}
    assert len(got) >= 20 and not {"none", "prose"} & set(got)


def parse_ok(spark, text, fmt):
    return spark.range(1).select(parse_date(F.lit(text), fmt)).first()[0] is not None


def test_raw_rows_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(3000).selectExpr("id % 1000 AS k", "if(id % 5 = 0, concat(' ', id % 9), 'x') AS t", "if(id % 7 = 0, null, id / 4) AS v")
    res = clean(rows.mapInArrow(count, rows.schema))
    assert res.plan.rows_before == 3000 and seen.value == 3000
    res.close()


def test_rows_of_one_file_keep_all_cores(spark, tmp_path):
    rows = spark.range(40000).selectExpr("id AS k", "concat('$', id, '.5') AS price", "if(id % 3 = 0, null, cast(id AS double)) AS v")
    rows.coalesce(1).write.parquet(f"{tmp_path}/t")
    res = clean(spark.read.parquet(f"{tmp_path}/t"))
    sizes = [r["count"] for r in res.table.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40000 and len(sizes) >= 4 and max(sizes) <= 20000
    # counted without the conversion, but of the converted cells
    by = {d.name: (d.conversion, d.nulls_filled) for d in res.plan.columns}
    assert by == {"k": (None, 0), "price": ("numeric", 0), "v": (None, 13334)}
    res.close()


def test_counts_of_missing_cells_are_those_of_the_converted_rows(spark):
    rows = [(None if i % 10 == 0 else "n.a." if i % 10 == 1 else f"({i})", None if i % 4 == 0 else f"t{i}", float("nan") if i % 5 == 0 else 1.0 * i, "2024-01-05" if i % 6 else "?") for i in range(300)]
    res = clean(spark.createDataFrame(rows, "n string, t string, f double, d string"))
    got = {d.name: (d.conversion, d.nulls_filled) for d in res.plan.columns}
    held = res.converted.collect()
    assert got["n"] == ("numeric", sum(x.n is None for x in held)) and got["n"][1] > 30
    assert got["t"] == (None, sum(x.t is None for x in held)) and got["f"] == (None, sum(x.f != x.f for x in held))
    assert got["d"] == ("datetime", 0)
    res.close()


def test_text_expressions_keep_their_results(spark):
    """Against the plain regular expressions."""
    rng, blanks = random.Random(4), "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    near = "\x1c\x1f\u200b\u180e\ufeff"
    texts = [None, "", *(chr(i) + "a" + chr(i) for i in range(0x20, 0x3100))]
    for letters, n in ((blanks + near + "ab", 1500), ("0159.+-eE()$,% \n\xa0", 6000), ("12-/. JanMAYsept," + "\xa0", 4000), ("()5$\u2028 .", 1500)):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(n)]
    texts += ["2024-01-05", " 1/2/24 ", "5 may 2024", "Sept-3, 99", "(1,234.50)", "€ 12", "-(5)", "(-5)", "1e999", "1d", "NaN", "(1\n2)", "٣", "9" * 20000, "jan" + " " * 3000 + "5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4).cache()
    t = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    n = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)$", "-$1"), r"(?U)[\$€£¥,%\s]", "")
    number = F.when(n.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), n.try_cast("double"))
    pairs = {"strip": (strip_text("t"), t), "number": (coerce_numeric_text("t"), number), "hint": (date_hint("t"), t.rlike("(?i)" + DATE_HINT_PATTERN)), "is": (reads_as_number(F.col("t")), F.when(F.col("t").isNotNull(), number.isNotNull()))}
    for name, (new, old) in pairs.items():
        got = df.select("t", new.alias("new"), old.alias("old"))
        assert got.where("NOT new <=> old").limit(3).collect() == [], name
        if name == "number":  # zeros keep their sign
            assert got.where("CAST(new AS STRING) <> CAST(old AS STRING)").count() == 0 and got.where("new IS NOT NULL").count() > 300
