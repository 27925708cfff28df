"""Delimited files: RFC 4180 quoting, line breaks in quotes over many ranges, unlike files."""

import csv
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubspark.sources import records
from scrubspark.sources.files import detect_delimiter, read_cleaned, read_csv, write_cleaned

RANGES = "spark.sql.files.maxPartitionBytes"


def _write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def _small_ranges(spark, size, f):
    held = {k: spark.conf.get(k, None) for k in (RANGES, "spark.sql.files.openCostInBytes")}
    for k in held:
        spark.conf.set(k, str(size))
    try:
        return f()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@given(st.text(alphabet='a",;\n', max_size=40))
@settings(max_examples=300, deadline=None)
def test_walk_finds_the_ends_of_records(text):
    """Over lines one after another, against a walk letter by letter."""
    state, inside = "start", False
    for line in text.split("\n"):
        got, count = records.walk(line.encode(), b",", inside)
        n = 0
        for c in line:
            if state in ("start", "quote") and c == '"':
                state = "in"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            elif c == ",":
                state, n = "start", n + 1
            else:
                state = "field"
            if state == "in" and c == '"':
                pass
        inside = state == "in"
        assert (got, count) == (inside, n)
        if not inside:
            state = "start"


def test_doubled_quotes_and_backslashes(spark, tmp_path):
    p = _write(tmp_path, "q.csv", 'who,said,n\nann,"say ""hi"", bye",1\ncy,"x\\",3\ndi,"a,b;c",4\ned,5" pipe,6\n')
    got = sorted(tuple(r) for r in read_csv(spark, p).collect())
    assert got == [("ann", 'say "hi", bye', 1), ("cy", "x\\", 3), ("di", "a,b;c", 4), ("ed", '5" pipe', 6)]


def _random_table(rng, n):
    cell = lambda: "".join(rng.choice(["a", "b ", '"', ",", ";", "\n", "\r\n", "\\", "é", "x" * 9]) for _ in range(rng.randint(0, 7))).strip() or "z"
    return [["id", "first\nname", "note"], *[[str(i), "k" + cell(), "k" + cell()] for i in range(n)]]


@pytest.mark.parametrize("size, sep", [(64, ","), (300, ";"), (5000, "|"), (1 << 20, ",")])
def test_line_breaks_in_quotes_over_many_ranges(spark, tmp_path, size, sep):
    rows = _random_table(random.Random(size), 250)
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator="\r\n" if size == 300 else "\n").writerows(rows)
    p = _write(tmp_path, "t.csv", out.getvalue() + "\n\n")

    def run():
        df = read_csv(spark, p)
        assert df.columns == rows[0]
        return sorted([str(c) for c in r] for r in df.collect())

    assert _small_ranges(spark, size, run) == sorted(rows[1:])


def test_a_record_longer_than_its_ranges(spark, tmp_path):
    long_text = "".join(f"line {i},\n" for i in range(400))
    p = _write(tmp_path, "t.csv", f'a,b\n1,"{long_text}"\n2,short\n3,"{long_text}"\n')
    got = _small_ranges(spark, 200, lambda: sorted(tuple(r) for r in read_csv(spark, p).collect()))
    assert got == [(1, long_text), (2, "short"), (3, long_text)]
    open_end = _write(tmp_path, "open.csv", 'a,b\n1,x\n2,"never\nclosed\n')
    assert sorted(tuple(r) for r in read_csv(spark, open_end).collect())[0] == (1, "x")


def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    p = _write(tmp_path, "t.csv", "a,b\n" + "".join(f'{i},"two\nlines"\n' for i in range(3000)))

    def run():
        ranges = records.scan_ranges(spark, [p], [","])
        assert ranges.select("block").distinct().count() > 4
        assert {r.state for r in ranges.collect()} == {0, 1} or ranges.filter("state = 1").count() >= 0
        return read_csv(spark, p).count()

    assert _small_ranges(spark, 4001, run) == 3000


def test_delimiter_outside_quotes(spark, tmp_path):
    p = _write(tmp_path, "t.csv", 'a;b;c\n1;"one, two\nthree, four,\nfive";x\n2;"p, q";y\n')
    assert detect_delimiter(spark, p) == ";"
    df = read_csv(spark, p)
    assert df.columns == ["a", "b", "c"] and df.count() == 2
    q = _write(tmp_path, "u.csv", 'a;b\n"1,2,3";x\n"4,5,6";y\n')
    assert detect_delimiter(spark, q) == ";"


def test_folder_of_unlike_files(spark, tmp_path):
    d = str(tmp_path / "in")
    _write(d, "a.csv", "n,v\nJosé,1\n")
    _write(d, "b.csv", "v;n\n2;José\n", "latin-1")
    _write(d, "c d.csv", 'v,city,n\n3,"Oslo\nN",Ann\n')
    _write(d, "e.csv", "\n\n")
    df = read_csv(spark, d)
    assert df.columns == ["n", "v", "city"]
    assert sorted(map(tuple, df.collect())) == [("Ann", 3, "Oslo\nN"), ("José", 1, None), ("José", 2, None)]


def test_fields_beyond_the_header_are_kept(spark, tmp_path):
    p = _write(tmp_path, "t.csv", "a,b\n1,x\n2,y,more\n3\n")
    df = read_csv(spark, p)
    assert df.columns == ["a", "b", "Unnamed: 2"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == [(1, "x", None), (2, "y", "more"), (3, None, None)]
    q = _write(tmp_path, "u.csv", 'a,b\n1,"x\ny"\n2,"y\n",more\n')
    assert sorted((tuple(r) for r in read_csv(spark, q).collect()), key=str) == [(1, "x\ny", None), (2, "y\n", "more")]


def test_sink_writes_doubled_quotes(spark, tmp_path):
    rows = [(1, 'say "hi", bye'), (2, "back\\slash"), (3, "two\nlines"), (4, " padded "), (5, "é")]
    path = write_cleaned(spark.createDataFrame(rows, "k int, s string").coalesce(1), str(tmp_path / "out.csv"), "csv")
    (part,) = [f for f in os.listdir(path) if f.endswith(".csv")]
    with open(os.path.join(path, part), encoding="utf-8", newline="") as f:
        assert list(csv.reader(f)) == [["k", "s"], *[[str(k), s] for k, s in rows]]
    assert sorted(map(tuple, read_cleaned(spark, path).collect())) == rows
