import os
import tempfile

import pytest

from pyspark.sql import functions as F

from scrubspark.operators import history
from scrubspark.streaming import stream_reports


def test_append_list_fetch_isolation(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="scrubspark-hist-"), "reports")
    rows = [
        ("c1", "cleaned/a_1.csv", '{"executive_summary": "s1", "data_quality_assessment": {"score": 81}}', '{"dataset_overview": {"total_rows": 10}}'),
        ("c2", "cleaned/b_2.csv", '{"executive_summary": "s2"}', "{}"),
    ]
    df = spark.createDataFrame(rows, "client_id string, dataset_path string, ai_report string, analysis_results string")
    history.append_reports(df, d)
    rep = history.read_reports(spark, d)
    got = history.list_reports(rep, "c1").collect()
    assert len(got) == 1 and got[0]["data_quality_score"] == 81 and got[0]["row_count"] == 10
    assert got[0]["filename"] == "a_1.csv"
    rid = got[0]["id"]
    assert history.fetch_report(rep, rid, "c1").count() == 1
    assert history.fetch_report(rep, rid, "c2").count() == 0
    assert history.list_reports(rep, None).count() == 0
    # a client's rows come from its bucket alone
    own = history.read_reports(spark, d, "c1")
    assert [r.id for r in own.collect()] == [rid]
    assert {os.path.basename(os.path.dirname(f)) for f in own.inputFiles() if "/rows/" in f} == {
        f"bucket={spark.range(1).select(history._bucket(F.lit('c1'))).first()[0]}"
    }
    assert history.read_reports(spark, d, "nobody").count() == 0


REPORT = "client_id string, dataset_path string, ai_report string, analysis_results string"


def test_repeated_batch_is_stored_once(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="scrubspark-hist-"), "reports")
    rows = spark.createDataFrame([("c1", "a.csv", "{}", "{}"), ("c2", None, None, "{}")], REPORT)
    history.append_reports(rows, d, batch="b1")
    history.append_reports(rows.limit(2), d, batch="b1")
    first = {r.id for r in history.read_reports(spark, d).collect()}
    assert len(first) == 2 and history.read_reports(spark, d).count() == 2
    history.append_reports(rows, d, batch="b2")
    history.append_reports(rows, d)
    got = history.read_reports(spark, d)
    assert got.count() == 6 and len({r.id for r in got.collect()} - first) == 4
    assert first < {r.id for r in got.collect()}


def test_equal_rows_empty_clients_and_nulls_keep_apart(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="scrubspark-hist-"), "reports")
    rows = [("c1", "a.csv", "{}", "{}")] * 3 + [("", "a.csv", "{}", "{}"), (None, "a.csv", "{}", "{}"), ("c1", None, "{}", "{}"), ("c1", "", "{}", "{}")]
    history.append_reports(spark.createDataFrame(rows, REPORT), d, "b")
    got = history.read_reports(spark, d).collect()
    assert sorted([(r.client_id, r.dataset_path) for r in got], key=str) == sorted([r[:2] for r in rows], key=str)
    assert len({r.id for r in got}) == len(rows)
    history.append_reports(spark.createDataFrame([], REPORT), d, "none")
    assert history.read_reports(spark, d).count() == len(rows)
    assert history.read_reports(spark, d, "").count() == 1


def test_compaction_joins_files_and_keeps_batches(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="scrubspark-hist-"), "reports")
    rows = spark.createDataFrame([(f"c{i}", f"{i}.csv", "{}", "{}") for i in range(3)], REPORT)

    def files(kind):
        return [f for top, _, names in os.walk(os.path.join(d, kind)) for f in names if f.endswith(".parquet")]

    for batch in ("b1", None, None, "b1"):
        history.append_reports(rows, d, batch)
    # an append without its commit is not seen, and a compaction leaves it
    lost = rows.selectExpr("'x' AS id", "current_timestamp() AS created_at", "*", "'b9' AS batch", "'lost' AS attempt")
    history._store(lost.select(*history.REPORT_COLUMNS, "batch", "attempt"), d)
    before = sorted(tuple(r) for r in history.read_reports(spark, d).collect())
    assert len(before) == 9 and len(files("commits")) == 4
    n = len(files("rows"))
    replaced = history.compact_reports(spark, d)
    assert sorted(tuple(r) for r in history.read_reports(spark, d).collect()) == before
    history.drop_files(spark, replaced)
    assert sorted(tuple(r) for r in history.read_reports(spark, d).collect()) == before
    buckets = len(os.listdir(os.path.join(d, "rows"))) - 2  # marker files apart
    assert len(files("commits")) == 1 and len(files("rows")) <= 2 * buckets < n
    history.append_reports(rows.limit(1), d, "b1")
    again = history.read_reports(spark, d).collect()
    assert len(again) == 7 and len({r.id for r in again} - {r[0] for r in before}) == 0


def test_stream_goes_on_in_a_later_session(spark):
    top = tempfile.mkdtemp(prefix="scrubspark-stream-")
    source, path = os.path.join(top, "in"), os.path.join(top, "reports")
    os.makedirs(source)

    def add(name):
        with open(os.path.join(source, name), "w") as f:
            f.write('{"client_id": "c1", "dataset_path": "%s", "ai_report": "{}", "analysis_results": "{}"}\n' % name)

    def run(session):
        q = stream_reports(session, source, path, checkpoint=os.path.join(top, "progress"), once=True)
        q.awaitTermination()

    add("a.json")
    run(spark)
    run(spark.newSession())
    assert history.read_reports(spark, path).count() == 1
    add("b.json")
    run(spark.newSession())
    assert sorted(r.dataset_path for r in history.read_reports(spark, path).collect()) == ["a.json", "b.json"]
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="progress folder"):
            stream_reports(spark, source, path)
