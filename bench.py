"""Bench: headline cleaning / profiling / analysis jobs over whole tables.

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scrubspark.operators import charts, quality  # noqa: E402
from scrubspark.operators.analyze import Analysis  # noqa: E402
from scrubspark.operators.clean import clean  # noqa: E402
from scrubspark.operators.profile import profile  # noqa: E402
from scrubspark.queries import QUERIES  # noqa: E402
from scrubspark.session import get_spark, shared_folder  # noqa: E402
from scrubspark.sources.files import cleaned_path, read_csv, write_cleaned  # noqa: E402
from scrubspark.sources.tables import dirty_orders, table  # noqa: E402


def _drain(df) -> int:
    return len(df.collect())


def run_clean(spark, sf):
    res = clean(dirty_orders(spark, sf))
    res.table.write.format("noop").mode("overwrite").save()
    for f in res.report().values():
        _drain(f)
    res.close()


def run_analysis(spark, sf, name):
    a = Analysis(table(spark, sf, name))
    for f in (
        a.overview(),
        a.describe_numeric(),
        a.category_top(),
        a.cardinality(),
        a.correlation_matrix(),
        a.correlation_top(),
        a.shape_class(),
        a.outlier_ranking(),
        a.monthly_mean(),
        a.trend(),
    ):
        _drain(f)
    for f in charts.chart_frames(a).values():
        _drain(f)
    a.close()


def run_profile(spark, sf, name):
    profile(table(spark, sf, name), exact=True)


def run_csv(spark, sf):
    """Write ``lineitem`` as delimited text once, then read, type and drain it."""
    path = write_cleaned(table(spark, sf, "lineitem"), cleaned_path(shared_folder(spark, "bench"), "lineitem.csv", "csv"), "csv")
    read_csv(spark, path).write.format("noop").mode("overwrite").save()


def run_report(spark, sf):
    """Quality score, fact lines and context of the cleaned orders."""
    res = clean(dirty_orders(spark, sf))
    a = Analysis(res.table)
    _drain(quality.quality_score(res, a))
    _drain(quality.report_context(a, res))
    a.close()
    res.close()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    # warm-up: JVM, parquet footers and codegen caches
    table(spark, sf, "region").count()

    jobs = {
        "clean_dirty_orders": lambda: run_clean(spark, sf),
        "analyze_lineitem": lambda: run_analysis(spark, sf, "lineitem"),
        "analyze_orders": lambda: run_analysis(spark, sf, "orders"),
        "profile_lineitem": lambda: run_profile(spark, sf, "lineitem"),
        "analyze_events": lambda: run_analysis(spark, sf, "events"),
        "csv_read_lineitem": lambda: run_csv(spark, sf),
        "score_and_report": lambda: run_report(spark, sf),
        "normalize_headers": lambda: _drain(QUERIES["normalize_headers"](spark, sf)),
        "storage_names": lambda: _drain(QUERIES["storage_names"](spark, sf)),
        "lenient_json": lambda: _drain(QUERIES["lenient_json"](spark, sf)),
    }
    times = {}
    for name, fn in jobs.items():
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "clean_profile_analyze_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf_name) if sf_name.replace(".", "").isdigit() else sf_name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
