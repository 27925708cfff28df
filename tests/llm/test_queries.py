"""Queries of the training-data operators that SQL can express, against DuckDB."""

import pytest

from scrubspark.llm.queries import ORACLE, QUERIES
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF, duck(SF))
    assert r["status"] == "match", r


def test_one_query_per_operator():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(["pipeline", *(f"op{k}" for k in range(1, 14))])
