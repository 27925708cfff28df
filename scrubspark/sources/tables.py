"""The driver's Parquet tables and the derived ``dirty_orders`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Messy copy of ``orders`` for the cleaning operators: padded and missing text,
# dates as text with failures, prices as currency text, missing numbers, and
# extra copies of some rows (one padded differently, so they only become
# duplicates after the strip). Every orders row is kept; the key arithmetic
# only decides which dirt a row gets. The same text runs in DuckDB.
DIRTY_ORDERS_SQL = """
SELECT * FROM (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING)
              WHEN o_orderkey % 7 = 0 THEN '  ' || o_orderpriority || ' '
              ELSE o_orderpriority END AS priority_text,
         CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS STRING)
              WHEN o_orderkey % 19 = 0 THEN 'unknown date'
              ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
         CASE WHEN o_orderkey % 23 = 0 THEN 'n.a.'
              WHEN o_orderkey % 5 = 0 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || ')'
              ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS price_text,
         CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS price,
         CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS DOUBLE) AS cust_num,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate END AS order_ts
  FROM orders) base
UNION ALL
SELECT o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING) ELSE o_orderpriority || ' ' END,
       CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS STRING)
            WHEN o_orderkey % 19 = 0 THEN 'unknown date'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END,
       CASE WHEN o_orderkey % 23 = 0 THEN 'n.a.'
            WHEN o_orderkey % 5 = 0 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || ')'
            ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END,
       CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END,
       CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS DOUBLE),
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate END
FROM orders WHERE o_orderkey % 37 = 0
"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(DIRTY_ORDERS_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
