"""Names: storage paths / file names (S7) and header normalisation over a
column-catalogue table (C12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.functions.text import normalize_header_expr
from scrubspark.operators.stats import qcol
from scrubspark.session import persist_reliably

# --- fixed values -------------------------------------------------------------
DEFAULT_STEM = "dataset"
DEFAULT_FILENAME = "dataset.csv"
# -----------------------------------------------------------------------------

# rows per (name, block) group in the two-level occurrence count
_BLOCK = 1 << 20


def storage_path(u: Column) -> Column:
    """URL -> decoded path without the leading '/'; plain paths -> lstrip('/')."""
    url_path = F.coalesce(F.try_url_decode(F.parse_url(u, F.lit("PATH"))), F.lit(""))
    return F.regexp_replace(F.when(u.rlike(r"^https?://"), url_path).otherwise(u), r"^/+", "")


def filename_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when((name == "") | name.isNull(), F.lit(DEFAULT_FILENAME)).otherwise(name)


def safe_stem(filename: Column) -> Column:
    stem = F.when(filename.contains("."), F.regexp_extract(filename, r"^(.*)\.[^.]*$", 1)).otherwise(filename)
    s = F.lower(F.trim(stem))
    s = F.regexp_replace(s, r"(?U)\s+", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_-]", "")
    return F.when(s == "", F.lit(DEFAULT_STEM)).otherwise(s)


def storage_names(df: DataFrame, col: str) -> DataFrame:
    """Storage path, file name and safe stem of every path or URL."""
    t = df.select(qcol(col).alias("url")).withColumn("storage_path", storage_path(F.col("url")))
    fn = filename_of(F.col("storage_path"))
    return t.select("url", "storage_path", fn.alias("filename"), safe_stem(fn).alias("safe_stem"))


def normalize_header_column(df: DataFrame, name_col: str, order_col: str, within: str | None = None) -> DataFrame:
    """C12 over a catalogue of names: base rule per name, ``_k`` on the k-th
    occurrence of the same base (by ``order_col``), then clashes between names
    are settled in rounds: the earliest row of a name keeps it, the n-th later
    one counts up by n (the rule of ``functions.text.unique_names``).

    ``within`` names the column that tells the tables of a catalogue of many
    tables apart: names are then distinct inside a table, and positions may
    repeat between tables. Without it positions are those of one list.

    The occurrence number is counted in two levels so that a base shared by a
    third of all rows is still split over many tasks: counts per (base, block
    of the order key), a running sum over the blocks, then a row number inside
    each block. The rounds only move rows whose name is taken, so their groups
    are small."""
    pos = qcol(order_col)
    base = normalize_header_expr(qcol(name_col), pos)
    table = qcol(within) if within else F.lit(0)
    t = df.select(table.alias("in"), qcol(name_col).alias("name"), pos.alias("position"), base.alias("base")).withColumn(
        "block", F.floor(F.col("position") / F.lit(_BLOCK))
    )
    blocks = t.groupBy("in", "base", "block").agg(F.count(F.lit(1)).alias("n"))
    wb = Window.partitionBy("in", "base").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("in", "base", "block", F.coalesce(F.sum("n").over(wb), F.lit(0)).alias("offset"))
    wr = Window.partitionBy("in", "base", "block").orderBy("position")
    numbered = t.withColumn("r", F.row_number().over(wr)).join(offsets, ["in", "base", "block"])
    named = numbered.select("in", "position", "name", "base", (F.col("offset") + F.col("r")).cast("long").alias("k"))

    shown = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string")))
    rank = F.row_number().over(Window.partitionBy("in", "normalized").orderBy("position")) - 1
    while True:
        ranked = persist_reliably(named.withColumn("normalized", shown).withColumn("later", rank))
        if not ranked.filter("later > 0").limit(1).count():
            break
        named = ranked.select("in", "position", "name", "base", (F.col("k") + F.col("later")).alias("k"))
    own = [F.col("in").alias(within)] if within else []
    return ranked.select(*own, F.col("position").cast("long").alias("position"), "name", "normalized")
