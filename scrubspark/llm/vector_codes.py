"""Vector code compression: product codes from an exact integer k-means.

Components become integers, vectors are cut into equal parts, and each part position
has a codebook of a few entries. A part is assigned to its nearest entry by
``|c|^2 - 2 x.c``, the first of the smallest. The dot products run as float64 matrix
products (BLAS) over *limbs*: integers are broken into pieces so short that no sum of
products reaches 2^53, and the pieces' products are put together again in int64. So
every distance, sum and mean is exact, whatever the order in which tasks add up.

Spark scans the vectors once per round. A task adds up counts and sums per (part,
entry) and hands on at most parts x entries rows; their totals are aggregated by Spark
and only the codebooks, whose size does not depend on the input, reach the driver.

Defined results: vectors that are null or hold null or non-finite components are
dropped. Of the others the most frequent length (of equally frequent ones the longest)
is the table's; vectors of another length stay out of the codebooks and come out with
null code and errors. A length that the parts do not divide, and components so large
that a squared distance may pass 64 bits, are errors. Null vec_ids sort after all
others; rows of one vec_id count one by one and start the codebooks in the order of
their vectors. Fewer vectors than entries give smaller codebooks. Null labels are one
label. An empty table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import checkpointed, small_batches

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
EXACT_BITS = 53  # integers up to 2^53 are exact in float64
HOT_SHARE = 1000


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of an int64 array, lowest first: x = sum of limb[k] * 2^(bits k).

    All limbs but the last lie in [0, 2^bits), the last in [-2^bits, 2^bits)."""
    out, rest = [], x
    while True:
        if len(rest.ravel()) == 0 or (rest.min() >= -(1 << bits) and rest.max() < 1 << bits):
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices (stacks of them), exactly where the result fits 64 bits.

    The inner size bounds the limbs: no sum of products of two limbs passes 2^53."""
    inner = a.shape[-1]
    bits = (EXACT_BITS - max(0, inner - 1).bit_length()) // 2
    out = np.zeros((*a.shape[:-1], b.shape[-1]), np.int64)
    left, right = limbs(a, bits), limbs(b, bits)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            shift = bits * (i + j)
            if shift < 64:  # beyond, only multiples of 2^64 are added
                out += (x @ y).astype(np.int64) << shift
    return out


@dataclass
class Codebooks:
    """``entries[p]`` holds the integer entries of part p, in index order."""

    entries: np.ndarray  # (parts, entries, width) int64
    scale: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """(parts, n, width) integer parts of (n, dims) vectors."""
        whole = np.floor(vectors.astype(np.float64) * self.scale).astype(np.int64)
        return whole.reshape(len(vectors), self.entries.shape[0], -1).transpose(1, 0, 2)

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry, each (parts, n); ties to the lower index."""
        far = (self.entries**2).sum(axis=2)[:, None, :] - 2 * exact_products(parts, self.entries.transpose(0, 2, 1))
        index = far.argmin(axis=2)
        least = np.take_along_axis(far, index[:, :, None], axis=2)[:, :, 0]
        return index, least + (parts**2).sum(axis=2)

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(n, dims) integers that (n, parts) indexes stand for."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1)


def _usable(x: Column) -> Column:
    whole = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return F.coalesce(x.isNotNull() & whole, F.lit(False))


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, v): the rows whose vector is not null and holds only finite numbers."""
    name = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), name.alias("label"), F.col(f"`{embedding}`").alias("v"))
    return rows.filter(_usable(F.col("v")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(slot, at, total): per part and entry (slot = part x entries + index) the number of
    parts assigned to it (at 0) and the sums of their components (at 1 and on)."""
    dims, (n_parts, n_entries, width) = books.dims, books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1 + width, n_parts * n_entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = books.cut(_matrix(batch.column(0), dims))
            index, _ = books.assign(parts)
            slot = (index + np.arange(n_parts)[:, None] * n_entries).ravel()
            sums[0] += np.bincount(slot, minlength=sums.shape[1])
            for w in range(width):
                for k, limb in enumerate(limbs(parts[:, :, w].ravel(), 26)):
                    sums[1 + w] += np.bincount(slot, limb, sums.shape[1]).astype(np.int64) << 26 * k
        used = np.flatnonzero(sums[0])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(sums[:, used].T), pa.list_(pa.int64()))], names=["slot", "sums"])

    each = rows.select("v").mapInArrow(run, "slot int, sums array<bigint>").select("slot", F.posexplode("sums").alias("at", "s"))
    return each.groupBy("slot", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("total"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``usable_vectors``; None if there are none.

    Each starts as that part of the vectors of the smallest vec_ids; a round assigns all
    parts and replaces an entry by the floor of its parts' mean; unused entries stay."""
    small_batches(vectors.sparkSession)
    greatest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    about = vectors.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(greatest).alias("most"))
    shape = about.orderBy(F.desc("n"), F.desc("dims")).first()
    if shape is None:
        return None
    dims, most = shape["dims"], int((shape["most"] or 0.0) * scale) + 1
    if dims % parts or not dims:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    if dims * (2 * most) ** 2 >= 1 << 63:
        raise OverflowError("squared distances of these vectors may pass 64 bits")
    rows = vectors.filter(F.size("v") == dims)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = Codebooks(np.zeros((parts, 0, dims // parts), np.int64), scale)
    books.entries = np.ascontiguousarray(books.cut(np.asarray([r["v"] for r in first])))
    for _ in range(rounds):
        new, found = books.entries.copy(), {}
        for r in _totals(rows, books).collect():
            found.setdefault(r["slot"], {})[r["at"]] = int(r["total"])
        for slot, s in found.items():
            new[divmod(slot, new.shape[1])] = [s[1 + w] // s[0] for w in range(new.shape[2])]
        books = Codebooks(new, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of ``usable_vectors``: two hex digits per part, and the
    squared distances to the entries, summed; null for vectors of another length."""
    small_batches(vectors.sparkSession)
    hexes = np.asarray([f"{k:02x}" for k in range(256)])
    if books.entries.shape[1] > len(hexes):
        raise ValueError("two hex digits hold at most 256 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            index, error = books.assign(books.cut(_matrix(batch.column(2), books.dims)))
            codes = ["".join(c) for c in hexes[index.T].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error.sum(axis=0), pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    fit = F.size("v") == books.dims
    coded = vectors.filter(fit).mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")
    rest = vectors.filter(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return coded.unionByName(rest)


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the error summed over equal labels (nulls are equal).

    A label of more than one in HOT_SHARE rows is joined by broadcast, as there are fewer
    than HOT_SHARE of them; the others are joined by shuffle."""
    codes = checkpointed(codes)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = codes.withColumn("key", key)
    sums = rows.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = checkpointed(sums)
    most = codes.count() / HOT_SHARE
    hot, cold = sums.filter(F.col("n") > most).drop("n"), sums.filter(F.col("n") <= most).drop("n")
    hot = F.broadcast(hot)
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key")).drop("key")


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of a table (vec_id, label, code, error) and the codebooks they point into."""
    rows = usable_vectors(vectors, vec_id, embedding, label)
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), None
    return encode(rows, books), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _assignments(books: str) -> str:
    """(vec_id, part, k, far): the nearest entry of every part."""
    return f"""SELECT vec_id, part, arg_min(k, (far, k)) AS k, min(far) AS far FROM (
  SELECT x.vec_id, x.part, c.k, sum((x.v - c.v) * (x.v - c.v)) AS far
  FROM x JOIN {books} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL) GROUP BY ALL"""


def _means(assigned: str, books: str) -> str:
    """The entries after a round: floor of the mean, unused ones as they were."""
    return f"""SELECT c.part, c.k, c.pos, coalesce(m.v, c.v) AS v FROM {books} c LEFT JOIN (
  SELECT a.part, a.k, x.pos, CAST(floor(sum(x.v)::DOUBLE / count(*)) AS BIGINT) AS v
  FROM {assigned} a JOIN x USING (vec_id, part) GROUP BY ALL) m USING (part, k, pos)"""


#: The method in SQL, for tables of unique vec_ids, and of sums below 2^53.
OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (d // {PARTS}) AS part, (i - 1) % (d // {PARTS}) AS pos, CAST(floor({SCALE} * v::DOUBLE) AS BIGINT) AS v
  FROM (SELECT vec_id, len(e) AS d, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, k, pos, v FROM x JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
a0 AS MATERIALIZED ({_assignments("b0")}),
b1 AS MATERIALIZED ({_means("a0", "b0")}),
a1 AS MATERIALIZED ({_assignments("b1")}),
b2 AS MATERIALIZED ({_means("a1", "b1")}),
a2 AS MATERIALIZED ({_assignments("b2")}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, k, pos)) FROM b2) AS codebooks_sha256
FROM kept JOIN coded USING (vec_id)
"""
