"""Vector codes: exact products and codebooks against Python integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubspark.llm import vector_codes


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector, label) of one length; codes, errors and the codebook digest."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, v, _ in kept:
            for p in range(parts):
                held[p][near(v, p)[1]].append(cut(v, p))
        books = [[tuple(sum(c) // len(own) for c in zip(*own)) if own else old for own, old in zip(held[p], books[p])] for p in range(parts)]
    out, totals = [], {}
    for i, v, lab in kept:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        totals[lab] = totals.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, c, e, totals[lab], digest) for i, c, e, lab in out]


def result(frame, **kw):
    codes, books = vector_codes.compress(frame, **kw)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, books.sha256()) for r in vector_codes.with_label_error(codes).collect()), key=str)


big = st.integers(-(1 << 29), 1 << 29)


@given(st.lists(st.lists(big, min_size=5, max_size=5), min_size=1, max_size=6), st.lists(st.lists(big, min_size=5, max_size=5), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_limb_products_are_exact(a, b):
    got = vector_codes.exact_products(np.asarray(a, np.int64), np.asarray(b, np.int64).T)
    assert got.tolist() == [[sum(x * y for x, y in zip(r, s)) for s in b] for r in a]


@given(st.lists(st.integers(-(1 << 62), 1 << 62), max_size=9), st.integers(3, 26))
def test_limbs_add_up(xs, bits):
    x = np.asarray(xs, np.int64)
    pieces = vector_codes.limbs(x, bits)
    assert [sum(int(p[k]) << bits * i for i, p in enumerate(pieces)) for k in range(len(xs))] == xs
    assert all(abs(v) <= 1 << bits for p in pieces for v in p.tolist())


@pytest.mark.parametrize("spread", [0.3, 900.0, 100_000.0])
def test_against_plain_integers(spark, spread):
    rng = np.random.default_rng(int(spread))
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, 32)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [(1000 + k, rows[k][1], 1) for k in range(60)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(plain_codes(rows), key=str)
    assert result(frame.repartition(7)) == want == result(frame.coalesce(1))


def test_edges_of_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k % 7), -0.5, 1e-9, -1e-9], k % 2) for k in range(20)]
    odd = [(50, None, 1), (51, [1.0, None, 2.0, 3.0], 1), (52, [nan, 1.0, 1.0, 1.0], 1), (53, [1.0, -inf, 0.0, 0.0], 1)]
    odd_ids = [(None, [0.25] * 4, None), (None, [0.5] * 4, None), (3, [9.0] * 4, 0)]
    schema = "vec_id long, embedding array<float>, label int"
    kw = {"parts": 2, "entries": 64}
    frame = spark.createDataFrame(rows + odd + odd_ids, schema).withColumn("v", F.lit("v")).withColumn("code", F.lit(1))
    assert result(frame, **kw) == sorted(plain_codes(rows + odd_ids, 2, 64), key=str)
    # another length: no part in the codebooks, null code
    other = spark.createDataFrame([*rows, (60, [1.0], 7), (61, [], 7)], schema)
    got = result(other, **kw)
    want = plain_codes(rows, 2, 64)
    assert got == sorted([*want, (60, None, None, None, want[0][4]), (61, None, None, None, want[0][4])], key=str)
    empty, books = vector_codes.compress(frame.limit(0))
    assert books is None and vector_codes.with_label_error(empty).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(frame, parts=3)
    with pytest.raises(OverflowError):
        vector_codes.compress(spark.createDataFrame([(1, [3e30] * 4, 1)], schema), parts=2)


def test_hot_label_goes_by_broadcast(spark, monkeypatch):
    rows = [(k, [float(k % 11), 0.25], "hot" if k % 3 else f"l{k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = sorted(plain_codes(rows, 2, 4), key=str)
    for share in (1, 3, 1000):
        monkeypatch.setattr(vector_codes, "HOT_SHARE", share)
        assert result(frame, parts=2, entries=4) == want


def test_decode(spark):
    frame = spark.createDataFrame([(k, [k / 4, k / 2], 0) for k in range(8)], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.compress(frame, parts=2, entries=8, rounds=1)
    for r in codes.collect():
        assert books.decode(np.asarray([[int(r.code[:2], 16), int(r.code[2:], 16)]])).tolist() == [[64 * r.vec_id, 128 * r.vec_id]] and r.error == 0
