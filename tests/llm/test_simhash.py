"""SimHash: fingerprints and components against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubspark.llm import common, simhash
from scrubspark.llm.common import union_min_labels

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items, max_bits=3):
    """items: (doc_id, fp); smallest id reachable."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        if (items[i][1] ^ items[j][1]).bit_count() <= max_bits:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(items))]


@given(st.text(alphabet="aB\t\n \x0b\x1c éÀ ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_long_text(monkeypatch):
    text = " ".join(f"w{i * 7919 % 997}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(common, "PART_BYTES", 50)
    assert whole == simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(" " * 200 + "one") == plain_fingerprint("one")


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(docs, plain_components(docs))}
    got = simhash.op2_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(docs)


def test_links_of_dense_and_chained_fingerprints(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    fps = {center} | {center ^ sum({1 << int(b) for b in rng.integers(0, 64, n)}) for n in (1, 2, 3, 4, 5) for _ in range(120)}
    chain = [0x0F0F << 40 ^ ((1 << 3 * k) - 1) for k in range(12)]  # each three bits from the next
    fps = sorted(fps | set(chain) | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    signed = [f - (f >> 63 << 64) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        links = simhash.near_links(frame).collect()
        roots = {r.node: r.root for r in union_min_labels(simhash.near_links(frame)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    want = plain_components(list(zip(signed, fps)))
    assert [roots.get(f, f) for f in signed] == want


def test_pairs_are_retained_in_their_first_list_only():
    rng = np.random.default_rng(8)
    lists = list(combinations(range(8), 5))
    for _ in range(300):
        bits = rng.choice(64, rng.integers(1, 6), replace=False)
        a = np.uint64(rng.integers(0, 1 << 63))
        b = a ^ np.uint64(sum(1 << int(k) for k in bits))
        equal = [p for p in range(8) if (int(a) >> 8 * p) & 255 == (int(b) >> 8 * p) & 255]
        meets = [i for i, chosen in enumerate(lists) if set(chosen) <= set(equal)]
        gives = [i for i in meets if simhash.spanning_links(np.asarray([a, b], np.uint64), i, 3)]
        assert gives == (meets[:1] if len(bits) <= 3 else [])
        assert [i for i in meets if a ^ b in simhash._masks(i, 3)] == gives


def test_long_lists_give_the_components_of_short_ones(monkeypatch):
    rng = np.random.default_rng(9)
    lists = list(combinations(range(8), 5))
    for number in (0, 23, 55):
        free = [p for p in range(8) if p not in lists[number]]
        fps = {sum(int(rng.integers(256)) << 8 * p for p in free) for _ in range(300)}
        for p in free:  # one bit of a byte in some, so that up to three bytes differ
            fps |= {f ^ 1 << 8 * p + int(rng.integers(8)) for f in list(fps) if rng.random() < 0.6}
        members = np.asarray(sorted(fps), np.uint64)

        def components(links):
            root = {int(f): int(f) for f in members}
            for _ in members:
                before = dict(root)
                for a, b in links:
                    root[int(a)] = root[int(b)] = min(root[int(a)], root[int(b)])
                if root == before:
                    return root

        plain = simhash.spanning_links(members, number, 3)
        by_masks = simhash._links_by_masks(members, number, 3)
        assert len(plain) == len(by_masks) > 100 and components(plain) == components(by_masks)
    monkeypatch.setattr(simhash, "comb", lambda n, k: 0)  # now every list counts as long
    assert sorted(simhash.spanning_links(members, 55, 3)) == sorted(by_masks)


def test_edges_of_input(spark):
    a, b = "one two three four five", "ONE two\tthree four\nfive"
    rows = [(5, a, 1), (2, b, 1), (9, None, 1), (4, "", 1), (None, " \n", 1), (5, a, 1), (None, "lone word here now", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    fa, fl, zero = f"{plain_fingerprint(a):016x}", f"{plain_fingerprint(rows[6][1]):016x}", "0" * 16
    assert got == sorted([(5, fa, 2), (5, fa, 2), (2, fa, 2), (9, zero, 4), (4, zero, 4), (None, zero, 4), (None, fl, None)], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, None, None]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_unlike_texts_with_one_id_all_stay(spark):
    a, near, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "alpha", "beta", "gamma"))
    rows = [(5, a, "x"), (5, near, "w"), (5, other, "y"), (5, third, "z"), (3, third, "v"), (7, a, "u"), (8, other, "t"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for parts in (1, 4):
        kept = simhash.drop_near_duplicates(docs.repartition(parts))
        assert kept.columns == docs.columns
        assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(5, near, "w"), (5, other, "y"), (3, third, "v"), (None, a, "s")], key=str)


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_large_components_split_alike(spark, monkeypatch, share):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in range(60)] + ["a b c d"] * 30 + [f"x{i} y{i * 7} z" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(simhash, "HOT_SHARE", share)  # every key by shuffle or by broadcast
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: int(f, 16) for i, (f, _) in got.items()}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            low = min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
            if low < root[i]:
                root[i], changed = low, True
    assert {i: c for i, (_, c) in got.items()} == root
    assert max(list(root.values()).count(r) for r in set(root.values())) >= 30
