import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from chronotext.llm.components import connected_components
from chronotext.llm.minhash_dedup import drop_near_duplicates, near_duplicate_groups, signatures


def shingles(t, k=3):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_recall_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = set()
    for v in where.values():
        if len(v) < 60:
            pairs.update(combinations(sorted(v), 2))
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(docs).collect()}
    found = sum(a in got and got[a] == got.get(b) for a, b in near)
    assert len(near) > 100 and found >= 0.95 * len(near)
    far = {i for i in got} - {i for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.38 * len(sets[p[0]] | sets[p[1]]) for i in p}
    assert not far


def test_signature_share_estimates_jaccard():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    a = list(rng.choice(words, 300))
    b = list(a)
    for i in rng.choice(300, 20, replace=False):
        b[i] = "zz"
    a, b = " ".join(a), " ".join(b)
    sig, has = signatures(pa.array([a, b, "", "only two", None]), 2048)
    x, y = shingles(a), shingles(b)
    assert has.tolist() == [True, True, False, True, False]
    assert (sig[0] == sig[1]).mean() == pytest.approx(len(x & y) / len(x | y), abs=0.04)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: top(i) for i in root if top(i) != i}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_failing_members_meet_all_others_of_the_bucket(spark):
    """With one hash a band, unlike texts share buckets: partners other than the bucket's least must be found."""
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"v{i}" for i in range(60)], 80)) for _ in range(12)]
    docs = [(i, base[i % 12] + f" tail{i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(df, n_hashes=64, bands=64, threshold=0.6).collect()}
    assert got == {i: i % 12 for i in range(60)}


def test_odd_rows_and_filter(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t, "g", 1), (1, t, "g", 1), (2, t.upper(), None, None), (3, None, "g", 3), (4, "", "g", 4), (5, "...", "g", 5), (6, "!!", "g", 6), (None, t, "g", 7), (7, "hi", "g", 8), (8, "Hi!", "g", 9), (9, "word " * 200000, "g", 0)]
    rows += [(100 + i, "same text here for all of the copies", "g", i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id string, sig int")
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(docs).collect()}
    assert got == {1: 1, 2: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(500)}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 100]
    assert near_duplicate_groups(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_work_in_a_bucket_of_unlike_members_is_bounded(spark, monkeypatch):
    """Members of one bucket that are all unlike, and two clusters in it: no pair is lost, none is emitted but links."""
    from chronotext.llm import minhash_dedup

    rng = np.random.default_rng(5)
    n, width = 3000, 128
    sig = rng.integers(0, 1 << 16, (n, width)).astype(np.uint16)
    sig[1000:1500] = sig[1000]  # a second cluster, tight
    sig[2000:2010, :70] = sig[2000, :70]  # alike in 70 of 128
    sig[2500:2510, :63] = sig[2500, :63]  # not alike
    sig[40, :64] = sig[0, :64]
    sig[41, 20:84] = sig[40, 20:84]  # like a member of the first cluster, not like its centre
    rows = [(i, bytearray(sig[i].tobytes()), [7]) for i in range(n)]
    sigs = spark.createDataFrame(rows, "id long, sig binary, keys array<long>").repartition(4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 200)
    links = minhash_dedup._links(sigs, 64, width).collect()
    same = lambda u, v: int((sig[u] == sig[v]).sum())
    assert all(same(r.u, r.v) >= 64 for r in links) and len(links) < 3 * n
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[max(top(r.u), top(r.v))] = min(top(r.u), top(r.v))
    got = {i: top(i) for i in range(n) if top(i) != i}
    want = {i: 1000 for i in range(1001, 1500)} | {i: 2000 for i in range(2001, 2010)} | {40: 0, 41: 0}
    assert got == want


def test_number_of_links(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text), (4, "other words here and there")], "doc_id long, text string")
    assert {(r.doc_id, r.group_id, r.n_links) for r in near_duplicate_groups(docs).collect()} == {(1, 1, 2), (2, 1, 1), (3, 1, 1)}


def test_components_beyond_few_edges(spark, monkeypatch):
    """Stars by sums and joins give the same forests as windows."""
    from chronotext.llm import components

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(0, k) for k in range(300, 500)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {r.u: r.root for r in connected_components(df).collect()}
    monkeypatch.setattr(components, "SMALL", 10)
    assert {r.u: r.root for r in connected_components(df).collect()} == want


def test_intermediate_tables_are_deleted(spark):
    import os

    from chronotext.llm._spark import shared_dir

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    where = shared_dir(spark).removeprefix("file:")
    old = {x for x in os.listdir(where) if x.startswith("minhash")}
    assert near_duplicate_groups(docs).count() == 2
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - old if x.startswith("minhash")} == {"minhash-links"}
