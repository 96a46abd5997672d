import random
import re
from collections import defaultdict

import numpy as np

from chronotext.llm import suffix_dedup
from chronotext.llm.suffix_dedup import bucket_pointer_refinement, least_of_windows, repeated_passages


def test_suffix_array_is_that_of_plain_sorting():
    rng = np.random.default_rng(1)
    for n, kinds in [(1, 1), (2, 1), (50, 2), (200, 3), (300, 50), (64, 1)]:
        t = rng.integers(0, kinds, n)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        for q in (1, 2, 3):
            assert bucket_pointer_refinement(t, q).tolist() == want
        assert bucket_pointer_refinement(t).tolist() == want
    assert len(bucket_pointer_refinement(np.zeros(0, int))) == 0


def test_blocks_and_depth_limit(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    t = np.concatenate([rng.integers(0, 4, 90), np.tile(rng.integers(0, 4, 25), 4), rng.integers(0, 4, 40)])
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert bucket_pointer_refinement(t, 2).tolist() == want
    for limit in (1, 5, 12, 30):
        some = bucket_pointer_refinement(t, 2, limit)
        cut = [t[i : i + limit].tolist() for i in some]
        assert sorted(some.tolist()) == list(range(len(t))) and cut == sorted(cut)


def test_anchor_is_the_least_of_its_window():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 40, 300).astype(np.uint64)
    for window in (1, 2, 3, 8, 37):
        got = least_of_windows(g, window)
        assert got.tolist() == [int(np.min(g[i : i + window])) for i in range(len(g) - window + 1)]


def brute(docs, k):
    where = defaultdict(set)
    words = {}
    for i, t in docs:
        if i is None or t is None:
            continue
        words.setdefault(i, set()).add(t)
        w = re.findall(r"[^\W_]+", t.lower())
        for j in range(len(w) - k + 1):
            where[tuple(w[j : j + k])].add((i, j))
    hit = defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, j in places:
                hit[i] |= set(range(j, j + k))
    out = set()
    for i, at in hit.items():
        at = sorted(at)
        s = at[0]
        for a, b in zip(at, at[1:] + [None]):
            if b is None or b > a + 1:
                out.add((i, s, a + 1))
                s = b
    return out


def rows(df):
    return {(r.doc_id, r.start_word, r.end_word) for r in df.collect()}


def test_passages_are_those_of_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(8)]
    docs = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared).split()
            a = rng.randint(0, len(s) - 1)
            parts += [" ".join(s[a : rng.randint(a, len(s))]), " ".join(word() for _ in range(rng.randint(0, 9)))]
        docs.append((i, rng.choice([". ", " ", "\n"]).join(parts)))
    docs += [(200, "same " * 60), (201, "same " * 30), (202, "other " * 60), (203, "x y " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for k, q in [(12, 4), (10, 9), (20, 3)]:
        want = brute(docs, k)
        assert rows(repeated_passages(df, min_words=k, anchor=q)) == want and want
        for hot in (0, 300):  # all anchors, or the frequent ones, take the way of hot ones
            assert rows(repeated_passages(df, min_words=k, anchor=q, hot_words=hot)) == want


def test_passages_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert rows(repeated_passages(docs)) == want and want


def test_small_chunks_and_stretches_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    want = rows(repeated_passages(docs, within=True))
    monkeypatch.setattr(suffix_dedup, "CHUNK_WORDS", 300)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 3)
    assert rows(repeated_passages(docs, within=True)) == want and want
    assert rows(repeated_passages(docs, within=True, hot_words=100)) == want


def test_query_runs_the_refinement(spark, monkeypatch):
    """The operator's order of suffixes comes from bucket_pointer_refinement."""
    import pyarrow as pa

    texts = ["a b c d e f g h", "x a b c d e f y", "q r s t u v w x"]
    asked = []
    own = suffix_dedup.bucket_pointer_refinement
    monkeypatch.setattr(suffix_dedup, "bucket_pointer_refinement", lambda *a, **k: asked.append(1) or own(*a, **k))

    class Hot:
        value = np.zeros(0, np.uint64)

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["id", "text"])
    sent = pa.Table.from_batches(suffix_dedup._emitter(5, 2, Hot, False)(iter([batch]))).sort_by("anchor").combine_chunks()
    out = list(suffix_dedup._sorter(5, False, 1000)(iter(sent.to_batches())))
    assert asked and sorted(r for b in out for r in zip(*b.to_pydict().values()))[0][0] == 1
    assert {b.to_pydict()["id"][k] for b in out for k in range(b.num_rows)} == {1, 2}


def test_many_copies_of_a_passage(spark):
    """Copies beyond what one task orders: grouped one by one by name, none lost."""
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.range(5000).selectExpr("id AS doc_id", f"concat('own', id, ' {passage} tail', id) AS text").repartition(4)
    assert rows(repeated_passages(docs, hot_words=20_000)) == {(i, 1, 61) for i in range(5000)}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(70))
    data = [(1, text, 1, "x"), (1, text, 1, "x"), (2, None, None, None), (None, text, 2, "y"), (3, "", 3, ""), (4, text.upper() + " tail", 4, "z"), (5, "long word run " * 40000, 5, "q")]
    docs = spark.createDataFrame(data, "doc_id long, text string, id int, anchor string")
    assert rows(repeated_passages(docs)) == {(1, 0, 70), (4, 0, 70)}
    assert repeated_passages(docs.limit(0)).count() == 0
    assert repeated_passages(docs.where("doc_id = 1")).count() == 0
