from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from chronotext.llm import toxicity as T
from chronotext.llm._kernels import Words


def brute(e, trans):
    """Marginals by all label sequences."""
    n, total, on = len(e), 0.0, np.zeros(len(e))
    for y in product((0, 1), repeat=n):
        s = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
        total += s
        on += s * np.array(y)
    return on / total, total


def test_marginals_are_those_of_all_sequences():
    rng = np.random.default_rng(1)
    trans = rng.standard_normal((2, 2))
    sizes = [1, 5, 3, 7, 1, 2]
    first = np.r_[0, np.cumsum(sizes)]
    e = rng.standard_normal(first[-1]) * 2
    p = T._sigmoid(T.marginals(e, first, trans)[0])
    for a, b in zip(first, first[1:]):
        assert p[a:b] == pytest.approx(brute(e[a:b], trans)[0])


def test_long_chains_are_not_cut(monkeypatch):
    """Marginals don't depend on the size of the pieces that a chain is worked through in."""
    rng = np.random.default_rng(4)
    for trans in (rng.standard_normal((2, 2)), np.array([[3.0, -4.0], [-5.0, 6.0]])):
        sizes = [700, 3, 128, 129, 1, 256, 4000]
        first = np.r_[0, np.cumsum(sizes)]
        e = rng.standard_normal(first[-1]) * 3
        monkeypatch.setattr(T, "PIECE", 10_000)
        whole = T.marginals(e, first, trans)
        for piece in (2, 7, 128):
            monkeypatch.setattr(T, "PIECE", piece)
            for a, b in zip(whole, T.marginals(e, first, trans)):
                assert b == pytest.approx(a, abs=1e-6)
        monkeypatch.setattr(T, "PIECE", 3)
        p = T._sigmoid(T.marginals(e[:9], np.array([0, 9]), trans)[0])
        assert p == pytest.approx(brute(e[:9], trans)[0])


def test_fit_finds_weights_and_transitions():
    rng = np.random.default_rng(2)
    n, first = 4000, np.arange(0, 4001, 8)
    y = np.zeros(n, dtype=int)
    for i in range(n):
        y[i] = rng.random() < (0.7 if i % 8 and y[i - 1] else 0.2)
    word = np.where(rng.random(n) < 0.9, 10 + y * 5 + rng.integers(0, 5, n), rng.integers(10, 20, n))
    used, w, bias, trans = T.fit(word[None, :].astype(np.int32), first, y)
    table = np.zeros(30)
    table[used] = w
    assert table[15:20].min() > table[10:15].max() + 2
    assert trans[1, 1] + trans[0, 0] > trans[0, 1] + trans[1, 0] + 1
    p = T._sigmoid(T.marginals(bias + table[word], first, trans)[0])
    assert ((p > 0.5) == y).mean() > 0.93


def test_chains_are_sentences():
    w = Words(pa.array(["One two. Three four five!\nSix", "seven eight", "", "x " * 300]))
    first = T.chains(w)
    assert np.diff(first).tolist() == [2, 3, 1, 2, 300]


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").collect()
    model = T.fit_on_labels(docs, train)
    said = {r.doc_id: r for r in T.toxic_spans(docs, model).collect()}
    toxic = {r.doc_id for r in test if r.toxic == 1}
    clean = {r.doc_id for r in test if r.toxic == 0}
    assert len(toxic & set(said)) >= 0.9 * len(toxic)
    assert len(clean & set(said)) <= 0.01 * len(clean)
    text = {r.doc_id: r.text for r in docs.where("lang = 'en'").collect()}
    seen = {text[i][s.start : s.end].lower() for i, r in said.items() if i in text for s in r.spans}
    assert {"idiot", "moron", "scum"} <= seen


def test_odd_rows_and_untrained_model(spark):
    bad = "you are a worthless idiot and a pathetic moron, said the man"
    labelled = [(i, (bad if i % 4 == 0 else "a kind word for all who read this today") + " " + " ".join(f"x{(i * 7 + k * k) % 997}" for k in range(12))) for i in range(400)]
    docs = spark.createDataFrame(labelled, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = T.fit_on_labels(docs, labels)
    rows = [(1, bad, "s", 1.0), (1, bad, "s", 1.0), (2, None, None, None), (3, "", "s", 0.0), (None, bad.upper(), "s", 2.0), (4, "all is well " * 60000, "s", 0.0), (5, "..!", "s", 0.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, spans string, score double")
    assert sorted(r.doc_id or 0 for r in T.toxic_spans(odd, model).collect()) == [0, 1, 1]
    kept = T.drop_toxic(odd, model)
    assert kept.schema == odd.schema and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert T.toxic_spans(odd.limit(0), model).count() == 0
    assert T.drop_toxic(odd.limit(0), model).count() == 0
    assert len(T.fit_on_labels(docs, labels, max_bytes=0).cells) == 1
    none = T.fit_on_labels(docs, labels.limit(0))
    assert T.toxic_spans(odd, none).count() == 0 and T.drop_toxic(odd, none).count() == 7
