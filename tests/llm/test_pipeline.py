import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from chronotext.llm import bpe, minhash_dedup, secret_scan, toxicity
from chronotext.llm.decontaminate import budget


def shingles(t, k=3):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages_against_plain_versions(spark):
    """Each stage's decisions, made again without Spark over its own input."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = {r.doc_id: r for r in docs.collect()}
    steps = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        steps[name] = {r.doc_id: r for r in now.collect()}
    model = toxicity.model_for(spark, d)
    import pyarrow as pa

    ids = sorted(at)
    bad = toxicity._score(pa.array([at[i].text for i in ids]), model.dense(), model)[3]
    assert set(steps["toxicity"]) == {i for i, b in zip(ids, bad) if not b}
    before = steps["toxicity"]
    sets = {i: shingles(r.text) for i, r in before.items()}
    sure, maybe = set(), set()
    for i in before:
        for j in before:
            if i < j and sets[i] and sets[j]:
                jac = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if jac >= 0.65:
                    sure.add(j)
                if jac >= 0.35:
                    maybe.add(j)
    gone = set(before) - set(steps["minhash_near_dedup"])
    assert sure <= gone <= maybe and sure
    bench = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    held = set()
    for i, r in steps["minhash_near_dedup"].items():
        text = np.frombuffer(" ".join(re.findall(r"[^\W_]+", r.text.lower())).encode(), np.uint8)
        for b in bench:
            p = b.encode()
            row = np.zeros(len(text) + 1, dtype=np.int64)
            step = np.arange(len(text) + 1)
            for c_at, c in enumerate(p, 1):
                new = np.r_[c_at, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
                row = np.minimum.accumulate(new - step) + step
            if row.min() <= budget(len(p)):
                held.add(i)
                break
    assert set(steps["minhash_near_dedup"]) - set(steps["benchmark_decontamination"]) == held
    assert set(steps["secret_scans"]) == set(steps["benchmark_decontamination"])
    net = secret_scan.train()
    for i, r in steps["secret_scans"].items():
        old = steps["benchmark_decontamination"][i].text
        if r.text != old:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert not secret_scan.scan([old], net)
    import public_tokenizers

    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    last = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: r.ids for r in last} == {i: public.encode_ordinary(r.text) for i, r in steps["secret_scans"].items()}
    assert all(r.round_trip for r in last)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, tmp_path, empty):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, text, None, None, None, None), (3, None, "en", "a", 0, "x"), (None, "no id here", "en", "a", 0, "x"), (4, "", "en", "a", 0, "x"), (None, None, None, None, None, None), (5, "x" * 100000 + " long", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, group_id string")
    if empty:
        docs = docs.limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in got) == ([] if empty else [0, 0, 1, 3, 4, 5])
    if not empty:
        assert {r.doc_id: r.round_trip for r in got if r.doc_id} == {1: True, 3: None, 4: True, 5: True}
