import numpy as np
import pyarrow as pa
import pytest

from chronotext.llm import language_id as L


def test_counts_are_those_of_plain_grams():
    texts = ["The cat, the 12 hats!", "", None, "été", "a"]
    got = L.gram_counts(pa.array(texts))
    for t, row in zip(texts, got):
        plain = b" ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).encode().split())
        lead = b"".join(plain.split())
        assert row[:256].sum() == len(lead)
        for c in set(lead):
            assert row[c] == lead.count(bytes([c]))
    assert L.vectors(got.copy(), np.ones(L.CELLS, np.float32))[1].sum() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit_on_labels(docs.where("doc_id % 2 = 0"))
    assert len(model.of) > len(model.langs) == 4
    test = docs.where("doc_id % 2 = 1")
    want = {r.doc_id: r.lang for r in test.select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in L.identified(test, model).collect()}
    assert set(got) == set(want)
    assert np.mean([got[i].language == want[i] for i in want]) > 0.96
    assert np.mean([got[i].rejected for i in want]) < 0.01


def test_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit_on_labels(docs)
    other = ["Это довольно длинный русский текст о погоде и людях. " * 8, "これは日本語の文章です。天気がよいです。" * 12, "zzxq qqzx vvkj wwqz " * 30]
    df = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    assert all(r.rejected and r.language is None for r in L.identified(df, model).collect())


def test_short_foreign_texts_are_rejected(spark):
    """Rejection doesn't hang on how many training texts are that short."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit_on_labels(docs.where("doc_id % 3 > 0"))
    fi = "Tämä on suomenkielinen lause joka kertoo säästä ja ihmisistä kaupungissa huomenna sataa lunta koko maassa"
    pl = "To jest polskie zdanie o pogodzie i ludziach w mieście jutro będzie padać śnieg w całym kraju"
    other = [fi[:80], fi, fi[:40], pl[:80], pl, pl[:40], "qq", "xqzk wvvq"]
    df = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    assert [r.rejected for r in L.identified(df, model).orderBy("doc_id").collect()] == [True] * len(other)
    rng = np.random.default_rng(1)
    own = [(r.doc_id, r.text[a : a + n], r.lang) for r in docs.where("doc_id % 3 = 0 and n_chars > 400").limit(300).collect() for n in (40, 100, 300) for a in [int(rng.integers(0, len(r.text) - n))]]
    got = L.identified(spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(own)], "doc_id long, text string"), model).collect()
    assert np.mean([r.rejected for r in got]) < 0.03
    assert np.mean([r.language == own[r.doc_id][2] for r in got if not r.rejected]) > 0.97


def test_every_language_has_centroids(spark):
    rows = [(i, "the and of thing here with them " * 3, "en") for i in range(3000)] + [(5000 + i, "och att det som en på är av för med " * 3, "sv") for i in range(3)] + [(9000, None, "xx"), (None, "a", "yy"), (9001, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_on_labels(docs, max_rows=100)
    assert model.langs == ["en", "sv"] and set(model.of) == {0, 1}


def test_cosines_are_those_of_plain_arithmetic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    model = L.fit_on_labels(docs)
    got = {r.doc_id: r for r in L.identified(docs, model).collect()}
    for r in docs.collect():
        count = L.gram_counts(pa.array([r.text]))[0]
        v = {c: (1 + np.log(count[c])) * model.idf[c] for c in np.flatnonzero(count)}
        size = sum(x * x for x in v.values()) ** 0.5
        cos = {}
        for lang, c in zip((model.langs[k] for k in model.of), model.centre):
            cos[lang] = max(cos.get(lang, -1), sum(x * c[k] for k, x in v.items()) / size if size else 0)
        best = sorted(cos, key=lambda lang: (-cos[lang], lang))
        assert got[r.doc_id].cosine == pytest.approx(max(cos[best[0]], 0), abs=2e-4)
        assert got[r.doc_id].rejected or got[r.doc_id].language == best[0]
        assert got[r.doc_id].margin == pytest.approx(max(cos[best[0]] - max(cos[best[1]], 0), 0), abs=2e-4)


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit_on_labels(docs)
    rows = [(1, None, "en", 0), (2, "", None, None), (3, "12 34 !!", "en", 1), (None, "the and of the thing is here with the rest of them", "en", 2), (4, "the and of " * 100000, "en", 3), (4, "the and of " * 100000, "en", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, language string, cosine int")
    got = L.identified(odd, model).collect()
    assert len(got) == 6 and {r.doc_id for r in got if r.rejected} == {1, 2, 3}
    assert all(r.cosine == 0 and r.margin == 0 for r in got if r.rejected)
    assert L.identified(odd.limit(0), model).count() == 0
    nothing = L.fit_on_labels(docs.limit(0))
    assert all(r.rejected for r in L.identified(odd, nothing).collect())


def test_ties_go_to_the_first_language():
    c = np.zeros((2, L.CELLS), np.float32)
    c[:, 97] = 1
    m = L.Centroids(["aa", "bb"], np.array([0, 1]), c, np.ones(L.CELLS, np.float32), np.zeros(0), np.zeros(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["aaa"])], names=["doc_id", "text"])
    assert L._answer(batch, m).column("language").to_pylist() == ["aa"] and L._answer(batch, m).column("margin").to_pylist() == pytest.approx([0])
