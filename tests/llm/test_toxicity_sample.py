import pyarrow as pa

from chronotext.llm import toxicity as T
from chronotext.llm._kernels import Words


def test_training_sample_has_a_thousand_toxic_and_three_thousand_other_rows(spark, monkeypatch):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(6000).selectExpr("id as doc_id", "int(id % 4 = 0) as toxic")
    seen = []
    monkeypatch.setattr(T, "train", lambda texts, toxic: seen.append((len(texts), sum(toxic))))
    T.fit_on_labels(docs, labels)
    assert seen == [(4000, 1000)]


def test_features_in_blocks_are_those_of_the_whole():
    w = Words(pa.array(["One two three.", "", "sentences und Wörter " * 30, None, "four five", "x"]))
    whole, parts = T.word_features(w), T.word_features(w, 40)
    assert len(list(T._blocks(w, 40))) > 2
    for a, b in zip([whole[0], *whole[1], *whole[2]], [parts[0], *parts[1], *parts[2]], strict=True):
        assert a.tolist() == b.tolist()
