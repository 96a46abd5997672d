import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators.segments import encode_segments, segment_words, whole_text_segment
from chronotext.operators.tokens import add_wildcards, extend_over_deletions, interpolate_times, merge_multitoken, without_wildcards


def frame(spark, text):
    return spark.createDataFrame([(1, text, len(text))], "k int, text string, n int")


def tok(df):
    return [(r.normalized_token, r.start_char, r.end_char) for r in df.orderBy("tok_pos").collect()]


def test_examples_of_spans(spark):
    rules = [(r"I'm", "I am")]
    assert tok(tx.token_map_with(frame(spark, "I'm sorry"), rules, ["k"])) == [("I", 0, 3), ("am", 0, 3), ("sorry", 4, 9)]
    got = tok(tx.token_map(frame(spark, "Don't go way--in (x) 50%"), ["k"]))
    assert got == [("dont", 0, 5), ("go", 6, 8), ("wayin", 9, 16), ("x", 17, 20), ("50", 21, 24)]
    assert tok(tx.token_map(frame(spark, "a¨b c"), ["k"])) == [("a", 0, 3), ("b", 0, 3), ("c", 4, 5)]
    assert tok(tx.token_map_with(frame(spark, "ab c"), [], ["k"], level="char")) == [("a", 0, 1), ("b", 1, 2), ("c", 3, 4)]
    with pytest.raises(ValueError):
        tx.SpanMap("x").tokens("line")


def test_closed_form_is_the_default_rules(spark):
    rng = random.Random(1)
    signs = "abcÄß ñé12.,!?'\"-–()_ \n\t½％ﬁ  ΅😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "  lead and trail  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    fast, slow = {}, {}
    for out, got in ((fast, tx.token_map(df, ["k"])), (slow, tx.token_map_with(df, tx.DEFAULT_RULES, ["k"]))):
        for r in got.collect():
            out.setdefault(r.k, []).append((r.tok_pos, r.normalized_token, r.start_char, r.end_char))
    assert {k: sorted(v) for k, v in fast.items()} == {k: sorted(v) for k, v in slow.items()}


def test_empty_matches_and_deletions():
    m = tx.SpanMap("ab").rewrite(r"$", "!").rewrite("^", "<")
    assert m.text == "<ab!" and list(zip(m.lo.tolist(), m.hi.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert tx.SpanMap("abc").rewrite("b", "").tokens() == [("ac", "abc", 0, 3)]
    assert tx.SpanMap("x").rewrite("x", r"\1").text == r"\1"


def segment(spark, text, rules=None, wild=False, spans=None, strict=True):
    df = frame(spark, text)
    t = tx.token_map(df, ["k", "n"]) if rules is None else tx.token_map_with(df, rules, ["k", "n"])
    if wild:
        n = F.lit(len(text))
        t = add_wildcards(t.drop("n"), ["k"]).withColumn("n", n)
    t = interpolate_times(t, ["k"], F.lit(0.0), F.lit(10.0))
    m = merge_multitoken(t, ["k"], carry=["n"])
    m = extend_over_deletions(m, ["k"], "n").withColumn("doc", F.lit(text)).withColumn("text_span_full", F.expr("substring(doc, start_char + 1, end_char_extended - start_char)")).drop("doc")
    m = without_wildcards(m)
    s = tx.sentence_spans(df, ["k"]) if spans is None else spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "k int, seg_pos int, start_char int, end_char int")
    return encode_segments(segment_words(m, s, ["k"], strict), ["k"]).orderBy("seg_pos").collect()


def test_segment_examples(spark):
    a = segment(spark, 'Hello there. "It is," she said.')
    assert [r.text for r in a] == ["Hello there. ", '"It is," she said.']
    assert a[0].start == 0 and a[1].end == 10 and [w.text for w in a[1].words] == ['"It ', 'is," ', "she ", "said."]
    b = segment(spark, 'Hello there. "It is" so. Bye now.', tx.TRANSCRIPT_RULES)
    assert [r.text for r in b] == ['Hello there. "']
    text = "One two. Three four ..."
    assert len(segment(spark, text, wild=True)) == 1 and len(segment(spark, text)) == 2
    d = '"Hi" all. Next one.'
    assert segment(spark, d, tx.TRANSCRIPT_RULES) == []
    assert [r.text for r in segment(spark, d, tx.TRANSCRIPT_RULES, strict=False)] == ["Next one."]
    f = segment(spark, "a¨b c")
    assert [w.text for w in f[0].words] == ["a¨b ", "c"]


def cursor_model(tokens, spans):
    """The rule told as a loop: tokens are consumed in order until both ends of a span were met."""
    out, at = [], 0
    for k, (a, b) in enumerate(spans):
        first = last = None
        begun = at
        while at < len(tokens) and (first is None or last is None):
            s, e = tokens[at]
            if first is None and s <= a < e:
                first = at
            if last is None and s < b <= e:
                last = at
            at += 1
        if first is None or last is None:
            break
        out.append((k, first, last, list(range(begun, at))))
    return out


def test_segments_follow_the_cursor(spark):
    rng = random.Random(5)
    rows, spans, want = [], [], {}
    for k in range(300):
        edges = sorted(rng.sample(range(0, 60), rng.randint(3, 12)))
        shift = rng.choice([0, 1])
        toks = list(zip(edges, edges[1:]))
        own = []
        at = edges[0] + shift * rng.randint(-1, 2)
        while at < edges[-1]:
            end = at + rng.randint(1, 25)
            own.append((at, end))
            at = end + rng.choice([0, 0, 0, 1, -1, 5])
        for i, (s, e) in enumerate(toks):
            rows.append((k, i, s, e, float(i), i + 0.5, 0.1 * i, f"<{i}>"))
        spans += [(k, i, a, b) for i, (a, b) in enumerate(own)]
        want[k] = [(j, first, last, words) for j, first, last, words in cursor_model(toks, own)]
    t = spark.createDataFrame(rows, "k int, tok_pos int, start_char int, end_char_extended int, start_time double, end_time double, score double, text_span_full string")
    s = spark.createDataFrame(spans, "k int, seg_pos int, start_char int, end_char int")
    got = {k: [] for k in want}
    for r in encode_segments(segment_words(t, s, ["k"]), ["k"]).orderBy("k", "seg_pos").collect():
        got[r.k].append((r.seg_pos, int(r.start), int(r.end), [int(w.start) for w in r.words]))
    assert got == want and sum(map(len, want.values())) > 200


def test_normalized_text_and_case(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", tx.normalized_text("text").alias("n")).collect():
        plain = " ".join(re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", r.text).lower()).split())
        assert r.n == plain
    case = lambda *v: tx.vocabulary_case(spark.createDataFrame([(x,) for x in v], "token string")).first()[0]
    assert [case("a", "b", "<PAD>"), case("A", "B", "|"), case("a", "B"), case("|", "<s>")] == ["lower", "upper", "mixed", "lower"]
    df = frame(spark, "a\nß")
    assert df.select(tx.fold_case("text", "upper")).first()[0] == "A SS"
    assert df.select(tx.rewrite("text", [("a", r"$1\n")])).first()[0] == "$1\\n\nß"
    with pytest.raises(Exception, match="white space"):
        frame(spark, " x").select(tx.no_leading_space("text")).collect()


def test_sentences_tile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = {}
    for r in tx.sentence_spans(docs, ["doc_id"]).orderBy("doc_id", "seg_pos").collect():
        assert r.start_char == at.get(r.doc_id, 0)
        at[r.doc_id] = r.end_char
    assert all(at[i] == len(t) for i, t in texts.items() if t)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no end"), (4, "a.\n\nb?! c")], "k int, text string")
    got = [(r.k, r.start_char, r.end_char) for r in tx.sentence_spans(odd, ["k"]).orderBy("k", "seg_pos").collect()]
    assert got == [(3, 0, 6), (4, 0, 4), (4, 4, 8), (4, 8, 9)]


def test_whole_text_segment(spark):
    t = tx.token_map(frame(spark, "one two"), ["k"])
    assert whole_text_segment(t, ["k"]).first() == (1, 0, 0, 7)
