import random

import pytest
import tiktoken

from chronotext.llm import bpe
from chronotext.llm.token_count import frequent_pretokens, token_counts


@pytest.fixture(scope="module")
def known():
    import public_tokenizers

    ranks, pattern = bpe.vocabulary()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts():
    rng = random.Random(1)
    signs = "aeiou thn's'll 12 ,.!?\n\t  éüßñ漢字かな😀́ []{}_-—“”ªº²Ǆ‍"
    out = ["", " ", "  \n\n x", "it's we'll I'd  'S", "a" * 3000, "ab" * 500, "\n" * 300, "é" * 400, "x\u0000y"]
    for _ in range(300):
        out.append("".join(rng.choice(signs) for _ in range(rng.randint(1, 120))))
    return out


def test_ids_are_those_of_the_public_encoder(known):
    ranks, pattern, public = known
    coder = bpe.Encoder(ranks, pattern)
    import numpy as np

    for t in some_texts():
        ids = np.frombuffer(coder.encode(t), "<i4").tolist()
        assert ids == public.encode_ordinary(t), t
        assert coder.decode(ids) == t.encode()


def test_short_and_long_way_agree(known):
    ranks = known[0]
    rng = random.Random(2)
    for _ in range(200):
        w = bytes(rng.choice(b"abcdefgth eo") for _ in range(rng.randint(2, 150)))
        if w not in ranks:
            assert bpe.merge(w, ranks) == bpe._merge_long(w, ranks)


def test_plain_signs_split_alike(known):
    import regex

    full, split = regex.compile(known[1]).findall, bpe.splitter(known[1])
    for c in range(0x3000):
        for s in (chr(c), f"a{chr(c)}b", f" {chr(c)} 1", f"1{chr(c)}!", f" {chr(c)}{chr(c)}é", f"\n{chr(c)}  x"):
            assert split(s) == full(s)


ROWS = [(1, "Hello there", "x", 5), (1, "Hello there", "x", 5), (2, None, None, None), (None, "a b", "y", 1), (3, "", "", 0), (4, "word " * 50000 + "z" * 20000, "", 0)]


def test_counts_and_round_trip_on_odd_rows(spark, known):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string, n_tokens int")
    want = sorted((i or -1, None if t is None else len(known[2].encode_ordinary(t))) for i, t, *_ in ROWS)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts(docs).collect())
    assert [g for g in got if g[0] != 2] == [w for w in want if w[0] != 2] and (2, None) in got
    enc = bpe.encoded(docs)
    for r in enc.collect():
        assert r.round_trip is (None if r.doc_id == 2 else True)
        assert r.n_tokens == (None if r.doc_id == 2 else len(r.ids))
    back = sorted((r.doc_id or -1, r.text or "") for r in bpe.decoded(enc).collect())
    assert back == sorted((i or -1, t or "") for i, t, *_ in ROWS)
    assert token_counts(docs.limit(0)).count() == 0 and bpe.encoded(docs.limit(0)).count() == 0


def test_frequent_tier_never_changes_counts(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, sizes = frequent_pretokens(docs, *known[:2], most=50)
    assert names.shape == (50, 2) and sizes.min() >= 1
    few = {(r.doc_id, r.n_tokens) for r in token_counts(docs, frequent=3).collect()}
    want = {(r.doc_id, len(known[2].encode_ordinary(r.text))) for r in docs.collect()}
    assert few == want == {(r.doc_id, r.n_tokens) for r in token_counts(docs).collect()}


def test_cache_keeps_to_its_size():
    made = []
    c = bpe.WordCache(lambda k: made.append(k) or len(k), most=10)
    for i in range(100):
        assert c[str(i)] == len(str(i)) and c["hot"] == 3
    assert len(c) <= 10 and len(c.old) <= 10 and made.count("hot") == 1


def test_counts_of_pretokens_of_many_tokens(spark, known):
    """Frequent pre-tokens of more tokens than fit into a byte."""
    texts = ["hello " + "\U0001f525" * 95, "\uac02" * 95, "\ua000" * 95, " x" * 5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 3, "doc_id long, text string")
    want = {(i, len(known[2].encode_ordinary(t))) for i, t in enumerate(texts)}
    assert max(n for _, n in want) > 255
    assert {(r.doc_id, r.n_tokens) for r in token_counts(docs).collect()} == want


def test_no_pretoken_is_exchanged(spark, known):
    """What is exchanged for the table are names and numbers."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string, n_tokens int")
    asked = []
    own = type(docs).toArrow
    try:
        type(docs).toArrow = lambda self: asked.append(self._jdf.queryExecution().executedPlan().toString()) or own(self)
        frequent_pretokens(docs, *known[:2])
    finally:
        type(docs).toArrow = own
    assert "Exchange hashpartitioning(a" in asked[0]
    at_exchange = [x for x in asked[0].split("\n") if "partial_sum" in x]
    assert at_exchange and all("text" not in x and "word" not in x for x in at_exchange)


def test_another_pattern_is_followed(spark, known):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    one = bpe.encoded(docs, pattern=r"[\s\S]").first()
    assert one.n_tokens == 5 and one.round_trip and token_counts(docs, pattern=r"(?:[\s\S])").first().n_tokens == 5


def test_decoding_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, [], "y"), (2, [0, 1], "z"), (2, [0, 1], "z")], "doc_id long, ids array<int>, text string")
    got = sorted(((r.doc_id, r.text) for r in bpe.decoded(rows).collect()), key=repr)
    assert (1, None) in got and (None, "") in got and len(got) == 4
    assert bpe.decoded(rows.limit(0)).count() == 0
