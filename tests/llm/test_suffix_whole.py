import random
from collections import defaultdict

from chronotext.llm import queries
from chronotext.llm.suffix_dedup import repeated_passages


def rows(df):
    return {(r.doc_id, r.start_word, r.end_word) for r in df.collect()}


def occurrences(docs, k):
    """Spans of words in windows of k words that begin at two (id, place)."""
    where, hit = defaultdict(set), defaultdict(set)
    for i, t in docs:
        w = t.split()
        for j in range(len(w) - k + 1):
            where[tuple(w[j : j + k])].add((i, j))
    for places in where.values():
        if len(places) > 1:
            for i, j in places:
                hit[i] |= set(range(j, j + k))
    out = set()
    for i, at in hit.items():
        for a in sorted(at):
            if a - 1 not in at:
                b = a
                while b in at:
                    b += 1
                out.add((i, a, b))
    return out


def test_repeats_within_a_document_are_those_of_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for i in range(60):
        own = [" ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.randint(10, 25))) for _ in range(3)]
        docs.append((i, " ".join(rng.choice(own) + " " + rng.choice("pqrst") * rng.randint(1, 4) for _ in range(rng.randint(1, 6)))))
    docs += [(100, "same " * 30), (101, "u v " * 20), (102, " ".join(f"w{k}" for k in range(40)))]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").repartition(3)
    for k, q in [(8, 3), (12, 5)]:
        want = occurrences(docs, k)
        assert rows(repeated_passages(df, min_words=k, anchor=q, within=True)) == want and want > rows(repeated_passages(df, min_words=k, anchor=q))


def test_query_reports_repeats_within_a_document(spark, tmp_path):
    passage = " ".join(f"w{k}" for k in range(60))
    text = passage + " between these two " + passage
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(queries.op9_with_repeats_within(spark, str(tmp_path))) == {(1, 0, 60), (1, 63, 123)}
    assert rows(queries.op9_suffix_array_dedup(spark, str(tmp_path))) == set()  # it repeats in no other document
