"""Queries over tables with odd rows: the rows of their SQL, no error and nothing left out."""

import random
import shutil

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext.functions import frames as fr
from chronotext.functions import text as tx
from chronotext.operators import tokens
from chronotext.operators.segments import custom_spans, encode_segments, segment_words, whole_text_segment
from chronotext.plans import catalog, pipelines

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def changed(tmp_path):
    """A copy of the tables with one of them replaced; gives its folder and DuckDB over it."""

    def make(name, rows):
        for t in TABLES:
            if t != name:
                shutil.copy(f"{D}/{t}.parquet", tmp_path)
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == name else ''}'")
        return str(tmp_path), con

    return make


def same(spark, folder, con, name):
    got = catalog.QUERIES[name](spark, folder)
    names = sorted(got.columns)
    rel = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.SQL[name]}) q")
    have = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    want = sorted(rel.fetchall(), key=repr)
    assert repr(have) == repr(want)  # NaN is no equal of itself
    return have


def test_a_user_whose_only_region_has_no_frames(spark, changed):
    """One score at the end is a region without length: neither frames nor logits."""
    events = spark.read.parquet(f"{D}/events.parquet")
    one = events.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("value", F.lit(catalog.ONSET + 1))
    rows = same(spark, *changed("events", events.unionByName(one)), "frames_per_logit")
    assert [repr(r) for r in rows if -1 in r] == ["(nan, -1)"]


def test_case_of_texts_that_begin_with_white_space(spark, changed):
    """A table of documents isn't the nested record that forbids it: every row is folded."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = docs.limit(2).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("text", F.concat(F.lit(" \n"), "text"))
    rows = same(spark, *changed("documents", docs.unionByName(odd)), "fold_case")
    assert sum(r[1].startswith("  ") for r in rows) == 2


def test_segments_of_a_text_need_no_exchange_by_key(spark):
    for name in ("segment_fallback", "nest_json"):
        plan = catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 0


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("way", ["sentences", "whole", "given"])
def test_segments_in_one_map_are_those_of_the_operators(spark, strict, way, monkeypatch):
    """Texts in slices of a few bytes, runs of several pieces, leading and lone signs, null bounds, spans in any order."""
    monkeypatch.setattr(tx, "SLICE_BYTES", 1)
    rng = random.Random(7)
    rows = []
    for k in range(120):
        text = "".join(rng.choice(["a", "Bc", "½", "ﬁ x", "a¨b", " ", "  ", "\n", ".", "?!", "—", "é", "𝔸", " "]) for _ in range(rng.randint(0, 40)))
        given = sorted((a, a + rng.randint(1, 9)) for a in (rng.randint(-1, 30) for _ in range(rng.randint(0, 6))))
        rows.append((k, text if k % 17 else None, 1.5, None if k % 23 == 5 else 1.5 + len(text) / 3, given))
    texts = spark.createDataFrame(rows, "k int, text string, a double, b double, spans array<struct<start_char:int,end_char:int>>")
    splitter, spans = (None if way == "whole" else "sentences"), ("spans" if way == "given" else None)
    got = pipelines.fallback_segments(texts, ["k"], "a", "b", splitter=splitter, spans_col=spans, strict=strict, digits=9)
    few = pipelines.fallback_segments(texts, ["k"], "a", "b", splitter=splitter, spans_col=spans, strict=strict, digits=9, words=False)
    timed = tokens.interpolate_times(tx.token_map(texts, ["k", "a", "b"], deletions=True), ["k"], "a", "b").drop("a", "b")
    merged = tokens.merge_multitoken(timed, ["k"], carry=["end_char_extended", "text_span_full"])
    if way == "whole":
        own = whole_text_segment(merged, ["k"])
    else:
        own = tx.sentence_spans(texts, ["k"])
        if spans:
            listed = custom_spans(texts, ["k"], spans)
            own = listed.unionByName(own.join(listed.select("k").distinct(), "k", "left_anti"))
    want = encode_segments(segment_words(merged, own, ["k"], strict), ["k"], 9)
    plain = lambda r: (r.k, r.seg_pos, r.start, r.end, r.duration, r.text, r.score)
    near = lambda a, b: len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))
    have, wanted, counted = (df.orderBy("k", "seg_pos").collect() for df in (got, want, few))
    assert len(have) == len(wanted) > 20 and all(near(plain(a), plain(b)) for a, b in zip(have, wanted))
    assert all(len(a.words) == len(b.words) and all(near(tuple(x), tuple(y)) for x, y in zip(a.words, b.words)) for a, b in zip(have, wanted))
    assert [(*plain(r), r.n_words) for r in counted] == [(*plain(r), len(r.words)) for r in have]


def test_locating_moves_no_text(spark):
    """Neither the documents' words nor shingles that no needle has go through an exchange."""
    for name in ("fuzzy_locate", "fuzzy_long"):
        plan = catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan


def test_a_map_over_texts_holds_a_slice_of_them(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"__text": ["a" * k for k in (5, 300, 0, 2000, 7)] + [None, "é" * 400]})
    parts = list(tx.slices(batch, size=500))
    assert [p.num_rows for p in parts] == [3, 1, 2, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    docs = spark.read.parquet(f"{D}/documents.parquet")
    whole = sorted(tx.sentence_spans(docs, ["doc_id"]).collect())
    monkeypatch.setattr(tx, "SLICE_BYTES", 1)
    assert sorted(tx.sentence_spans(docs, ["doc_id"]).collect()) == whole


def test_rules_that_change_nothing_cost_nothing():
    m = tx.SpanMap("one two three")
    lo = m.lo
    assert m.rewrite(r"\s+", " ").lo is lo and m.rewrite("x", "y").lo is lo
    assert m.rewrite("one|two", lambda x: x.group() * 2).tokens() == [("oneone", "one", 0, 3), ("twotwo", "two", 4, 7), ("three", "three", 8, 13)]


def test_times_are_rounded_as_in_sql(spark):
    x = [0.0, 1.234565, 0.285005, 0.003125, 2.5e-6, 7.000005, -1.234565, 123456.123455]
    want = [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 5)").fetchall()[0][0] for v in x]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert [r.r for r in df.select(fr.rounded("v", 5).alias("r")).collect()] == want == fr.half_up(np.array(x), 5).tolist()
    assert [r.r for r in df.select(F.round("v", 5).alias("r")).collect()] != want
