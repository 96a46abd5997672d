import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.functions import frames as fr
from chronotext.operators import ctc
from chronotext.plans import pipelines
from chronotext.plans.catalog import LETTERS, TARGET


def all_paths(p, ids, blank=0):
    """Best sum over every labelling of the frames that collapses to ids."""
    best = None
    for path in product(range(p.shape[1]), repeat=len(p)):
        short = [k for i, k in enumerate(path) if i == 0 or k != path[i - 1]]
        if [k for k in short if k != blank] == list(ids):
            s = sum(p[t, k] for t, k in enumerate(path))
            best = s if best is None else max(best, s)
    return best


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t, ids = int(rng.integers(1, 7)), rng.integers(1, 3, rng.integers(0, 4)).tolist()
        p = rng.random((t, 3))
        want, got = all_paths(p, ids), ctc.viterbi(p, ids)
        need = len(ids) + sum(a == b for a, b in zip(ids, ids[1:]))
        assert (want is None) == (got is None) == (t < need)
        if got:
            labels, scores = got
            assert scores.sum() == pytest.approx(want)
            assert [r[0] for r in ctc.label_runs(labels, scores)] == ids


def test_ties_stay_then_advance():
    labels, _ = ctc.viterbi(np.ones((4, 2)), [1])
    assert labels.tolist() == [1, 0, 0, 0]


def test_fold_has_the_path_score(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x.embedding).alias("e"))
    for r in e.select("label", "e", ctc.best_score("e", TARGET).alias("s")).collect():
        assert r.s == pytest.approx(ctc.viterbi(np.array(r.e, dtype=float), TARGET)[1].sum(), abs=1e-9)
    few = spark.createDataFrame([([[0.5, 0.5]],), ([],)], "e array<array<double>>")
    assert [r[0] for r in few.select(ctc.best_score("e", [1, 1])).collect()] == [None, None]


def test_feasibility(spark):
    df = spark.createDataFrame([("aab", 4), ("aab", 3), ("", 9), ("a b", 3), ("é?", 2)], "t string, n int")
    ids = ctc.target_ids("t", {k: v for k, v in LETTERS.items() if len(k) == 1}, 28)
    got = [tuple(r.a) for r in df.select(ctc.alignable(ids, "n").alias("a")).collect()]
    assert got == [(True, 4, 3, 1), (False, 3, 3, 1), (False, 9, 0, 0), (True, 3, 3, 0), (False, 2, 2, 1)]


def test_runs_and_words_as_tables(spark):
    rng = np.random.default_rng(2)
    rows, spans, words, want = [], {}, [], {}
    for k in range(40):
        lens = rng.integers(1, 4, 5).tolist()
        ids = rng.integers(1, 4, sum(lens)).tolist()
        labels, scores = ctc.viterbi(rng.random((40, 4)), ids)
        rows += [(k, i, int(a), float(b)) for i, (a, b) in enumerate(zip(labels, scores))]
        spans[k] = ctc.label_runs(labels, scores)
        words += [(k, j, n) for j, n in enumerate(lens)]
        at = 0
        for j, n in enumerate(lens):
            own = spans[k][at : at + n]
            at += n
            size = sum(b - a for _, a, b, _ in own)
            want[k, j] = (own[0][1], own[-1][2], pytest.approx(sum(s * (b - a) for _, a, b, s in own) / size))
    table = ctc.merge_label_runs(spark.createDataFrame(rows, "k int, frame int, label int, score double"), ["k"])
    got = {}
    for r in table.orderBy("k", "span_pos").collect():
        got.setdefault(r.k, []).append((r.label, r.start, r.end, pytest.approx(r.score)))
    assert got == spans
    w = ctc.word_spans(ctc.unflatten(table, spark.createDataFrame(words, "k int, tok_pos int, n_chars int"), ["k"]), ["k"])
    assert {(r.k, r.tok_pos): (r.start, r.end, r.score) for r in w.collect()} == want


def emission(words, wild=(0, 0), noise=0.0, seed=0):
    """Frames that say the words: four frames a letter, one of blank between, noise before and after."""
    rng = np.random.default_rng(seed)
    path = [0] * wild[0]
    for c in "|".join(words):
        path += [0] + [LETTERS.get(c, 28)] * 4
    path += [0] + [0] * wild[1]
    p = np.full((len(path), 29), 0.001) + noise * rng.random((len(path), 29))
    p[np.arange(len(path)), path] = 0.9
    return p


def test_words_are_found_where_they_are_said(spark):
    words = ["hello", "big", "world"]
    p = emission(words, noise=0.05)
    rows = [(1, words, p.tolist()), (2, ["HeLLo", "Big", "wOrld"], p.tolist()), (3, ["much"] * 100, p.tolist()), (4, [], p.tolist()), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, words array<string>, emission array<array<double>>")
    got = {}
    for r in ctc.align_words(df, ["k"], LETTERS).collect():
        got.setdefault(r.k, []).append((r.tok_pos, r.start_frame, r.end_frame, r.aligned))
    assert got[1] == got[2] == [(0, 1, 25, True), (1, 31, 45, True), (2, 51, 75, True)]
    assert got[3] == got[4] == got[5] == [(-1, None, None, False)]
    log = ctc.align_words(df.where("k = 1"), ["k"], LETTERS, objective="sum_log").collect()
    assert [(r.start_frame, r.end_frame) for r in log] == [(1, 25), (31, 45), (51, 75)]


@pytest.mark.parametrize("strategy", ["speech", "chunk"])
def test_alignment_end_to_end(spark, strategy):
    text = "Hello big world. It is (so) far!"
    words = ["hello", "big", "world", "it", "is", "so", "far"]
    p = emission(words, noise=0.02)
    long_text = "too long a text " * 40
    units = [("a.wav", "s", text, 5.0, 9.0, len(p) * 320, 0, len(p)), ("a.wav", "t", long_text.strip(), 1.0, 2.0, len(p) * 320, 0, len(p)), ("a.wav", "u", None, 1.0, 2.0, 320, 0, 1)]
    u = spark.createDataFrame(units, "audio_path string, speech_id string, text string, start double, end double, audio_frames long, chunk_pos int, num_logits int")
    e = spark.createDataFrame([("a.wav", s, 0, p.tolist()) for s in "stu"], "audio_path string, speech_id string, chunk_pos int, emission array<array<double>>")
    if strategy == "speech":
        u, e = u.drop("chunk_pos"), e.drop("chunk_pos")
    got = {r.id: r for r in pipelines.align(u, e, LETTERS, strategy=strategy).collect()}
    mid = "-0" if strategy == "chunk" else ""
    first, second = got[f"s{mid}-0"], got[f"s{mid}-1"]
    assert first.text + second.text == text and [w.text for w in second.words] == ["It ", "is ", "(so) ", "far!"]
    per = len(p) * 320 / fr_logits(len(p) * 320) / 16000
    assert first.start == pytest.approx(5.0 + 1 * per, abs=1e-5) and first.words[0].end == pytest.approx(5.0 + 25 * per, abs=1e-5)
    assert first.score > 0.85 and second.end <= 9.1
    poor = got[f"t{mid}-0"]
    assert poor.score == 0 and (poor.start, poor.end) == (1.0, 2.0) and len(poor.words) == 160
    assert not any(k.startswith("u") for k in got)


def fr_logits(n):
    for k, s in zip(fr.KERNELS, fr.STRIDES):
        n = (n - k) // s + 1
    return n


def test_wildcards_cut_the_last_segment(spark):
    text = "One two. Three four ..."
    p = emission(["one", "two", "three", "four"], wild=(6, 6))
    u = spark.createDataFrame([("f", "s", text, 0.0, 4.0, len(p) * 320)], "audio_path string, speech_id string, text string, start double, end double, audio_frames long")
    e = spark.createDataFrame([("f", "s", p.tolist())], "audio_path string, speech_id string, emission array<array<double>>")
    assert len(pipelines.align(u, e, LETTERS, start_wildcard=True, end_wildcard=True).collect()) == 1
    two = pipelines.align(u, e, LETTERS).orderBy("seg_pos").collect()
    assert [r.text for r in two] == ["One two. ", "Three four ..."]


def test_pipeline_from_scores_to_words(spark):
    words = ["good", "day"]
    p = emission(words)
    scores = spark.createDataFrame([("f", i / 10, 0.9 if 5 <= i <= 40 else 0.0) for i in range(60)], "audio_path string, ts double, score double")
    texts = spark.createDataFrame([("f", "Good day!")], "audio_path string, text string")
    add = lambda chunks: chunks.withColumn("samples", F.array(F.lit(0.0), F.lit(1.0)))
    out = pipelines.pipeline(scores, texts, add, lambda xs: [p for _ in xs], LETTERS).collect()
    assert [r.text for r in out] == ["Good day!"] and out[0].start >= 0.5 and [w.text for w in out[0].words] == ["Good ", "day!"]


def test_frame_arithmetic(spark):
    golden = {1: 1, 400: 1, 719: 1, 720: 2, 16000: 49, 422280: 1319, 448200: 1400, 480000: 1499, 480001: 1500, 960000: 2998}
    df = spark.createDataFrame([(k, v) for k, v in golden.items()] + [(None, None)], "audio_frames long, want long")
    assert all(r.num_logits == r.want for r in fr.with_num_logits(df).collect())
    assert fr.receptive_field() == 400
    assert spark.range(1).select(fr.receptive_field_of(F.lit(None).cast("array<int>"), F.array(F.lit(1)))).first()[0] is None
    t = spark.createDataFrame([(0.0,), (59.9996,), (3600.5,), (36000.0,)], "s double")
    assert [r[0] for r in t.select(fr.timestamp_text("s")).collect()] == ["00:00:00,000", "00:00:59,999", "01:00:00,500", "10:00:00,000"]
    one = spark.createDataFrame([(1, 0.0, 65.0), (2, 3.0, 3.0), (3, None, 4.0)], "k int, start double, end double")
    got = [(r.k, r.slice_pos, r.start_sec, r.end_sec, r.audio_frames) for r in fr.speech_slices(one).collect()]
    assert got == [(1, 0, 0.0, 30.0, 480000), (1, 1, 30.0, 60.0, 480000), (1, 2, 60.0, 65.0, 80000)]
    a = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert a.select(fr.pad_to("x", 4)).first()[0] == [1, 2, 0, 0] and sum(a.select(fr.softmax("x")).first()[0]) == pytest.approx(1)
    with pytest.raises(Exception, match="more values"):
        a.select(fr.pad_exactly("x", 1)).collect()


def test_path_with_few_kept_frames_is_the_same():
    import numpy as np

    from chronotext.operators.ctc import viterbi

    rng = np.random.default_rng(11)
    for t, n in [(1, 1), (7, 2), (40, 6), (400, 190), (90, 30)]:
        p = np.round(rng.random((t, 9)), 1)  # ties on purpose
        ids = rng.integers(1, 9, n)
        whole = viterbi(p, ids)
        kept = viterbi(p, ids, cells=1)
        assert (whole is None) == (kept is None)
        if whole is not None:
            assert (whole[0] == kept[0]).all() and (whole[1] == kept[1]).all()


def test_long_words_of_many_states(spark):
    """More than 255 states on the way back."""
    from chronotext.operators.ctc import align_words

    words = ["abcdefghij" * 6, "klmnopqrst" * 8]
    frames = [[0.1] * 29 for _ in range(900)]
    df = spark.createDataFrame([(1, words, frames), (2, words, None), (3, None, frames)], "k int, words array<string>, emission array<array<float>>")
    vocab = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {"|": 27, "<unk>": 28}
    got = align_words(df, ["k"], vocab).collect()
    assert [(r.k, r.tok_pos, r.aligned) for r in got] == [(1, 0, True), (1, 1, True), (2, -1, False), (3, -1, False)]
