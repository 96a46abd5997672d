import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators import intervals as iv


def machine(ts, ys, onset, offset, longest=float("inf")):
    """The state machine told sign by sign."""
    start, on, out = ts[0], ys[0] > onset, []
    sc, st = [ys[0]], [ts[0]]
    for t, y in zip(ts[1:], ys[1:]):
        if on:
            if t - start > longest:
                half = len(sc) // 2
                k = half + min(range(len(sc) - half), key=lambda i: sc[half + i])
                out.append((start, st[k]))
                start, sc, st = st[k], sc[k + 1 :], st[k + 1 :]
            elif y < offset:
                out.append((start, t))
                start, on, sc, st = t, False, [], []
            sc.append(y)
            st.append(t)
        elif y > onset:
            start, on = t, True
    if on:
        out.append((start, ts[-1]))
    return out


def series(spark, n, seed):
    rng = random.Random(seed)
    data = {}
    for k in range(n):
        size = rng.randint(2, 60)
        data[k] = ([float(i) for i in range(size)], [rng.random() if rng.random() < 0.5 else rng.choice([0.1, 0.4, 0.5, 0.6, 0.9]) for _ in range(size)])
    rows = [(k, t, y) for k, (ts, ys) in data.items() for t, y in zip(ts, ys)]
    return data, spark.createDataFrame(rows, "k int, ts double, score double").repartition(3)


def collected(df, *cols):
    out = {}
    for r in df.orderBy("k", *cols[:1]).collect():
        out.setdefault(r.k, []).append(tuple(r[c] for c in cols[1:]))
    return out


@pytest.mark.parametrize("onset,offset", [(0.5, None), (0.6, 0.4), (0.5, 0.0)])
def test_hysteresis_is_the_machine(spark, onset, offset):
    data, df = series(spark, 300, 1)
    want = {k: m for k, (ts, ys) in data.items() if (m := machine(ts, ys, onset, offset or onset))}
    assert collected(iv.hysteresis_regions(df, ["k"], onset=onset, offset=offset), "region", "start", "end") == want
    with pytest.raises(ValueError):
        iv.hysteresis_regions(df, ["k"], onset=0.4, offset=0.6)


@pytest.mark.parametrize("onset,offset,longest", [(0.5, None, 5.0), (0.6, 0.4, 3.0), (0.4, 0.6, 9.0), (0.1, 0.05, 1.0)])
def test_mincut_is_the_machine(spark, onset, offset, longest):
    data, df = series(spark, 200, 2)
    want = {k: m for k, (ts, ys) in data.items() if (m := machine(ts, ys, onset, offset or onset, longest))}
    assert collected(iv.mincut_regions(df, ["k"], onset=onset, offset=offset, max_duration=longest), "region", "start", "end") == want


def united(spans, on, off, gap, least):
    x = sorted((a - on, b + off) for a, b in spans)
    if on or off or gap:
        out = []
        for a, b in x:
            if out and (a <= out[-1][1] or a - out[-1][1] < gap):
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        x = out
    return [(a, b) for a, b in x if not least or b - a >= least]


@pytest.mark.parametrize("p", [(0, 0, 0, 0), (1, 2, 0, 0), (0, 0, 3, 0), (0, 0, 0, 4), (1, 0, 2, 5)])
def test_merging(spark, p):
    rng = random.Random(3)
    data = {k: [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 12)))] for k in range(200)}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, v in data.items() for a, b in v], "k int, start double, end double")
    got = {k: sorted(v) for k, v in collected(iv.merge_intervals(df, ["k"], *map(float, p)), "start", "start", "end").items()}
    want = {k: w for k, v in data.items() if (w := sorted(united(v, *p)))}
    assert got == want


def packed(spans, size, mode):
    cur, end, held, out = spans[0][0], spans[0][1] if mode == "b" else 0, [], []
    for a, b in spans:
        if b - cur > size and end - cur > 0:
            out.append((cur, end, held))
            cur, held = a, []
        end = b
        held = held + [(a, b)]
    return [*out, (cur, end, held)]


@pytest.mark.parametrize("mode", ["a", "b"])
def test_packing(spark, mode):
    rng = random.Random(4)
    data = {0: [(0.5, 10.0), (12.0, 29.0), (31.0, 40.0)], 1: [(0.0, 50.0), (51.0, 55.0)]}
    for k in range(2, 150):
        at, v = rng.random() * 3, []
        for _ in range(rng.randint(1, 15)):
            end = at + rng.random() * 15
            v.append((at, end))
            at = end + rng.random() * 5
        data[k] = v
    df = spark.createDataFrame([(k, a, b) for k, v in data.items() for a, b in v], "k int, start double, end double").orderBy(F.rand(1))
    got = {}
    for r in iv.pack_chunks(df, ["k"], 30.0, mode).orderBy("k", "chunk_pos").collect():
        got.setdefault(r.k, []).append((r.start, r.end, [tuple(s) for s in r.segments]))
    assert got == {k: packed(v, 30.0, mode) for k, v in data.items()}
    assert [c[:2] for c in got[0]] == [(0.5, 29.0), (31.0, 40.0)]
    assert len(got[1]) == (3 if mode == "b" else 2)
    assert iv.pack_chunks(df.limit(0), ["k"]).count() == 0


def test_activity_in_speeches(spark):
    scores = spark.createDataFrame([("f", i / 2, 0.9 if i % 10 < 6 else 0.1) for i in range(100)], "audio_path string, ts double, score double")
    speeches = spark.createDataFrame([("f", "x", 0.0, 20.0, 20.0), ("f", "y", 20.0, None, None), ("f", "z", 400.0, 500.0, 100.0)], "audio_path string, speech_id string, start double, end double, duration double")
    filled, chunks = iv.detect_in_speeches(speeches, scores, "audio_path", "speech_id", 8.0)
    own = {r.speech_id: r for r in filled.collect()}
    assert (own["x"].start, own["x"].end) == (0.0, 20.0) and own["z"].duration == 100.0
    ends = {r.speech_id: (r.a, r.b) for r in chunks.groupBy("speech_id").agg(F.min("start").alias("a"), F.max("end").alias("b")).collect()}
    assert set(ends) == {"x", "y"} and (own["y"].start, own["y"].end) == ends["y"] and own["y"].duration == ends["y"][1] - ends["y"][0]
    s, c = iv.detect_in_files(scores, "audio_path", 8.0)
    assert s.first().start == 0.0 and c.count() == 5


def test_stream_of_regions(spark, tmp_path):
    from chronotext.streaming.regions import stream_regions

    src = str(tmp_path / "in")
    rows = [(k, i, 0.9 if (i // 5) % 2 == 0 else 0.1) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, score double").select("k", F.timestamp_seconds(F.col("i") + 1_000_000).alias("ts"), "score")
    df.where("ts < timestamp_seconds(1000020)").coalesce(1).write.parquet(src)
    df.where("ts >= timestamp_seconds(1000020)").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_regions(stream, "k").writeStream.format("memory").queryName("regions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r.k, int(r.start.timestamp()) % 1000, int(r.end.timestamp()) % 1000) for r in spark.table("regions").collect())
    finally:
        q.stop()
    want = iv.hysteresis_regions(df.withColumn("ts", F.unix_micros("ts") / 1e6), ["k"])
    assert got == sorted((r.k, int(r.start) % 1000, int(r.end) % 1000) for r in want.collect())
