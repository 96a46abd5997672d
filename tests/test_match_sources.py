import json
import random
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext import schema
from chronotext.operators import match
from chronotext.plans import catalog
from chronotext.sources import audio, codec, records


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute(needle, hay):
    if not needle or not hay:
        return None
    if len(needle) > len(hay):
        s = brute(hay, needle)
        return s and (s[0], 0, len(hay))
    m, n = len(needle), len(hay)
    spans = [(0, e) for e in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
    return max(((200 * lcs(needle, hay[a:b]) / (m + b - a), -a, -b) for a, b in spans), key=lambda s: (round(s[0], 9), s[1], s[2]))


def test_partial_ratio_is_the_best_window():
    rng = random.Random(1)
    for _ in range(250):
        needle = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        hay = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 25)))
        got, want = match.partial_ratio(needle, hay), brute(needle, hay)
        if not want or round(want[0], 9) == 0:
            continue
        want = want if len(needle) > len(hay) else (want[0], -want[1], -want[2])
        assert got == (pytest.approx(want[0]), want[1], want[2]), (needle, hay)
    assert match.partial_ratio("", "x") is None and match.partial_ratio("abc", "xyz", 1.0) is None
    assert match.indel_similarity("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_location_in_words():
    words = ["it", "was", "the", "best", "of", "times"]
    ends = np.cumsum([len(w) for w in words])
    hay = "".join(words)
    assert match.locate("thebest", hay, ends) == (2, 3, 100.0)
    assert match.locate("thebets", hay, ends) == (1, 3, pytest.approx(600 / 7))  # of equal windows the leftmost
    assert match.locate("zzzzzz", hay, ends) is None
    assert match.locate_long("itwasthe" + "bestoftimes", hay, ends, max_length=8)[:2] == (0, 5)
    assert match.locate_long("times" + "x" * 10 + "itwas", "itwas" + "x" * 4 + "times", np.array([5, 9, 14]), 55.0, 5) is None
    assert match.locate_long("a" * 600, "a" * 700, np.array([700]))[2] == match.locate_long("a" * 601, "a" * 700, np.array([700]))[2] == 100.0


def test_candidates_and_scores_over_tables(spark):
    d = "/root/testdata/sf0.01"
    found = {(r.item_id, r.doc_id): r for r in catalog.fuzzy_locate(spark, d).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    verbatim = {(i, k) for i, x in items.items() for k, t in docs.items() if x in t}
    assert verbatim and verbatim <= set(found) and all(found[p].score == 100 for p in verbatim)
    for i, k in verbatim:
        r = found[i, k]
        assert "".join(items[i].split()) in "".join(docs[k].split()[r.start_index : r.end_index + 1])


def test_messagepack():
    values = [None, True, False, 0, 127, 128, 255, 256, 65536, 1 << 40, -1, -32, -33, -129, -40000, -(1 << 40), 1.5, "", "é" * 40, "x" * 300, "y" * 70000, b"\x00\x01", [], list(range(20)), {"a": [1, {"b": None}]}, {str(i): i for i in range(20)}]
    for v in values:
        assert codec.loads(codec.dumps(v)) == v
    assert codec.dumps({"a": 1, "b": [True, None, -2.0]}) == bytes.fromhex("82a16101a16293c3c0cbc000000000000000")
    for bad in (b"\xc1", b"\x01\x02", b"\xa5ab"):
        with pytest.raises((ValueError, IndexError)):
            codec.loads(bad)


DOC = {"audio_path": "b/x.wav", "sample_rate": 16000, "duration": 9.5, "metadata": {"k": "v"}, "speeches": [
    {"speech_id": 0, "start": 0.5, "end": 2.5, "text": "Hi you. Bye.", "text_spans": [[0, 8], [8, 12]], "chunks": [{"start": 0.5, "end": 2.5, "audio_frames": 32000}],
     "alignments": [{"start": 0.5, "end": 1.0, "text": "Hi you. ", "words": [{"text": "Hi ", "start": 0.5, "end": 0.7, "score": 0.9}, {"text": "you. ", "start": 0.7, "end": 1.0, "score": 0.8}], "id": "0-0", "score": 0.85}]},
    {"speech_id": None, "start": None, "end": None, "text": None},
]}


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(json.dumps(DOC, indent=1))
    files = records.read_json(spark, str(tmp_path / "in"))
    speeches = schema.speeches_of(files)
    got = {r.speech_pos: r for r in speeches.collect()}
    assert got[0].speech_id == "0" and got[1].speech_id == "1" and got[0].duration == 2.0 and got[0].text_spans[1].start_char == 8
    segs = schema.segments_of(speeches)
    assert segs.first().duration == 0.5 and [r.text for r in schema.words_of(segs).orderBy("word_pos").collect()] == ["Hi ", "you. "]
    chunks = schema.chunks_of(speeches)
    assert chunks.first().duration == 2.0
    back = schema.nest(speeches, segments=segs, chunks=chunks)
    assert schema.segments_of(schema.speeches_of(back)).collect() == segs.collect()
    records.write_json(files, str(tmp_path / "out"))
    records.write_json(files, str(tmp_path / "flat"), indent=None)
    records.write_msgpack(files, str(tmp_path / "out"))
    again = records.read_json(spark, str(tmp_path / "out/b/x.json"))
    assert again.collect() == files.collect() and (tmp_path / "flat/b/x.json").read_text().count("\n") == 0
    (tmp_path / "out/b/bad.msgpack").write_bytes(b"\xc1")
    packed = {Path(r.path).name: r for r in records.read_msgpack(spark, str(tmp_path / "out/b/*.msgpack")).collect()}
    assert packed["x.msgpack"].record == files.select(F.struct("*")).first()[0] and packed["bad.msgpack"].record is None and "c1" in packed["bad.msgpack"].error


def wav(path, seconds, rate=8000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        x = (np.sin(np.arange(int(seconds * rate)) / 20) * 8000).astype("<i2")
        w.writeframes(np.repeat(x, channels).tobytes())


def test_audio(spark, tmp_path):
    wav(tmp_path / "a.wav", 2.0)
    wav(tmp_path / "b.wav", 1.0, 16000, 2)
    (tmp_path / "c.wav").write_bytes(b"no audio")
    files = audio.audio_files(spark, str(tmp_path / "*.wav"))
    got = {Path(r.path).name: (r.duration, r.frames, r.error is None) for r in files.collect()}
    assert got == {"a.wav": (2.0, 32000, True), "b.wav": (1.0, 16000, True), "c.wav": (None, None, False)}
    assert audio.file_records(files).count() == 2
    assert [Path(r.path).name for r in audio.failed(files.select("path"), files.where("error is null"), "path").collect()] == ["c.wav"]
    s = spark.createDataFrame([(str(tmp_path / "a.wav"), 0.5, 1.0), (str(tmp_path / "c.wav"), 0.0, 1.0), (str(tmp_path / "none.wav"), 0.0, 1.0)], "audio_path string, start_sec double, end_sec double")
    parts = audio.read_slices(s).collect()
    assert len(parts[0].samples) == 8000 and parts[1].samples is None and parts[2].error
    whole = audio.decode_wav((tmp_path / "a.wav").read_bytes(), 8000)
    assert np.allclose(audio.read_slice(str(tmp_path / "a.wav"), 0.5, 1.0, 8000), whole[4000:8000])


def test_emissions(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.random((2, 3, 4)).astype(np.float32)
    np.save(tmp_path / "e.npy", a)
    rows = records.read_npy(spark, str(tmp_path / "e.npy"))
    got = {(r.chunk_pos, r.frame): r.probs for r in rows.collect()}
    assert all(np.allclose(got[i, j], a[i, j]) for i in range(2) for j in range(3))
    t = rows.select(F.lit("f").alias("audio_path"), F.lit("s1").alias("speech_id"), "chunk_pos", "frame", "probs")
    where = str(tmp_path / "em")
    again = records.write_emissions(t, where)
    assert np.allclose(records.speech_emissions(again).first().emission, a.reshape(6, 4))
    assert records.speech_emissions(again, by_chunk=True).count() == 2
    records.drop_emissions(spark, where)
    assert not Path(where).exists()
