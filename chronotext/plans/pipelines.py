"""Entry points: activity, emissions, alignment, and all of them; lazy plans over DataFrames, nothing is written between stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions.frames import output_logits, seconds_to_frames
from chronotext.functions.text import SENTENCE, sentence_spans, sentences_of, token_map, token_map_with
from chronotext.operators import fallback
from chronotext.operators.ctc import align_words, frames_over_logits, frames_per_logit, word_time
from chronotext.operators.intervals import detect_in_files, detect_in_speeches
from chronotext.operators.segments import custom_spans, encode_segments, segment_id, segment_words, whole_text_segment
from chronotext.operators.tokens import extend_over_deletions, interpolate_times, merge_multitoken

__all__ = ["SENTENCE", "vad", "emissions", "align", "fallback_lists", "fallback_segments", "pipeline"]

#: frames of samples to a matrix of probabilities (frames x vocabulary)
Scorer = Callable[[list[np.ndarray]], list[np.ndarray]]


def vad(scores: DataFrame, speeches: DataFrame | None = None, chunk_size: float = 30.0, onset: float = 0.5, offset: float | None = None, file_key: str = "audio_path", speech_key: str = "speech_id") -> tuple[DataFrame, DataFrame]:
    """(speeches, chunks) from activity scores (file, ts, score), in whole files or within given speeches; chunks have audio_frames."""
    if speeches is None:
        s, c = detect_in_files(scores, file_key, chunk_size, onset, offset)
    else:
        s, c = detect_in_speeches(speeches, scores, file_key, speech_key, chunk_size, onset, offset)
    return s, c.withColumn("audio_frames", seconds_to_frames(F.col("end") - F.col("start")))


def emissions(slices: DataFrame, scorer: Scorer, keys: Sequence[str], samples_col: str = "samples", batch_rows: int = 8) -> DataFrame:
    """Frames of each slice by a model: keys, frame, probs. The scorer gets batch_rows slices at a time; slices without samples are left out."""
    names = list(keys)
    slim = slices.where(F.col(samples_col).isNotNull()).select(*names, F.col(samples_col).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_rows):
                part = batch.slice(lo, batch_rows)
                found = [np.asarray(p, np.float32) for p in scorer([np.asarray(x, np.float32) for x in part.column("__x").to_pylist()])]
                size = np.array([len(p) for p in found])
                row = np.repeat(np.arange(len(found)), size)
                frame = np.concatenate([np.arange(n) for n in size]) if len(size) else size
                width = np.repeat([p.shape[1] if p.ndim > 1 else 1 for p in found], size) if len(size) else size
                flat = np.concatenate([p.ravel() for p in found]) if len(found) else np.zeros(0, np.float32)
                probs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)].astype(np.int32)), pa.array(flat, pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in names), pa.array(frame.astype(np.int32)), probs], names=[*names, "frame", "probs"])

    schema = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in names), "frame int, probs array<float>"])
    return slim.mapInArrow(run, schema)


def _spans(texts: DataFrame, tokens: DataFrame, keys: list[str], text_col: str, splitter: Callable | str | None, spans_col: str | None) -> DataFrame:
    """Given spans where there are any, else the splitter's, else one span."""
    if splitter is None:
        rest = whole_text_segment(tokens, keys)
    else:
        rest = sentence_spans(texts, keys, text_col, sentences_of if splitter == "sentences" else splitter)
    if spans_col is None:
        return rest
    given = custom_spans(texts, keys, spans_col)
    return given.unionByName(rest.join(given.select(*keys).distinct(), keys, "left_anti"))


def _segments(words: DataFrame, texts: DataFrame, keys: list[str], text_col: str, splitter, spans_col: str | None, strict: bool, digits: int) -> DataFrame:
    merged = merge_multitoken(words, keys, carry=["end_char_extended", "text_span_full"])
    spans = _spans(texts, merged, keys, text_col, splitter, spans_col)
    return encode_segments(segment_words(merged, spans, keys, strict), keys, digits)


def fallback_lists(texts: DataFrame, keys: Sequence[str], start: Column | str, end: Column | str, text_col: str = "text", splitter: Callable | str | None = "sentences", spans_col: str | None = None, strict: bool = True, digits: int = 5, words: bool = True) -> DataFrame:
    """keys and segments: the list of each row's segments with word times interpolated over [start, end].

    One map over the rows without an exchange; a row is a text of its own.
    Without `words` segments have n_words in place of them.
    """
    at = [F.col(c) if isinstance(c, str) else c for c in (start, end)]
    bounded = texts.withColumn("__from", at[0]).withColumn("__to", at[1])
    return fallback.fallback_lists(bounded, keys, "__from", "__to", text_col, sentences_of if splitter == "sentences" else splitter, spans_col, strict, digits, words)


def fallback_segments(texts: DataFrame, keys: Sequence[str], start: Column | str, end: Column | str, text_col: str = "text", splitter: Callable | str | None = "sentences", spans_col: str | None = None, strict: bool = True, digits: int = 5, words: bool = True) -> DataFrame:
    """Segments with word times interpolated over [start, end]: the path of texts that can't be aligned.

    fallback_lists() with a row per segment: no exchange either.
    """
    lists = fallback_lists(texts, keys, start, end, text_col, splitter, spans_col, strict, digits, words)
    return lists.select(*keys, F.inline("segments"))


def align(
    units: DataFrame,
    emission: DataFrame,
    vocab: Mapping[str, int],
    keys: Sequence[str] = ("audio_path", "speech_id"),
    strategy: str = "speech",
    rules: Sequence | None = None,
    splitter: Callable | str | None = "sentences",
    spans_col: str | None = None,
    blank: int = 0,
    boundary: str = "|",
    case: str = "lower",
    start_wildcard: bool = False,
    end_wildcard: bool = False,
    chunk_size: float = 30.0,
    strict: bool = True,
    digits: int = 5,
    chunks: DataFrame | None = None,
    objective: str = "sum_prob",
) -> DataFrame:
    """Segments with aligned word times: keys, [chunk_pos], seg_pos, id, start, end, duration, text, score, words.

    units: keys, text, start, end, audio_frames, with strategy "chunk" also
    chunk_pos and num_logits.  emission: keys, [chunk_pos], emission (array of
    frames).  Frames of a unit with audio_frames null come from `chunks`.  Units
    without text are left out; where the text is too long for the frames, times
    are interpolated.
    """
    if strategy not in ("speech", "chunk"):
        raise ValueError("strategy is speech or chunk")
    speech = list(keys)
    keys = [*speech, "chunk_pos"] if strategy == "chunk" else speech
    units = units.where(F.length("text") > 0)
    if rules is None:
        tokens = token_map(units, keys, "text", deletions=True)
    else:
        sized = units.withColumn("__len", F.length("text"))
        tokens = extend_over_deletions(token_map_with(sized, rules, [*keys, "__len"], "text"), keys, "__len").drop("__len")
        whole = units.select(*keys, F.col("text").alias("__text"))
        tokens = tokens.join(whole, keys).withColumn("text_span_full", F.expr("substring(__text, start_char + 1, end_char_extended - start_char)")).drop("__text")
    words = tokens.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_pos", "normalized_token"))), lambda x: x.normalized_token).alias("words"))
    frames = emission
    if strategy == "chunk":
        frames = emission.join(units.select(*keys, "num_logits"), keys).withColumn("emission", F.slice("emission", 1, F.coalesce(F.col("num_logits").cast("int"), F.size("emission"))))
    found = align_words(words.join(frames.select(*keys, "emission"), keys), keys, vocab, blank=blank, boundary=boundary, case=case, start_wildcard=start_wildcard, end_wildcard=end_wildcard, objective=objective)
    if chunks is not None:
        rate = frames_per_logit(chunks, speech, chunk_size, "speech_frames" if "speech_frames" in chunks.columns else None)
    else:
        rate = units.groupBy(*speech).agg(frames_over_logits(F.sum("audio_frames"), F.sum(output_logits("audio_frames", chunk_size))).alias("frames_per_logit"))
    bounds = units.select(*keys, F.col("start").alias("__a"), F.col("end").alias("__b"))
    shift = int(start_wildcard)
    good = found.where("aligned").join(rate, speech).join(bounds, keys)
    good = good.select(*keys, (F.col("tok_pos") - shift).alias("tok_pos"), word_time("start_frame", "frames_per_logit", F.col("__a")).alias("start_time"), word_time("end_frame", "frames_per_logit", F.col("__a")).alias("end_time"), "score")
    timed = tokens.join(good, [*keys, "tok_pos"])
    if end_wildcard:  # the wildcard's place bounds what follows the last word
        last = timed.groupBy(*keys).agg(F.max("tok_pos").alias("__last"))
        timed = timed.join(last, keys)
        ext = F.when(F.col("tok_pos") == F.col("__last"), F.col("end_char") + 1).otherwise(F.col("end_char_extended"))
        timed = timed.withColumn("end_char_extended", ext).withColumn("text_span_full", F.expr("substring(text_span_full, 1, end_char_extended - start_char)")).drop("__last")
    poor = tokens.join(found.where("not aligned").select(*keys), keys).join(bounds, keys)
    rest = interpolate_times(poor, keys, "__a", "__b").drop("__a", "__b")
    segments = _segments(timed.unionByName(rest), units, keys, "text", splitter, spans_col, strict, digits)
    return segments.withColumn("id", segment_id(speech[-1], *(["chunk_pos"] if strategy == "chunk" else []), "seg_pos"))


def pipeline(scores: DataFrame, texts: DataFrame, samples: Callable[[DataFrame], DataFrame], scorer: Scorer, vocab: Mapping[str, int], chunk_size: float = 30.0, **options) -> DataFrame:
    """Activity -> emissions -> alignment of one text per file, in one lazy plan.

    texts: audio_path, text.  samples: from slices (audio_path, speech_id,
    chunk_pos, start, end) to the same with samples.
    """
    speeches, chunks = vad(scores, chunk_size=chunk_size)
    keys = ["audio_path", "speech_id"]
    frames = emissions(samples(chunks), scorer, [*keys, "chunk_pos"])
    stacked = frames.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_pos", "frame", "probs"))), lambda x: x.probs).alias("emission"))
    units = speeches.join(texts, "audio_path").withColumn("audio_frames", F.lit(None).cast("long"))
    return align(units, stacked, vocab, keys, chunks=chunks, chunk_size=chunk_size, **options)
