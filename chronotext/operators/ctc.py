"""Forced alignment of token sequences to per-frame score vectors: a max-plus dynamic programme over connectionist states.

Scores are probabilities and the path maximizes their sum (objective "sum_prob");
"sum_log" maximizes the product instead.  The wildcard has its own column after
the vocabulary with score 0 in every frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.frames import SAMPLE_RATE, let, output_logits


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- columns ---------------------------------------------------------------------------------------------------------------


def target_ids(text: Column | str, vocab: Mapping[str, int], unknown: int, boundary: str = "|") -> Column:
    """Ids of a text's characters; a space is the word boundary, what the vocabulary lacks is unknown."""
    table = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    chars = F.split(F.replace(_col(text), F.lit(" "), F.lit(boundary)), "")
    return F.when(F.length(_col(text)) == 0, F.array().cast("array<int>")).otherwise(F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown)).cast("int")))


def count_repeats(ids: Column | str) -> Column:
    """Neighbouring equal ids: each needs a blank between."""
    ids = _col(ids)
    both = F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return F.aggregate(both, F.lit(0), lambda a, x: a + x)


def alignable(ids: Column | str, frames: Column | str) -> Column:
    """Struct (can_align, frames, length, repeats); an empty target can't be aligned."""
    frames = _col(frames)
    sizes = let(_col(ids), lambda i: F.struct(F.size(i).alias("n"), F.when(F.size(i) > 0, count_repeats(i)).otherwise(F.lit(0)).alias("r")))
    return let(sizes, lambda s: F.struct(((s.n > 0) & (frames >= s.n + s.r)).alias("can_align"), frames.cast("int").alias("frames"), s.n.alias("length"), s.r.alias("repeats")))


def word_time(frame: Column | str, frames_per_logit: Column | str, offset: Column | str = "start", sample_rate: int = SAMPLE_RATE) -> Column:
    """Seconds of a logit's edge in the file."""
    return _col(frame) * _col(frames_per_logit) / F.lit(sample_rate) + _col(offset)


def frames_over_logits(frames: Column, logits: Column) -> Column:
    """Frames to a logit; not a number where there are neither, as in a region of one score."""
    return F.when(logits == 0, F.lit(float("nan"))).otherwise(frames / logits)


def frames_per_logit(chunks: DataFrame, keys: Sequence[str], chunk_size: float = 30.0, speech_frames: str | None = None) -> DataFrame:
    """Per speech: its frames over its logits where its frames are known, else the sums over its chunks; NaN if it has no frames."""
    own = F.first(speech_frames) if speech_frames else F.lit(None).cast("long")
    total = frames_over_logits(F.sum("audio_frames"), F.sum(output_logits("audio_frames", chunk_size)))
    return chunks.groupBy(*keys).agg(own.alias("__f"), total.alias("__t")).select(*keys, F.coalesce(frames_over_logits(F.col("__f"), output_logits("__f", chunk_size)), F.col("__t")).alias("frames_per_logit"))


def best_score(emission: Column | str, ids: Sequence[int], blank: int = 0) -> Column:
    """The best path's score for one fixed target: a fold over the frames on the JVM, without the path.

    emission: array of frames, each an array of scores.  Null if there are fewer
    frames than the target needs.
    """
    ext = [blank]
    for i in ids:
        ext += [i, blank]
    n, low = len(ext), F.lit(float("-inf"))

    def step(acc: Column, frame: Column) -> Column:
        new = []
        for s, label in enumerate(ext):
            p = F.element_at(frame, label + 1).cast("double")
            ways = [F.element_at(acc, s + 1)]
            if s >= 1:
                ways.append(F.element_at(acc, s))
            if s >= 2 and label != blank and label != ext[s - 2]:
                ways.append(F.element_at(acc, s - 1))
            new.append((F.greatest(*ways) if len(ways) > 1 else ways[0]) + p)
        return F.array(*new)

    emission = _col(emission)
    head = F.element_at(emission, 1)
    start = F.array(*[F.element_at(head, ext[s] + 1).cast("double") if s < 2 else low for s in range(n)])
    end = F.aggregate(F.slice(emission, 2, F.greatest(F.size(emission) - 1, F.lit(0))), start, step, lambda a: F.greatest(F.element_at(a, n), F.element_at(a, n - 1)) if n > 1 else F.element_at(a, 1))
    return F.when((F.size(emission) > 0) & (end > low), end)


# --- the path ---------------------------------------------------------------------------------------------------------------


#: cells of moves (frames x states) that are kept at once; beyond that they are computed anew from kept frames
CELLS = 1 << 26


def viterbi(p: np.ndarray, ids: Sequence[int], blank: int = 0, cells: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Label and score of each frame on the best path, or None if there is none.

    States are blank, first id, blank, ...; of equal scores staying wins over
    advancing over skipping a blank, and at the end the last blank wins.  One
    array operation over all states a frame.  A move is one byte; where they
    would be more than `cells`, only every square root of frames is kept and the
    moves between are made again on the way back.
    """
    ids = np.asarray(ids, dtype=np.int64)
    ext = np.full(2 * len(ids) + 1, blank, dtype=np.int64)
    ext[1::2] = ids
    n, t = len(ext), len(p)
    if t == 0:
        return None
    may_skip = np.zeros(n, bool)
    may_skip[2:] = (ext[2:] != blank) & (ext[2:] != ext[:-2])
    low = np.full(2, -np.inf)

    def advanced(a: np.ndarray, k: int, how: np.ndarray) -> np.ndarray:
        """Scores after frame k; how gets the moves into it."""
        before = np.concatenate([low, a])
        best = a.copy()
        how[:] = 0
        one = before[1 : n + 1]
        take = one > best
        best[take], how[take] = one[take], 1
        two = before[:n]
        take = may_skip & (two > best)
        best[take], how[take] = two[take], 2
        return best + p[k, ext]

    step = t if t * n <= (CELLS if cells is None else cells) else max(1, int(np.sqrt(t)))
    a = np.full(n, -np.inf)
    a[: min(2, n)] = p[0, ext[: min(2, n)]]
    kept = [a]
    move = np.zeros((min(step, t), n), np.uint8)
    for k in range(1, t):
        a = advanced(a, k, move[k % step])
        if k % step == 0:
            kept.append(a)
    s = n - 1 if n == 1 or a[n - 1] >= a[n - 2] else n - 2
    if a[s] == -np.inf:
        return None
    states = np.empty(t, np.int64)
    for part in range(len(kept) - 1, -1, -1):
        lo, hi = part * step, min((part + 1) * step, t)
        for k in range(hi - 1, lo - 1, -1):
            states[k] = s
            if k > lo:
                s -= int(move[k - lo, s])
        if part:  # the moves of the part before, and the one from it into this part's first frame
            a = kept[part - 1]
            for k in range(lo - step + 1, lo):
                a = advanced(a, k, move[k - lo + step])
            into = np.zeros(n, np.uint8)
            advanced(a, lo, into)
            s -= int(into[s])
    labels = ext[states]
    return labels, p[np.arange(t), labels]


def label_runs(labels: np.ndarray, scores: np.ndarray, blank: int = 0) -> list[tuple[int, int, int, float]]:
    """(label, first frame, end, mean score) of each run of one label other than blank."""
    if not len(labels):
        return []
    cut = np.flatnonzero(np.diff(labels)) + 1
    return [(int(labels[a]), int(a), int(b), float(np.mean(scores[a:b]))) for a, b in zip(np.r_[0, cut], np.r_[cut, len(labels)]) if labels[a] != blank]


def merge_label_runs(frames: DataFrame, keys: Sequence[str], blank: int = 0) -> DataFrame:
    """label_runs() over rows (keys, frame, label, score): keys, span_pos, label, start, end, score."""
    from chronotext.operators.tokens import run_ids

    spans = run_ids(frames, keys, "frame", ["label"], "__run").groupBy(*keys, "__run").agg(F.first("label").alias("label"), F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.avg("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy("__run")
    return spans.where(F.col("label") != blank).withColumn("span_pos", F.row_number().over(w) - 1).drop("__run")


def unflatten(spans: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Character spans (keys, span_pos, ...) with the word each belongs to: words have (keys, tok_pos, n_chars).

    Each word is expanded to the positions of its characters, so the join is an
    equality on key and position and not a range.
    """
    w = Window.partitionBy(*keys).orderBy("tok_pos")
    first = F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_chars")
    at = words.where("n_chars > 0").withColumn("__first", first).select(*keys, "tok_pos", F.explode(F.sequence(F.col("__first").cast("int"), (F.col("__first") + F.col("n_chars") - 1).cast("int"))).alias("span_pos"))
    return spans.join(at, [*keys, "span_pos"])


def word_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Character spans with tok_pos to words: first frame, end, mean score weighted by length."""
    size = F.col("end") - F.col("start")
    return spans.groupBy(*keys, "tok_pos").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum(F.col("score") * size) / F.sum(size)).alias("score"))


def matrices(frames: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's frames as a matrix, from the column's flat values; none for a null or empty row."""
    outer, gone = frames.offsets.to_numpy(), frames.is_null().to_numpy(zero_copy_only=False)
    inner = frames.values.offsets.to_numpy()
    flat = frames.values.values.to_numpy(zero_copy_only=False)
    for a, b, none in zip(outer.tolist(), outer[1:].tolist(), gone.tolist()):
        yield np.zeros((0, 1)) if none or a == b else flat[inner[a] : inner[b]].astype(np.float64).reshape(b - a, -1)


def align_words(
    utterances: DataFrame,
    keys: Sequence[str],
    vocab: Mapping[str, int],
    words_col: str = "words",
    emission_col: str = "emission",
    blank: int = 0,
    unknown: int | None = None,
    boundary: str = "|",
    case: str = "lower",
    start_wildcard: bool = False,
    end_wildcard: bool = False,
    objective: str = "sum_prob",
) -> DataFrame:
    """Frames of each word: keys, tok_pos, start_frame, end_frame, score, aligned.

    utterances: one row with its words and its frames; the path stays within the
    row, so the plan has no exchange.  Words are folded in case before their
    length is measured.  An utterance that can't be aligned has one row with
    aligned = false and tok_pos -1.  With wildcards "*" is the first or last word.
    """
    if objective not in ("sum_prob", "sum_log"):
        raise ValueError("objective is sum_prob or sum_log")
    names, table = list(keys), dict(vocab)
    unk = table.get("<unk>", max(table.values())) if unknown is None else unknown
    fold = {"lower": str.lower, "upper": str.upper, "mixed": str}[case]

    def one(words: list[str], p: np.ndarray) -> list[tuple]:
        star = p.shape[1]
        p = np.concatenate([p, np.zeros((len(p), 1))], axis=1)
        if objective == "sum_log":
            p = np.log(np.maximum(p, 1e-30))
            p[:, star] = 0.0
        text = [fold(w) for w in words]
        plain = [[table.get(c, unk) for c in w] for w in text]
        joined = [i for k, w in enumerate(plain) for i in ([table[boundary]] if k and boundary in table else []) + w]
        need = len(joined) + sum(a == b for a, b in zip(joined, joined[1:]))
        full = [[star]] * start_wildcard + plain + [[star]] * end_wildcard
        ids = [i for k, w in enumerate(full) for i in ([table[boundary]] if k and boundary in table else []) + w]
        path = viterbi(p, ids, blank) if joined and len(p) >= need else None
        if path is None:
            return [(-1, None, None, None, False)]
        spans = [r for r in label_runs(*path, blank) if r[0] != table.get(boundary, -1)]
        out, at = [], 0
        for k, w in enumerate(full):
            own = spans[at : at + len(w)]
            at += len(w)
            if own:
                length = sum(b - a for _, a, b, _ in own)
                out.append((k, own[0][1], own[-1][2], sum(s * (b - a) for _, a, b, s in own) / length, True))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, (w, p) in enumerate(zip(batch.column("__words").to_pylist(), matrices(batch.column("__emission")))) for r in one(w or [], p)]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(cols[0], pa.int64())) for c in names), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.bool_())],
                names=[*names, "tok_pos", "start_frame", "end_frame", "score", "aligned"],
            )

    slim = utterances.select(*names, F.col(words_col).alias("__words"), F.col(emission_col).alias("__emission"))
    schema = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in names), "tok_pos int, start_frame int, end_frame int, score double, aligned boolean"])
    return slim.mapInArrow(run, schema)
