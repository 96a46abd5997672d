"""Repeated passages by bucket-pointer refinement of suffixes, in buckets of words.

A suffix begins at every word of every document from which min_words words
follow.  Suffixes that agree in min_words words agree in the least-named q-gram
among them, their anchor, so suffixes are exchanged once, by the name of their
anchor and with the words they are compared by: neighbouring suffixes of one
anchor travel as one stretch of text, and equal stretches of a task together.  Within a task the suffixes of all its
anchors are ordered by bucket-pointer refinement: buckets of equal first q-grams
are refined by sorting on the bucket pointers of later offsets, and refined
pointers are written back at once, for the buckets that come next.  Neighbours in
that order are then compared word by word.

An anchor whose stretches hold too many words for one task (counted before, in
bounded memory) takes another way: its suffixes are grouped one by one by a
128-bit name of their words, which Spark combines before it exchanges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm._kernels import IS_WORD, U64, Words, gram_starts, mix, ragged_arange, slices, word_grams
from chronotext.llm._spark import written

MIN_WORDS = 50
ANCHOR = 14
#: suffixes of one stretch at most: a text that repeats one anchor for long is cut into several stretches
STRETCH = 1024
#: words of an anchor's stretches beyond which its suffixes are grouped one by one (twice as many at most stay in a task)
HOT_WORDS = 1_000_000
#: anchors that can take that way (8 bytes each on every worker); with more, the least frequent of them stay in their task
MAX_HOT = 1 << 22
#: words that a task orders at a time, unless one anchor has more
CHUNK_WORDS = 400_000
BLOCK = 1 << 16
#: text of stretches that a task holds to send equal ones once
HELD_BYTES = 48 << 20
PLACE = np.dtype([("id", "<i8"), ("begin", "<i4")])


def bucket_pointer_refinement(tokens: np.ndarray, q: int | None = None, depth_limit: int | None = None) -> np.ndarray:
    """Suffix array of one integer sequence: initial q-gram buckets, refined by the bucket pointers of later offsets.

    A suffix that ends sorts before one that goes on.  The pointer of a suffix is
    the last place of its bucket.  Each round sorts the suffixes of unfinished
    buckets by the pointers `depth` further on; it takes the buckets in blocks and
    writes each block's refined pointers back before the next is sorted, so later
    blocks, and the next round, reach further than `depth`.

    With depth_limit suffixes are ordered by their first depth_limit tokens at
    least; of suffixes that agree in so many the order is any.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(rank.max()).bit_length()
    if q is None:
        q = max(1, 62 // bits)
    padded = np.r_[rank, np.zeros(q, np.int64)]
    if q * bits <= 62:
        gram = np.zeros(n, np.int64)
        for j in range(q):
            gram = gram << bits | padded[j : j + n]
        order = np.argsort(gram, kind="stable")
        changed = np.r_[True, gram[order][1:] != gram[order][:-1]]
    else:
        order = np.lexsort([padded[j : j + n] for j in reversed(range(q))])
        changed = np.zeros(n, bool)
        for j in range(q):
            k = padded[j : j + n][order]
            changed[1:] |= k[1:] != k[:-1]
        changed[0] = True
    pointer = np.empty(n + 1, np.int64)
    pointer[n] = -1

    def write(places: np.ndarray, new: np.ndarray) -> None:
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(places)])
        pointer[order[places]] = np.repeat(places[first + size - 1], size)

    write(np.arange(n), changed)
    depth = q
    while depth_limit is None or depth < depth_limit:
        at = pointer[order]
        alone = np.ones(n, bool)
        alone[1:] &= at[1:] != at[:-1]
        alone[:-1] &= at[:-1] != at[1:]
        unfinished = np.flatnonzero(~alone)
        if not len(unfinished):
            break
        begins = np.flatnonzero(np.r_[True, at[unfinished][1:] != at[unfinished][:-1]])
        lo = 0
        while lo < len(unfinished):
            k = int(np.searchsorted(begins, lo + BLOCK))
            hi = int(begins[k]) if k < len(begins) else len(unfinished)
            places = unfinished[lo:hi]
            suffix = order[places]
            key = at[places] * (n + 1) + pointer[np.minimum(suffix + depth, n)] + 1
            s = np.argsort(key, kind="stable")
            key = key[s]
            order[places] = suffix[s]
            write(places, np.r_[True, key[1:] != key[:-1]])
            lo = hi
        depth *= 2
    return order


def least_of_windows(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window of `window` q-grams the least name in it."""
    n = len(grams) - window + 1
    if n <= 0:
        return grams[:0]
    # least of blocks that double in length: two overlapping blocks cover a window
    least, size = grams, 1
    while size * 2 <= window:
        least = np.minimum(least[size:], least[: len(least) - size])
        size *= 2
    rest = window - size
    return np.minimum(least[:n], least[rest : rest + n])


class _Stretches:
    """Suffixes of the texts of one piece, in runs of neighbours with one anchor; begins, ends: of each run's suffixes, as words of the piece."""

    def __init__(self, texts: pa.Array, min_words: int, q: int):
        self.words = w = Words(texts)
        self.begins = self.ends = self.text = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, U64)
        if len(w) < min_words:
            return
        self.hashes = w.hashes()
        grams = word_grams(self.hashes, q)
        anchor = least_of_windows(grams, min_words - q + 1)
        at = np.flatnonzero(gram_starts(w.first, min_words)[: len(anchor)])
        if not len(at):
            return
        owner = w.text_of_word()[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (owner[1:] != owner[:-1])
        run = np.flatnonzero(new)
        inside = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        run = np.flatnonzero(inside % STRETCH == 0)
        self.begins, self.ends = at[run], at[np.r_[run[1:], len(at)] - 1] + 1
        self.anchor, self.text = anchor[at[run]], owner[run]
        self.grams, self.reach = grams, min_words - q

    def twice(self, r: np.ndarray) -> np.ndarray:
        """Whether the anchor lies twice in a stretch, so that two of its own suffixes could be alike."""
        size = self.ends[r] - self.begins[r] + self.reach
        first = np.r_[0, np.cumsum(size)[:-1]]
        at = np.repeat(self.begins[r] - first, size) + np.arange(int(size.sum()))
        return np.add.reduceat((self.grams[at] == np.repeat(self.anchor[r], size)).astype(np.int32), first) > 1


def _counter(min_words: int, q: int, least: float):
    """Words of each anchor's stretches in the task's rows; of anchors with fewer than `least` nothing is handed on."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        name, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return name, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(name)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = np.zeros(0, U64), np.zeros(0, np.int64)
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 22):
                s = _Stretches(piece.column("text"), min_words, q)
                parts.append(added([(s.anchor, s.ends - s.begins + min_words - 1)]))
                held += len(parts[-1][0])
                if held > max(len(name), 1 << 19):
                    name, n = added([(name, n), *parts])
                    parts, held = [], 0
        name, n = added([(name, n), *parts])
        often = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(name[often].view(np.int64)), pa.array(n[often])], names=["anchor", "n"])

    return count


def _among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which names are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(names), bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def _emitter(min_words: int, q: int, hot, within: bool):
    def pack(found: dict[tuple[int, bytes], list[bytes]], twice: set[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        keys = list(found)
        for lo in range(0, len(keys), 4096):
            some = keys[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([k[0] for k in some], U64).view(np.int64)),
                    pa.array([b"".join(found[k]) for k in some], pa.binary()),
                    pa.array([k in twice for k in some], pa.bool_()),
                    pa.array([k[1] for k in some], pa.binary()),
                ],
                names=["anchor", "places", "twice", "words"],
            )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of anchors that aren't hot: equal ones once, with the places they begin at."""
        known = hot.value
        found: dict[tuple[int, bytes], list[bytes]] = {}
        twice: set[tuple[int, bytes]] = set()
        held = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                s = _Stretches(piece.column("text"), min_words, q)
                w = s.words
                live = np.flatnonzero(~_among(s.anchor, known))
                if not len(live):
                    continue
                # words with one space between
                word = IS_WORD[w.data]
                keep = word | np.r_[False, word[:-1]]
                data = np.where(word, w.data, np.uint8(32))[keep].tobytes()
                at = np.r_[0, np.cumsum(keep)]
                a, b = at[w.start[s.begins[live]]], at[w.end[s.ends[live] + min_words - 2]]
                ids = pc.fill_null(piece.column("id"), 0).to_numpy(zero_copy_only=False)[s.text[live]]
                places = np.rec.fromarrays([ids, s.begins[live] - w.first[s.text[live]]], dtype=PLACE).tobytes()
                again = s.twice(live).tolist() if within else [False] * len(live)
                for k, (name, x, y) in enumerate(zip(s.anchor[live].tolist(), a.tolist(), b.tolist())):
                    key = (name, data[x:y])
                    found.setdefault(key, []).append(places[12 * k : 12 * k + 12])
                    if again[k]:
                        twice.add(key)
                held += int((b - a).sum())
                if held > HELD_BYTES:
                    yield from pack(found, twice)
                    found, twice, held = {}, set(), 0
        yield from pack(found, twice)

    return emit


def _namer(min_words: int, q: int, hot):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each suffix of a hot anchor with a 128-bit name of its min_words words."""
        known = hot.value
        for batch in batches:
            for piece in slices(batch, "text"):
                s = _Stretches(piece.column("text"), min_words, q)
                r = np.flatnonzero(_among(s.anchor, known))
                if not len(r):
                    continue
                size = s.ends[r] - s.begins[r]
                row = np.repeat(np.arange(len(r)), size)
                at = np.repeat(s.begins[r] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
                names = [word_grams(h, min_words)[at].view(np.int64) for h in (s.hashes, mix(s.hashes + U64(0x632BE59BD9B4E019)))]
                begin = at - s.words.first[s.text[r]][row]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, names), piece.column("id").take(pa.array(s.text[r][row])), pa.array(begin.astype(np.int32))], names=["a", "b", "id", "start"]
                )

    return emit


def repeating(rows: pa.RecordBatch, min_words: int, within: bool) -> pa.RecordBatch | None:
    """Spans (id, start, end) of the suffixes of whole buckets of stretches that occur at two places."""
    anchor, text = rows.column("anchor").to_numpy(), rows.column("words")
    count = np.diff(np.frombuffer(rows.column("places").buffers()[1], np.int32)[rows.column("places").offset :][: len(anchor) + 1]) // PLACE.itemsize
    order = np.argsort(anchor, kind="stable")
    first = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    # a bucket of one stretch at one place holds nothing that repeats, unless that stretch repeats itself
    many = np.add.reduceat(count[order], first) > 1
    live = order[np.repeat(many, np.diff(np.r_[first, len(order)]))]
    if within:
        live = np.union1d(live, np.flatnonzero(rows.column("twice").to_numpy(zero_copy_only=False)))
    if not len(live):
        return None
    place = np.frombuffer(b"".join(rows.column("places").take(pa.array(live)).to_pylist()), PLACE)
    count = count[live]
    w = Words(text.take(pa.array(live)).cast(pa.large_binary()), lowered=True)
    word = w.strings().dictionary_encode().indices.to_numpy().astype(np.int64)
    suffixes = np.diff(w.first) - (min_words - 1)
    row = np.repeat(np.arange(len(live)), suffixes)
    step = ragged_arange(suffixes)
    number = np.full(len(word), -1, np.int64)
    number[w.first[row] + step] = np.arange(len(row))
    at = bucket_pointer_refinement(word, depth_limit=min_words)
    at = at[number[at] >= 0]
    # neighbours that agree in min_words words, compared word by word
    same = np.arange(1, len(at))
    for j in range(min_words):
        same = same[word[at[same] + j] == word[at[same - 1] + j]]
        if not len(same):
            break
    new = np.ones(len(at), bool)
    new[same] = False
    group = np.flatnonzero(new)
    own = number[at]
    # the least and the greatest (id, begin) of each class of equal suffixes
    edge = np.r_[0, np.cumsum(count)[:-1]]
    low, high = (f.reduceat(place["id"], edge) for f in (np.minimum, np.maximum))
    repeats = np.minimum.reduceat(low[row[own]], group) != np.maximum.reduceat(high[row[own]], group)
    if within:
        low, high = (f.reduceat(place["begin"], edge) for f in (np.minimum, np.maximum))
        repeats |= np.minimum.reduceat((low[row] + step)[own], group) != np.maximum.reduceat((high[row] + step)[own], group)
    hit = np.zeros(len(row), bool)
    hit[own] = np.repeat(repeats, np.diff(np.r_[group, len(at)]))
    if not hit.any():
        return None
    opens = hit & ~(np.r_[False, hit[:-1]] & (step > 0))
    closes = hit & ~(np.r_[hit[1:], False] & np.r_[step[1:] > 0, False])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    # each span at each of its stretch's places
    times = count[row[a]]
    span = np.repeat(np.arange(len(a)), times)
    where = place[np.repeat(edge[row[a]], times) + ragged_arange(times)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(where["id"])), pa.array((where["begin"] + step[a][span]).astype(np.int32)), pa.array((where["begin"] + step[b][span] + min_words).astype(np.int32))],
        names=["id", "start", "end"],
    )


def _sorter(min_words: int, within: bool, chunk_words: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of one partition, ordered by anchor: whole buckets are ordered a chunk at a time."""
        held: list[pa.RecordBatch] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, waiting = [], 0
            out = repeating(rows[0], min_words, within) if rows else None
            if out is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            text = batch.column("words")
            upto = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + batch.num_rows + 1].astype(np.int64) // 6
            size = upto[1:] - upto[0]
            if held and held[-1].column("anchor")[-1].as_py() != anchor[0] and waiting > chunk_words:
                yield from flush()
            lo = before = 0
            while len(change):
                full = int(np.searchsorted(size, before + chunk_words - waiting, side="right"))
                k = int(np.searchsorted(change, max(full, lo + 1)))
                if k == len(change):
                    break
                hi = int(change[k])
                held.append(batch.slice(lo, hi - lo))
                yield from flush()
                lo, before = hi, int(size[hi - 1])
            held.append(batch.slice(lo))
            waiting += int(size[-1]) - before
        if held:
            yield from flush()

    return sort


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    anchor: int = ANCHOR,
    within: bool = False,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): passages of at least min_words words that another document has too.

    within: passages that begin at two places of one document are reported as well.

    Words are runs of letters and digits of the lower-cased text, counted from 0
    in each document; end_word is exclusive.  Overlapping and touching passages
    of a document are one row.  Every place of every document is a suffix and
    every passage is compared with every other: there is no cap on how often a
    passage occurs.  Words are compared as they are, but for suffixes of anchors
    of more than hot_words words, which are compared by 128-bit names.

    Unless `within`, a passage that repeats in one document only isn't reported.  Null ids and
    null texts, and texts of fewer words, have no rows.  Repeated rows of one id
    are one document and don't repeat each other.  Ties and copies of any number are
    all reported.  Empty tables give no rows; other columns are ignored.
    """
    if not 0 < anchor < min_words:
        raise ValueError("0 < anchor < min_words")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # an anchor of more than 2 * hot_words words has hot_words in tasks with a tasks' share of that many each
    least = hot_words / max(1, base.rdd.getNumPartitions())
    counts = base.mapInArrow(_counter(min_words, anchor, least), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") > hot_words).orderBy(F.desc("n"), "anchor").limit(MAX_HOT).select("anchor").toArrow()
    hot = np.sort(often.column("anchor").to_numpy().astype(np.int64).view(U64))
    sent = spark.sparkContext.broadcast(hot)
    stretches = base.mapInArrow(_emitter(min_words, anchor, sent, within), "anchor long, places binary, twice boolean, words binary")
    together = stretches.repartition("anchor").sortWithinPartitions("anchor")
    runs = together.mapInArrow(_sorter(min_words, within, CHUNK_WORDS), "id long, start int, end int")
    if len(hot):
        named = written(base.mapInArrow(_namer(min_words, anchor, sent), "a long, b long, id long, start int"), "suffix-names")
        place = F.struct("id", "start")
        ends = named.groupBy("a", "b").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        repeated = ends.where("low <> high" if within else "low.id <> high.id").select("a", "b")
        runs = runs.union(named.join(repeated, ["a", "b"], "left_semi").select("id", "start", (F.col("start") + min_words).alias("end")))
    w = Window.partitionBy("id").orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("fresh", F.when(F.col("start") > upto, 1).when(upto.isNull(), 1).otherwise(0))
    groups = marked.withColumn("part", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = groups.groupBy("id", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return spans.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
