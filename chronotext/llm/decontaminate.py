"""Benchmark passages in documents: q-gram lemma, overlapping diagonal bands, banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm._kernels import IS_WORD, U64, Words, buffers, char_positions, gram_starts, mix, ragged_arange, slices, word_grams

Q = 10
ERROR = 0.08
#: items of fewer bytes are sought word for word, without edits
SHORT = 40
FILTER_BITS = 22
#: bytes of all benchmark texts in one index, at most
MAX_BYTES = 64 << 20
#: (hit, item) pairs that are counted at a time, and alignments that run side by side
EXPANDED, SIDE_BY_SIDE = 1 << 20, 256


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of other signs as one space.

    Returns the bytes, the offset of each text in them, and for each byte its
    place in the lower-cased text.  Each text ends in one space of its own.
    """
    data, off = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(off) - 1
    word = IS_WORD[data]
    prev = np.empty_like(word)
    if len(word):
        prev[0] = False
        prev[1:] = word[:-1]
        cuts = off[:-1]
        prev[cuts[cuts < len(word)]] = False
    keep = word | prev
    out = np.where(word, data, np.uint8(32))[keep]
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(at, off)
    if not n:
        return out, bounds, at
    return out, bounds, at - np.repeat(off[:-1], np.diff(bounds))


def gram_names(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit name for the q bytes from each place on; exact for q <= 8, mixed beyond."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    d = data.astype(U64)
    two = d[:-1] | (d[1:] << U64(8))
    four = two[:-2] | (two[2:] << U64(16)) if len(two) > 2 else two[:0]
    eight = four[:-4] | (four[4:] << U64(32)) if len(four) > 4 else four[:0]
    if q == 8:
        return mix(eight[:n])
    if q > 8:
        return mix(eight[:n] * U64(0xD6E8FEB86659FD93) ^ eight[q - 8 : q - 8 + n])
    return mix((eight if q > 8 else four)[:n] * U64(0xD6E8FEB86659FD93) ^ four[q - 4 : q - 4 + n])


def budget(m: int, q: int = Q, error: float = ERROR) -> int:
    """Edits allowed in an item of m bytes: its share, as far as the lemma still asks for some shared q-grams; none in a short one."""
    return max(0, min(int(m * error), (m - q + 1 - 5) // q)) if m >= SHORT else 0


def bound(m: int, q: int = Q, error: float = ERROR) -> int:
    """Shared q-grams that an occurrence within the edit budget has at least."""
    return m - q + 1 - budget(m, q, error) * q


class Index:
    """q-grams of all benchmark texts, for the workers; items too short for a q-gram by the names of their words."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, error: float = ERROR):
        data, off, _ = normal(pa.array(texts, pa.string()))
        self.q, self.error = q, error
        self.ids, self.items = [], []
        names, item, place, tiny = [], [], [], {}
        for i, a, b in zip(ids, off, off[1:]):
            t = data[a:b].tobytes().strip()
            if not t:
                continue
            k = len(self.ids)
            self.ids.append(i)
            self.items.append(t)
            if len(t) < q:
                tiny.setdefault(t, []).append(k)
                continue
            h = gram_names(np.frombuffer(t, np.uint8), q)
            names.append(h)
            item.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        names = np.concatenate(names) if names else np.zeros(0, U64)
        order = np.argsort(names, kind="stable")
        self.names = names[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int32)
        self.size = np.array([len(t) for t in self.items], dtype=np.int64)
        self.k = np.array([budget(m, q, error) for m in self.size], dtype=np.int64)
        self.least = self.size - q + 1 - self.k * q
        # classes of items by size: (hits, reach): an occurrence of any of them has that many hits within that many bytes
        long = np.flatnonzero(self.size >= q)
        order = long[np.argsort(self.size[long], kind="stable")]
        self.classes = [(int(self.least[c].min()), int((self.size + self.k)[c].max())) for c in np.array_split(order, 12) if len(c)]
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[(self.names >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        #: number of words -> names of items of so many words, in order, and which items they are
        self.tiny: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({t.count(b" ") + 1 for t in tiny}):
            own = [t for t in tiny if t.count(b" ") + 1 == n]
            h = word_grams(Words(pa.array([t.decode() for t in own])).hashes(), n)[::n] if n > 1 else Words(pa.array([t.decode() for t in own])).hashes()
            order = np.argsort(h)
            self.tiny[n] = h[order], [tiny[own[x]] for x in order]


def banded_all(patterns: list[bytes], data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (edits, start, end) of the best place of each pattern in data[begin:end] over its diagonals low..high; both ends are free.

    Cell d of a row is the column of that row on diagonal low + d, so a row costs
    the width of the band, however long the text.  Of equal edits the leftmost
    end wins, of equal ways there substitutions before gaps.  Patterns of like
    sizes are aligned side by side, a row of all of them at a time.
    """
    size = np.array([len(p) for p in patterns], dtype=np.int64)
    out = np.zeros((len(patterns), 3), dtype=np.int64)
    order = np.lexsort([high - low, size])
    for lo in range(0, len(order), SIDE_BY_SIDE):
        own = order[lo : lo + SIDE_BY_SIDE]
        m, width = size[own], high[own] - low[own] + 1
        rows, cells = int(m.max()), int(width.max())
        pattern = np.full((len(own), rows), -2, dtype=np.int16)
        for k, p in enumerate(own):
            pattern[k, : m[k]] = np.frombuffer(patterns[p], np.uint8)
        column = low[own][:, None] + np.arange(rows + cells)
        length = (end - begin)[own][:, None]
        inside = (column >= 0) & (column < length)
        text = np.where(inside, data[np.minimum(begin[own][:, None] + np.clip(column, 0, None), len(data) - 1)], -1).astype(np.int16)
        ramp = np.arange(cells)
        outside = ramp >= width[:, None]
        cost = np.zeros((len(own), cells + 1), dtype=np.int32)
        cost[:, :-1][outside] = 1 << 20
        cost[:, -1] = 1 << 20
        start = np.tile(np.append(ramp, 0), (len(own), 1))
        done = 0
        for i in range(rows):
            sub = cost[:, :-1] + (text[:, i : i + cells] != pattern[:, i : i + 1])
            gap = cost[:, 1:] + 1
            s = np.where(sub <= gap, start[:, :-1], start[:, 1:])
            flat = np.minimum(sub, gap) - ramp
            best = np.minimum.accumulate(flat, axis=1)
            source = np.maximum.accumulate(np.where(flat == best, ramp, 0), axis=1)
            cost[:, :-1] = best + ramp
            cost[:, :-1][outside] = 1 << 20
            start[:, :-1] = np.take_along_axis(s, source, axis=1)
            while done < len(own) and m[done] == i + 1:
                at, limit = int(cost[done, :-1].argmin()), int(length[done, 0])
                first = int(low[own[done]])
                out[own[done]] = cost[done, at], min(max(first + int(start[done, at]), 0), limit), min(max(first + at + i + 1, 0), limit)
                done += 1
    return out


def banded(pattern: bytes, text: bytes, low: int, high: int) -> tuple[int, int, int]:
    """banded_all() of one pattern in one text."""
    one = lambda x: np.array([x], dtype=np.int64)
    return tuple(banded_all([pattern], np.frombuffer(text, np.uint8), one(0), one(len(text)), one(low), one(high))[0].tolist())


def _regions(at: np.ndarray, lo: np.ndarray, n: np.ndarray, doc: np.ndarray, inner: np.ndarray, base: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(doc, item, least diagonal, greatest diagonal) of the bands with enough hits.

    Bands are k+1 wide steps, each 2(k+1) wide: any k+1 neighbouring diagonals lie
    in one of them.  Hits are counted a bounded number at a time.
    """
    parts: list[np.ndarray] = []  # columns: item, band, hits, least and greatest diagonal

    def merged(x: np.ndarray) -> np.ndarray:
        x = x[:, np.lexsort([x[1], x[0]])]
        new = np.flatnonzero(np.r_[True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
        return np.stack([x[0, new], x[1, new], np.add.reduceat(x[2], new), np.minimum.reduceat(x[3], new), np.maximum.reduceat(x[4], new)])

    ends = np.cumsum(n)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPANDED, side="right")))
        row = np.repeat(np.arange(a, b), n[a:b])
        entry = np.repeat(lo[a:b], n[a:b]) + ragged_arange(n[a:b])
        item = index.item[entry].astype(np.int64)
        diag = base[doc[row]] + inner[row] - index.place[entry]
        band = diag // (index.k[item] + 1)
        one = np.ones(len(diag), np.int64)
        parts.append(merged(np.stack([np.r_[item, item], np.r_[band, band - 1], np.r_[one, one], np.r_[diag, diag], np.r_[diag, diag]])))
        if len(parts) > 8:
            parts = [merged(np.concatenate(parts, axis=1))]
        a = b
    item, _, count, low, high = merged(np.concatenate(parts, axis=1))
    good = count >= index.least[item]
    item, low, high = item[good], low[good], high[good]
    # diagonals of different texts lie far apart
    owner = np.searchsorted(base, low + int(index.size.max()), side="right") - 1
    order = np.lexsort([low, item, owner])
    item, low, high, owner = item[order], low[order], high[order], owner[order]
    return owner, item, low - base[owner], high - base[owner]


def _tiny(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first byte, end) of items of fewer bytes than a q-gram, as whole words; bytes of the lower-cased text."""
    w = Words(texts)
    h = w.hashes()
    for n, (names, items) in index.tiny.items():
        g = word_grams(h, n)
        at = np.flatnonzero(gram_starts(w.first, n)[: len(g)])
        found = np.minimum(np.searchsorted(names, g[at]), len(names) - 1)
        owner = w.text_of_word()
        for p, f in zip(at[names[found] == g[at]].tolist(), found[names[found] == g[at]].tolist()):
            said = b" ".join(w.data[w.start[p + j] : w.end[p + j]].tobytes() for j in range(n))
            for k in items[f]:
                if index.items[k] == said:
                    yield int(owner[p]), k, int(w.start[p] - w.offsets[owner[p]]), int(w.end[p + n - 1] - w.offsets[owner[p]])


def find(texts: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits), offsets in characters of the lower-cased text."""
    out: list[tuple[int, int, int, int, int]] = []
    if not len(index.ids) or not len(texts):
        return out
    hits: list[tuple[int, int, int, int, int]] = [(d, k, a, b, 0) for d, k, a, b in _tiny(texts, index)] if index.tiny else []
    if len(index.names):
        hits += _long(texts, index)
    if hits:
        data, off = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
        hits.sort()
        for d in sorted({h[0] for h in hits}):
            own = [h for h in hits if h[0] == d]
            raw = data[off[d] : off[d + 1]].tobytes()
            a = char_positions(raw, np.array([h[2] for h in own]))
            b = char_positions(raw, np.array([h[3] for h in own]))
            out += [(d, h[1], int(x), int(y), h[4]) for h, x, y in zip(own, a, b)]
    return out


def _long(texts: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Occurrences of items of a q-gram or more, in bytes of the lower-cased text."""
    data, off, origin = normal(texts)
    q = index.q
    names = gram_names(data, q)
    at = np.flatnonzero(index.bits[(names >> U64(64 - FILTER_BITS)).astype(np.int64)])
    h = names[at]
    lo = np.searchsorted(index.names, h, side="left")
    sure = lo < len(index.names)
    sure[sure] = index.names[lo[sure]] == h[sure]
    at, h, lo = at[sure], h[sure], lo[sure]
    # a region with too few hits for every class of items holds no occurrence
    dense = np.zeros(len(at), dtype=bool)
    for need, reach in index.classes:
        if len(at) >= need:
            close = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= reach)
            edge = np.zeros(len(at) + 1, dtype=np.int64)
            edge[close] += 1
            edge[close + need] -= 1
            dense |= np.cumsum(edge[:-1]) > 0
    at, h, lo = at[dense], h[dense], lo[dense]
    doc = np.searchsorted(off, at, side="right") - 1
    fits = at + q <= off[doc + 1]
    at, h, lo, doc = at[fits], h[fits], lo[fits], doc[fits]
    if not len(at):
        return []
    n = np.searchsorted(index.names, h, side="right") - lo
    room = 4 * int(index.size.max()) + 64
    base = off[:-1] + room * np.arange(1, len(off))
    doc, item, low, high = _regions(at, lo, n, doc, at - off[doc], base, index)
    best = np.zeros((len(doc), 3), dtype=np.int64)
    best[:, 0] = 1 << 20
    todo = []
    for g, (d, i) in enumerate(zip(doc.tolist(), item.tolist())):
        a, b, m = int(off[d]), int(off[d + 1]), int(index.size[i])
        x, y = a + max(0, int(low[g])), min(b, a + max(0, int(high[g])) + m)
        exact = data[x:y].tobytes().find(index.items[i])
        if exact >= 0:
            best[g] = 0, x + exact - a, x + exact - a + m
        elif index.k[i]:
            todo.append(g)
    if todo:
        t = np.array(todo)
        k = index.k[item[t]]
        best[t] = banded_all([index.items[i] for i in item[t].tolist()], data, off[doc[t]], off[doc[t] + 1], low[t] - k, high[t] + k)
    out: list[tuple[int, int, int, int, int]] = []
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for g in np.flatnonzero(best[:, 0] <= index.k[item]).tolist():
        d, i, (edits, s, e) = int(doc[g]), int(item[g]), best[g].tolist()
        a, b = int(off[d]), int(off[d + 1])
        if index.size[i] < SHORT and not ((s == 0 or data[a + s - 1] == 32) and (a + e >= b or data[a + e] == 32)):
            continue  # inside a word
        done = seen.setdefault((d, i), [])
        if e > s and not any(s < y and x < e for x, y in done):
            done.append((s, e))
            out.append((d, i, int(origin[a + s]), int(origin[a + e - 1]) + 1, edits))
    return out


def index_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_bytes: int = MAX_BYTES, **params) -> Index:
    """The benchmark's index on the driver, broadcast later: its size is looked up first.

    A benchmark of more than max_bytes is an error: take it in several indexes, one
    after another.  Null texts and ids are left out.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 16).alias("n")).first().n or 0
    if size > max_bytes:
        raise ValueError(f"benchmark texts have {size} bytes, an index holds {max_bytes}: divide them")
    got = rows.orderBy("i", "t").collect()
    return Index([r.i for r in got], [r.t for r in got], **params)


def leaks(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): each place where a document holds a benchmark text within the edit budget.

    Texts are compared lower-cased, with every run of signs other than letters
    and digits as one space; edits are counted on UTF-8 bytes.  The budget is
    error * length (8 %), less for items too short for the lemma.  Every
    document is compared with every item; the filter is lossless.

    Items of fewer than 40 bytes are sought without edits and as whole words; an
    item of a word or two is found wherever those words stand.  Items without any
    letter or digit identify nothing and have no rows.  Null
    and empty texts, a null benchmark text or item_id: no rows.  Repeated
    document rows and repeated items each give their rows; overlapping
    occurrences of one item in one document give the first found.  Offsets are in
    characters of the lower-cased text.  Whole texts are read.  Other columns
    are ignored.  Empty tables give no rows.  Ids are cast to long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for piece in slices(batch, "text"):
                found = find(piece.column("text"), known)
                cols = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(cols[0], pa.int64())),
                        pa.array([known.ids[i] for i in cols[1]], pa.int64()),
                        *(pa.array(c, pa.int32()) for c in cols[2:]),
                    ],
                    names=["doc_id", "item_id", "start", "end", "edits"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(report, "doc_id long, item_id long, start int, end int, edits int")


def drop_leaks(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark text: one pass, no shuffle, all columns kept.

    Rows with a null or empty text stay, and so do rows with a null id; repeated
    rows are judged one by one, by their whole texts.  Every item of the index
    counts, also one of a single word.  No rows give no rows; an empty index drops
    nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for piece in slices(batch, text_col):
                clean = np.ones(piece.num_rows, dtype=bool)
                clean[[f[0] for f in find(piece.column(text_col), known)]] = False
                yield piece.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
