"""Embedding near-duplicates: all pairs, block by block; by sorted projection passes where a caller asks for them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm._kernels import U64
from chronotext.llm._spark import removed, written
from chronotext.llm.components import connected_components

THRESHOLD = 0.9
#: share of the pairs at the threshold that passes and window are chosen for
RECALL = 0.97
#: vectors that passes and window are chosen by, at most
SAMPLE = 2000
WINDOWS = (64, 128, 256, 512, 1024, 2048)
#: bytes of vectors and rows of a block, at most (rows: LEAST_ROWS at least), and rows of its tiles
BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS, TILE = 1 << 20, 4096, 16, 256
_planes: dict[tuple[int, int, int], np.ndarray] = {}


def planes(dim: int, passes: int, seed: int) -> np.ndarray:
    """64 random directions for each pass, the same on all machines."""
    key = (dim, passes, seed)
    if key not in _planes:
        _planes[key] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * 64)).astype(np.float32)
    return _planes[key]


def projection_keys(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Per row and pass the concatenated signs of 64 projections, first sign highest, as longs in the same order."""
    signs = (x @ planes(x.shape[1], passes, seed) > 0).reshape(len(x), passes, 64)
    bits = np.packbits(signs, axis=2).reshape(len(x), passes, 8)
    return (bits.view(">u8")[:, :, 0].astype(U64) ^ U64(1 << 63)).view(np.int64)


def _finite_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, vectors and norms, by dimension; vectors that are null, empty, zero or not finite are left out."""
    col = batch.column("v")
    size = np.diff(col.offsets.to_numpy()).astype(np.int64)
    size[col.is_null().to_numpy(zero_copy_only=False)] = 0
    first = col.offsets.to_numpy()[:-1].astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float32)
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        x = values[first[at][:, None] + np.arange(dim)]
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield batch.column("id").take(pa.array(at[ok])), x[ok], norm[ok]


def _unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The same with unit vectors."""
    for ids, x, norm in _finite_rows(batch):
        yield ids, (x / norm[:, None]).astype(np.float32)


def packed(x: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of bytes: one for each number, then the step and the norm of the error, both as 32-bit floats."""
    step = np.maximum(np.abs(x).max(axis=1, keepdims=True) / 127, 1e-30).astype(np.float32)
    q = np.rint(x / step).astype(np.int8)
    error = np.linalg.norm(x.astype(np.float64) - q.astype(np.float64) * step, axis=1, keepdims=True) * (1 + 1e-6) + 1e-6
    return np.concatenate([q.view(np.uint8), step.view(np.uint8), error.astype(np.float32).view(np.uint8)], axis=1)


def unpacked(rows: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, norms of their errors)."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), dim + 8)
    q = np.ascontiguousarray(raw[:, :dim]).view(np.int8).astype(np.float32)
    tail = np.ascontiguousarray(raw[:, dim:]).view(np.float32)
    return q * tail[:, :1], tail[:, 1]


def _keyed(passes: dict[int, int], centers: dict[int, np.ndarray], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                for ids, x in _unit_rows(batch.slice(lo, 2048)):
                    n, dim = x.shape
                    keys = projection_keys(x - centers[dim], passes[dim], seed)
                    size = dim + 8
                    flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.array(np.arange(n + 1, dtype=np.int32) * size).buffers()[1], pa.py_buffer(np.ascontiguousarray(packed(x)))])
                    for p in range(passes[dim]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.ascontiguousarray(keys[:, p])), ids, flat],
                            names=["pass", "dim", "key", "id", "v"],
                        )

    return run


def spanning_links(x: np.ndarray, error: np.ndarray, window: int, threshold: float, fresh: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, sure), i < j <= i + window, of rows that are or may be that similar; j from `fresh` on.

    sure: similar whatever the errors are.  A pair is left out where j's nearest
    sure partner is also sure to be like i: the components are the same with far
    fewer links.
    """
    n = len(x)
    near = np.zeros((n, window), dtype=bool)  # near[j, o]: rows j and j-1-o are alike
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, n, window):
        hi = min(lo + window, n)
        a = max(0, lo - window)
        sim = x[lo:hi] @ x[a:hi].T
        slack = error[lo:hi, None] + (1 + error[lo:hi, None]) * error[None, a:hi] + 1e-5
        j = np.arange(lo, hi)[:, None]
        i = np.arange(a, hi)[None, :]
        at = (i < j) & (i >= j - window)
        jj, ii = np.nonzero(at & (sim - slack >= threshold))
        near[lo + jj, lo + jj - 1 - (a + ii)] = True
        jj, ii = np.nonzero(at & (sim - slack < threshold) & (sim + slack >= threshold))
        open_.append((a + ii, lo + jj))
    j, o = np.nonzero(near)
    first = near.argmax(axis=1)

    def through(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        via = j - 1 - first[j]
        gap = via - 1 - i
        return near[j, first[j]] & (gap >= 0) & near[np.maximum(via, 0), np.maximum(gap, 0)]

    i = j - 1 - o
    keep = (j >= fresh) & ~through(i, j)
    i2, j2 = (np.concatenate(c) for c in zip(*open_)) if open_ else (np.zeros(0, np.int64),) * 2
    maybe = (j2 >= fresh) & ~through(i2, j2)
    return np.r_[i[keep], i2[maybe]], np.r_[j[keep], j2[maybe]], np.r_[np.ones(int(keep.sum()), bool), np.zeros(int(maybe.sum()), bool)]


def _compare(windows: dict[int, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one partition, in order of pass, dimension and key.

        Rows of kind 0 are links (u, v), kind 1 pairs that may be links, kind 2 the
        number of rows (u) of a pass in this partition, kind 3 and 4 its first and
        last rows with their places from the start and from the end.
        """
        part = TaskContext.get().partitionId()
        held_id, held, group = np.zeros(0, np.int64), None, None
        ends: pa.RecordBatch | None = None
        seen = 0

        def out(kind, u, v, p=0, d=0, place=None, vec=None):
            n = len(u)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.broadcast_to(np.asarray(kind, np.int8), n)),
                    pa.array(np.asarray(u, np.int64)),
                    pa.array(np.asarray(v, np.int64)),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, p, np.int32)),
                    pa.array(np.full(n, d, np.int32)),
                    pa.array(np.zeros(n, np.int64) if place is None else np.asarray(place, np.int64)),
                    pa.array([None] * n if vec is None else vec, pa.binary()),
                ],
                names=["kind", "u", "v", "part", "pass", "dim", "place", "vec"],
            )

        def finished():
            yield out(2, [seen], [seen], *group)
            m = ends.num_rows
            yield out(4, ends.column("id"), ends.column("id"), *group, np.arange(m)[::-1], ends.column("v").to_pylist())

        for batch in batches:
            p, d = batch.column("pass").to_numpy(), batch.column("dim").to_numpy()
            cut = np.flatnonzero((p[1:] != p[:-1]) | (d[1:] != d[:-1])) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, batch.num_rows]):
                if hi <= lo:
                    continue
                own = (int(p[lo]), int(d[lo]))
                window = windows[own[1]]
                piece = batch.slice(lo, hi - lo).select(["id", "v"])
                if own != group:
                    if group is not None:
                        yield from finished()
                    group, seen, ends = own, 0, piece.slice(0, 0)
                    held_id, held, error = np.zeros(0, np.int64), np.zeros((0, own[1]), np.float32), np.zeros(0, np.float32)
                raw = piece.column("v").to_pylist()
                ids = piece.column("id").to_numpy()
                if seen < window:
                    k = min(window - seen, len(ids))
                    yield out(3, ids[:k], ids[:k], *group, seen + np.arange(k), raw[:k])
                seen += len(ids)
                last = pa.Table.from_batches([ends, piece]).slice(max(0, ends.num_rows + piece.num_rows - window)).combine_chunks().to_batches()
                ends = last[0] if last else piece.slice(0, 0)
                x, e = unpacked(raw, own[1])
                old = len(held_id)
                held_id, held, error = np.concatenate([held_id, ids]), np.concatenate([held, x]), np.concatenate([error, e])
                i, j, sure = spanning_links(held, error, window, threshold, old)
                if len(i):
                    a, b = held_id[i], held_id[j]
                    yield out(np.where(sure, 0, 1), np.minimum(a, b), np.maximum(a, b))
                held_id, held, error = held_id[-window:], held[-window:], error[-window:]
        if group is not None:
            yield from finished()

    return run


def _across(rows: DataFrame, windows: dict[int, int], threshold: float) -> DataFrame:
    """(u, v, sure) of rows in different partitions that are no more than a window apart in a pass.

    Places in the whole pass follow from the numbers of rows of its partitions, so
    that a window may reach over partitions with few rows of it.
    """
    counts = rows.where("kind = 2").select("pass", "dim", "part", F.col("u").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pass", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)
    at = F.when(F.col("kind") == 3, F.col("before") + F.col("place")).otherwise(F.col("before") + F.col("n") - 1 - F.col("place"))
    sizes = F.create_map(*[F.lit(v) for d, w in windows.items() for v in (d, w)])
    edge = rows.where("kind > 2").join(counts, ["pass", "dim", "part"]).select("kind", "pass", "dim", "part", F.col("u").alias("id"), "vec", at.alias("at"), sizes[F.col("dim")].alias("w"))
    edge = edge.withColumn("block", F.floor(F.col("at") / F.col("w")))
    ends = edge.where("kind = 4").select("pass", "dim", F.col("part").alias("p"), F.col("id").alias("u"), F.col("at").alias("i"), F.col("vec").alias("a"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    starts = edge.where("kind = 3").select("pass", "dim", F.col("part").alias("q"), F.col("id").alias("v"), F.col("at").alias("j"), F.col("vec").alias("b"), "w", "block")
    pairs = ends.join(starts, ["pass", "dim", "block"]).where("p < q and i < j and j - i <= w and u <> v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                piece = batch.filter(pa.array(dims == dim))
                (a, ea), (b, eb) = (unpacked(piece.column(c).to_pylist(), int(dim)) for c in ("a", "b"))
                sim, slack = np.einsum("ij,ij->i", a, b), ea + (1 + ea) * eb + 1e-5
                ok = pa.array(sim + slack >= threshold)
                yield pa.RecordBatch.from_arrays([piece.column("u").filter(ok), piece.column("v").filter(ok), pa.array(sim - slack >= threshold).filter(ok)], names=["u", "v", "sure"])

    return pairs.select("dim", "u", "v", "a", "b").mapInArrow(check, "u long, v long, sure boolean")


def _exact(pairs: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose cosine in double precision reaches the threshold."""
    left, right = (base.select(F.col("id").alias(i), F.col("v").alias(x)) for i, x in (("u", "x"), ("v", "y")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    both = pairs.select("u", "v").distinct().join(left, "u").join(right, "v").where(F.size("x") == F.size("y"))
    return both.where(dot("x", "y") >= threshold * F.sqrt(dot("x", "x") * dot("y", "y"))).select("u", "v").distinct()


def choose(sample: np.ndarray, center: np.ndarray, n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(passes, window) with which a pair at the threshold is found with the wanted probability.

    A pass brings a pair within the window if the first k bits of both are equal,
    k being as many as leave no more than a window of other vectors with the same k
    bits.  How many that are follows from the angles between sampled vectors; those
    that are near copies don't count, as they are linked with each other.  Of the
    windows that do, the one that costs least is taken.
    """
    x = sample - center
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    m = float(center @ center)
    own = np.clip((threshold - m) / max(1 - m, 1e-6), -0.99, 1)  # cosine of such a pair about the centre
    differ = np.arccos(own) / np.pi
    near = sample @ sample.T >= threshold
    share = 1 - np.arccos(np.clip(x @ x.T, -1, 1)) / np.pi
    share[near] = 0
    best = None
    crowd, k = share.copy(), 1
    todo = [w for w in WINDOWS[::-1]]
    found: dict[int, int] = {w: 0 for w in todo if n <= w}
    while k <= 63 and len(found) < len(WINDOWS):
        others = float(np.quantile(crowd.mean(axis=1), 0.9)) * n
        for w in todo:
            if w not in found and others <= w:
                found[w] = k
        crowd *= share
        k += 1
    for w in WINDOWS:
        hit = (1 - differ) ** found.get(w, 63)
        passes = 1 if hit >= recall else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        cost = passes * (1 + w / 512)
        if best is None or cost < best[0]:
            best = (cost, passes, w)
    return best[1], best[2]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for ids, x in _unit_rows(batch):
            n, s = total.get(x.shape[1], (0, np.zeros(x.shape[1])))
            total[x.shape[1]] = n + len(x), s + x.sum(axis=0, dtype=np.float64)
    for dim, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n, np.int64)), pa.array(s)], names=["dim", "at", "n", "s"])


class Block(NamedTuple):
    """Vectors, ready to be compared with those of another block."""

    raw: np.ndarray
    unit: np.ndarray  # 32-bit floats
    short: np.ndarray  # the first half of each unit vector and the norm of its rest
    center: np.ndarray  # unit vectors, one for each TILE rows
    reach: np.ndarray  # angles from them that hold all rows of the tile


def block_of(raw: np.ndarray) -> Block:
    x = raw.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = (x.shape[1] + 1) // 2
    rest = np.linalg.norm(x[:, half:], axis=1, keepdims=True)
    center, reach = caps(x, TILE)
    return Block(raw, x.astype(np.float32), np.concatenate([x[:, :half], rest], axis=1).astype(np.float32), center, reach)


def caps(x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, angles): one for each so many rows, whose angle to it is no more than that."""
    first = np.arange(0, len(x), rows)
    c = np.add.reduceat(x, first, axis=0)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    c = np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), x[first])
    angle = _angles(np.einsum("ij,ij->i", x, np.repeat(c, np.diff(np.r_[first, len(x)]), axis=0)))
    return c, np.maximum.reduceat(angle, first) + 1e-6


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least root of each node's component, with the links (i, j) added to those that `root` stands for."""
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows, summed up in double precision in the order of SQL, reach the threshold."""
    xy, xx, yy = np.zeros((3, len(x)))
    for k in range(x.shape[1]):
        a, b = x[:, k].astype(np.float64), y[:, k].astype(np.float64)
        xy, xx, yy = xy + a * b, xx + a * a, yy + b * b
    p, q = np.sqrt(xx), np.sqrt(yy)
    return (xy >= threshold * p * q) | (xy >= threshold * q * p)


def linked(a: Block, b: Block, root: np.ndarray, threshold: float) -> np.ndarray:
    """Roots of a's rows, then b's, with every link between a row of a and one of b added; a may be b.

    Tiles are passed over only where their caps are further apart than the angle of
    the threshold, or where all their rows are in one component already.  A product
    of half the numbers and of the norms of the rest bounds the cosine from above;
    what it leaves is compared in full, and in double precision where 32-bit floats
    could err.
    """
    base = 0 if a is b else len(a.raw)
    slack = (a.raw.shape[1] + 8) * 2.5e-7
    close = _angles(a.center @ b.center.T) - a.reach[:, None] - b.reach[None, :] <= _angles(np.float64(threshold))
    if a is b:
        close = np.triu(close)
    tiles = np.arange(len(b.raw)) // TILE
    for t in np.flatnonzero(close.any(axis=1)):
        lo, hi = t * TILE, min((t + 1) * TILE, len(a.raw))
        cols = np.flatnonzero(close[t][tiles])
        here = slice(int(cols[0]), int(cols[-1]) + 1) if cols[-1] - cols[0] + 1 == len(cols) else cols
        if (root[lo:hi] == root[lo]).all() and (root[base + cols] == root[lo]).all():
            continue
        sim = a.short[lo:hi] @ b.short[here].T
        at = np.flatnonzero(sim >= threshold - slack)
        full = len(at) > sim.size // 32
        if full:
            sim = a.unit[lo:hi] @ b.unit[here].T
            at = np.flatnonzero(sim >= threshold - slack)
        i, j = lo + at // len(cols), cols[at % len(cols)]
        fresh = root[i] != root[base + j]
        at, i, j = at[fresh], i[fresh], j[fresh]
        cos = sim.ravel()[at] if full else np.einsum("ij,ij->i", a.unit[i], b.unit[j])
        ok = cos >= threshold + slack
        open_ = np.flatnonzero(~ok & (cos >= threshold - slack))
        for k in range(0, len(open_), BLOCK_ROWS):
            some = open_[k : k + BLOCK_ROWS]
            ok[some] = alike(a.raw[i[some]], b.raw[j[some]], threshold)
        root = united(root, i[ok], base + j[ok])
    return root


def _first_rows(names: np.ndarray) -> np.ndarray:
    """The first place of each value."""
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    return first[which]


def _ordered(centers: dict[int, np.ndarray], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                for ids, x, norm in _finite_rows(batch.slice(lo, 2048)):
                    n, dim = x.shape
                    keys = projection_keys((x / norm[:, None]).astype(np.float32) - centers[dim], 1, seed)[:, 0]
                    rows = [r.tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.ascontiguousarray(keys)), ids, pa.array(rows, pa.binary())], names=["dim", "key", "id", "v"])

    return run


_BLOCKS = "u long, v long, block long, dim int, center array<double>, reach double, labels binary, vecs binary"


def _blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one partition, in order, as blocks of different vectors.

        Rows without a block are links (u, v): of copies of a vector, and of each id
        with the one that names its component within its block, its label.
        """
        part = TaskContext.get().partitionId()
        made, dim, ids, raw = 0, 0, np.zeros(0, np.int64), np.zeros((0, 0), np.float32)

        def links(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = u[u != v], v[u != v]
            if n := len(u):
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(n, k) for k in kinds)], names=["u", "v", "block", "dim", "center", "reach", "labels", "vecs"])

        def different() -> Iterator[pa.RecordBatch]:
            nonlocal ids, raw
            first = _first_rows(raw.view(np.dtype((np.void, raw.shape[1] * 4)))[:, 0])
            yield from links(ids, ids[first])
            keep = first == np.arange(len(first))
            ids, raw = ids[keep], raw[keep]

        def block(ids: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal made
            own = block_of(raw)
            labels = ids[linked(own, own, _first_rows(ids), threshold)]
            yield from links(ids, labels)
            x = raw.astype(np.float64)
            center, reach = caps(x / np.linalg.norm(x, axis=1, keepdims=True), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.int64()),
                    pa.array([(part << 32) + made]),
                    pa.array([dim], pa.int32()),
                    pa.array([center[0].tolist()], pa.list_(pa.float64())),
                    pa.array(reach),
                    pa.array([labels.tobytes()], pa.binary()),
                    pa.array([raw.tobytes()], pa.binary()),
                ],
                names=["u", "v", "block", "dim", "center", "reach", "labels", "vecs"],
            )
            made += 1

        def rest() -> Iterator[pa.RecordBatch]:
            if len(ids):
                yield from different()
                yield from block(ids, raw)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cut = np.flatnonzero(dims[1:] != dims[:-1]) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, batch.num_rows]):
                if hi <= lo:
                    continue
                if dims[lo] != dim:
                    yield from rest()
                    dim = int(dims[lo])
                    ids, raw = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
                size = max(LEAST_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (4 * dim)))
                piece = batch.slice(lo, hi - lo)
                ids = np.concatenate([ids, piece.column("id").to_numpy()])
                raw = np.concatenate([raw, np.frombuffer(b"".join(piece.column("v").to_pylist()), np.float32).reshape(-1, dim)])
                if len(ids) >= size:
                    yield from different()
                while len(ids) >= size:
                    yield from block(ids[:size], raw[:size])
                    ids, raw = ids[size:], raw[size:]
        yield from rest()

    return run


def _between(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (u, v) of labels for each pair of blocks: as many as join what the pair joins."""
        ready: dict[int, tuple[np.ndarray, Block]] = {}

        def opened(batch: pa.RecordBatch, k: int, side: str) -> tuple[np.ndarray, Block]:
            name = batch.column(f"block{side}")[k].as_py()
            if name not in ready:
                if len(ready) >= 16:
                    ready.pop(next(iter(ready)))
                labels, vecs = (batch.column(f"{c}{side}")[k].as_py() for c in ("labels", "vecs"))
                labels = np.frombuffer(labels, np.int64)
                ready[name] = labels, block_of(np.frombuffer(vecs, np.float32).reshape(len(labels), -1))
            return ready[name]

        for batch in batches:
            for k in range(batch.num_rows):
                (p, a), (q, b) = opened(batch, k, "_a"), opened(batch, k, "_b")
                labels = np.r_[p, q]
                before = _first_rows(labels)
                root = linked(a, b, before, threshold)
                new = np.flatnonzero((before == np.arange(len(before))) & (root != before))
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array(labels[new]), pa.array(labels[root[new]])], names=["u", "v"])

    return run


def _links_of_all_pairs(base: DataFrame, centers: dict[int, np.ndarray], threshold: float, seed: int, scratch: list[str]) -> DataFrame:
    """Links (u, v) with the components of all pairs (u, v) that are that similar."""
    keyed = base.mapInArrow(_ordered(centers, seed), "dim int, key long, id long, v binary")
    order = ["dim", "key", "id"]
    rows = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order, "v").mapInArrow(_blocks(threshold), _BLOCKS), "vector-blocks", scratch)
    blocks = rows.where("block is not null").drop("u", "v")
    a, b = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "ab")
    dot = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) - F.col("reach_a") - F.col("reach_b")
    # each pair once, and as many in one order as in the other: tasks are ranges of blocks
    once = (F.col("block_a") < F.col("block_b")) == (F.pmod(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")), F.lit(2)) == 0)
    pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("dim_a") == F.col("dim_b")) & (F.col("block_a") != F.col("block_b")) & once & (apart <= F.lit(float(_angles(np.float64(threshold))))))
    between = pairs.select("block_a", "labels_a", "vecs_a", "block_b", "labels_b", "vecs_b").mapInArrow(_between(threshold), "u long, v long")
    return rows.where("block is null").select("u", "v").union(between)


def _links_by_passes(base: DataFrame, centers: dict[int, np.ndarray], counts: dict[int, int], threshold: float, passes: int | None, window: int | None, seed: int, recall: float) -> DataFrame:
    """Links (u, v) of vectors that are that similar and within the window in a pass.

    Vectors travel as one byte a number with their error, and pairs that the errors
    leave open are decided by the vectors themselves.  All passes share one exchange.
    """
    plan, windows = {}, {}
    for dim, n in counts.items():
        if passes is None or window is None:
            some = base.where(F.size("v") == dim).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(min(1.0, (2 * SAMPLE + 50) / n) * (1 << 30)))
            rows = some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks().to_batches()
            x = np.concatenate([x for b in rows for _, x in _unit_rows(b) if x.shape[1] == dim] or [np.zeros((1, dim), np.float32)])
            plan[dim], windows[dim] = choose(x, centers[dim], n, threshold, recall)
        plan[dim], windows[dim] = passes or plan[dim], window or windows[dim]
    keyed = base.mapInArrow(_keyed(plan, centers, seed), "pass int, dim int, key long, id long, v binary")
    order = ["pass", "dim", "key", "id"]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare(windows, threshold), "kind byte, u long, v long, part int, pass int, dim int, place long, vec binary")
    scratch: list[str] = []
    rows = written(rows, "projection-passes", scratch)
    pairs = rows.where("kind < 2 and u <> v").select("u", "v", (F.col("kind") == 0).alias("sure")).union(_across(rows, windows, threshold))
    pairs = written(pairs.groupBy("u", "v").agg(F.bool_or("sure").alias("sure")), "projection-pairs")
    removed(base.sparkSession, scratch)
    return pairs.where("sure").select("u", "v").union(_exact(pairs.where("not sure"), base, threshold))


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    passes: int | None = None,
    window: int | None = None,
    seed: int = 3,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, group_id) for every vector with a near copy: its group's least id.

    All pairs of different vectors are compared, and those with a cosine of at least
    `threshold` in double precision are united: no link is lost and nothing is
    drawn from a sample.  Vectors are ordered by the signs of 64 random projections
    about the corpus mean and cut into blocks; components within a block are found
    as it is made, and pairs of blocks are compared side by side, without an
    exchange, unless the caps around them are further apart than the angle of the
    threshold.  Order and caps only decide what need not be multiplied.  Where
    vectors lie in all directions no pair of blocks is passed over: the work then
    grows as the square of the number of different vectors.

    Only with `passes` or `window` the result is approximate, for tables that all
    pairs are too many of: in each pass vectors are in the order of other
    projections and each is compared with the `window` rows before it, across
    partition ends too.  One that isn't given is chosen by the number of vectors and
    the angles between SAMPLE of them, for a pair at the threshold to be found with
    probability `recall`.

    Null ids and vectors that are null, empty, all zero or not finite are in no
    group.  Only vectors of one length are compared.  Repeated rows of an id
    are one vector (with all of its values).  Copies of any number form one
    group: equal vectors of a block are one, linked by their ids.  Empty tables give
    no rows; other columns are ignored.  Ids are cast to long.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    base = base.where(~F.exists("v", lambda e: e.isNull()))
    sums = base.mapInArrow(_sums, "dim int, at int, n long, s double").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "at").toArrow()
    dims, numbers, total = (sums.column(c).to_numpy() for c in ("dim", "n", "s"))
    counts = {dim: int(numbers[dims == dim][0]) for dim in np.unique(dims).tolist()}
    centers = {dim: (total[dims == dim] / n).astype(np.float32) for dim, n in counts.items()}
    if not centers:
        return base.select(F.col("id").alias("vec_id"), F.col("id").alias("group_id")).limit(0)
    scratch: list[str] = []
    if passes is None and window is None:
        links = _links_of_all_pairs(base, centers, threshold, seed, scratch)
    else:
        links = _links_by_passes(base, centers, counts, threshold, passes, window, seed, recall)
    roots = connected_components(links)
    removed(vectors.sparkSession, scratch)
    return roots.select(F.col("u").alias("vec_id"), F.col("root").alias("group_id")).union(
        roots.select(F.col("root").alias("vec_id"), F.col("root").alias("group_id")).distinct()
    )
