"""MinHash near-duplicates: hash minima, banding, signature verification, star components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm._kernels import U64, Words, gram_starts, mix, slices, word_grams
from chronotext.llm._spark import cut, removed, written
from chronotext.llm.components import connected_components

N_HASHES = 128
N_BANDS = 32
SHINGLE = 3
THRESHOLD = 0.5
BLOCK = 512


def _family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64)
    return a, b


def signatures(texts: pa.Array, n_hashes: int = N_HASHES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 32-bit minima, and which texts have any word.

    The hashes are the strongly universal (a*x + b) mod 2**64 >> 32 over 32-bit
    shingle names x.  A text with fewer words than a shingle is one shingle.
    """
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.first)
    has = size > 0
    out = np.zeros((n, n_hashes), dtype=np.uint32)
    if not has.any():
        return out, has
    h = w.hashes()
    grams = word_grams(h, shingle)
    ok = gram_starts(w.first, shingle)[: len(grams)]
    owner = w.text_of_word()
    short = np.flatnonzero(has & (size < shingle))
    which = owner[: len(grams)][ok]
    x = grams[ok]
    if len(short):
        extra = np.empty(len(short), dtype=U64)
        for k, i in enumerate(short):
            extra[k] = np.bitwise_xor.reduce(mix(h[w.first[i] : w.first[i + 1]] + U64(1) + np.arange(size[i]).astype(U64)))
        x, which = np.concatenate([x, extra]), np.concatenate([which, short])
        order = np.argsort(which, kind="stable")
        x, which = x[order], which[order]
    x >>= U64(32)
    begin = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    rows = which[begin]
    a, b = _family(n_hashes)
    room = np.empty_like(x)
    for j in range(n_hashes):
        np.multiply(x, a[j], out=room)
        np.add(room, b[j], out=room)
        out[rows, j] = np.minimum.reduceat(room, begin) >> U64(32)
    return out, has


def band_keys(sig: np.ndarray, bands: int = N_BANDS) -> np.ndarray:
    """One 64-bit name for each band of each signature."""
    n, width = sig.shape
    rows = width // bands
    part = sig[:, : rows * bands].reshape(n, bands, rows).astype(U64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(U64)), (n, bands)).copy()
    for r in range(rows):
        key = mix(key * U64(0xD6E8FEB86659FD93) + part[:, :, r])
    return key


def _signer(n_hashes: int, bands: int, shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sig, has = signatures(piece.column("text"), n_hashes, shingle)
                sig = sig[has]
                n = len(sig)
                low = np.ascontiguousarray(sig.astype(np.uint16))
                keys = band_keys(sig, bands).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id").filter(pa.array(has)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * n_hashes), n, [None, pa.py_buffer(low)]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["id", "sig", "keys"],
                )

    return sign


def _verified(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(u, v) plus same: how many minima are equal."""
    left = sigs.select(F.col("id").alias("u"), F.col("sig").alias("su"))
    right = sigs.select(F.col("id").alias("v"), F.col("sig").alias("sv"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_matrix(batch.column(c)) for c in ("su", "sv"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array((a == b).sum(axis=1).astype(np.int32))], names=["u", "v", "same"])

    # several signatures of one id: the best counts
    return joined.mapInArrow(compare, "u long, v long, same int").groupBy("u", "v").agg(F.max("same").alias("same"))


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint16).reshape(len(sigs), -1)


def _in_blocks(least: int):
    """Links between rows of one (key, i, j) whose clusters differ: a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(rows: pa.RecordBatch) -> pa.RecordBatch:
            key, i, j, block = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            ident, cluster, sig = rows.column("id").to_numpy(), rows.column("cluster").to_numpy(), _matrix(rows.column("sig"))
            u, v = [], []
            for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(key)].tolist()):
                label = np.unique(cluster[lo:hi], return_inverse=True)[1]
                for k in range(lo, hi - 1):
                    other = np.flatnonzero(label[k + 1 - lo :] != label[k - lo]) + k + 1
                    if i[lo] != j[lo]:  # within a block all are compared where i = j
                        other = other[block[other] != block[k]]
                    near = other[(sig[other] == sig[k]).sum(axis=1) >= least]
                    for m in near.tolist():
                        if label[m - lo] != label[k - lo]:  # not linked by now
                            u.append(ident[k])
                            v.append(ident[m])
                            label[label == label[m - lo]] = label[k - lo]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != p[0] for c, p in zip(("key", "i", "j"), place)):
                yield links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            if len(new):
                held.append(batch.slice(0, int(new[-1])))
                yield links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(int(new[-1]) if len(new) else 0))
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _links(sigs: DataFrame, least: int, n: int, scratch: list[str] | None = None) -> DataFrame:
    """Verified links (u, v) that connect all that links within buckets connect.

    Every member of a bucket is compared with its least id; those that aren't like
    it are compared with the least id among them.  Members of one cluster are
    connected by that.  Members of different clusters are compared as far as their
    counts of equal minima with the two centres leave it open: unequal minima are
    a distance, so members near their centre can't be like what is far from it.
    Those comparisons run in blocks of at most about 2 * BLOCK rows.
    """
    keyed = sigs.select("id", F.explode("keys").alias("key"))
    # sums by key are partial before the exchange; the join splits hot keys
    centers = written(keyed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("far")).where("center < far").select("key", "center"), "minhash-centers", scratch)
    shared = written(keyed.join(centers, "key").select("key", "id", "center"), "minhash-buckets", scratch)
    one_each = sigs.select("id", "sig")
    star = shared.where("id <> center").select(F.col("center").alias("u"), F.col("id").alias("v")).distinct()
    first = written(_verified(star, one_each), "minhash-star", scratch)
    links = first.where(F.col("same") >= least).select("u", "v")
    failed = first.where(F.col("same") < least)
    if failed.isEmpty():
        return links
    failed = failed.select(F.col("u").alias("center"), F.col("v").alias("id"), F.col("same").alias("same1"))
    loose = written(shared.join(failed, ["center", "id"]).select("key", "id", "same1"), "minhash-loose", scratch)
    again = loose.groupBy("key").agg(F.min("id").alias("center2"), F.max("same1").alias("top1"))
    second = loose.join(again, "key").select("key", "id", "same1", "center2")
    pairs = second.where("id <> center2").select(F.col("center2").alias("u"), F.col("id").alias("v")).distinct()
    found = written(_verified(pairs, one_each), "minhash-star", scratch)
    links = links.union(found.where(F.col("same") >= least).select("u", "v"))
    found = found.select(F.col("u").alias("center2"), F.col("v").alias("id"), F.col("same").alias("same2"))
    second = second.join(found, ["center2", "id"], "left").withColumn("same2", F.coalesce("same2", F.lit(n)))
    second = written(second.select("key", "id", "same1", "center2", "same2"), "minhash-loose", scratch)
    # the first cluster's members of those buckets, with what the distances say of both sides
    own = first.where(F.col("same") >= least).select(F.col("u").alias("center"), F.col("v").alias("id"), F.col("same").alias("same1"))
    near = shared.join(again, "key").join(own, ["center", "id"], "left").where("same1 is not null or id = center")
    near = near.select("key", "id", "center", F.coalesce("same1", F.lit(n)).alias("same1"), "top1")
    low = near.groupBy("key").agg(F.min("same1").alias("low1"))
    rest = second.groupBy("key").agg(F.max(F.when(F.col("same2") < least, F.col("same2"))).alias("top2"))
    gap = n - least  # d(x, y) >= |d(x, c) - d(y, c)|, and alike means a distance of at most gap
    rim = near.where(F.col("same1") <= F.col("top1") + gap).select("key", "id", F.col("center").alias("cluster"))
    far = second.join(low, "key").join(rest, "key")
    open_ = (F.col("same2") < least) | (F.col("same1") >= F.col("low1") - gap) | (F.col("same2") <= F.col("top2") + gap)
    cluster = F.when(F.col("same2") >= least, F.col("center2")).otherwise(-1 - F.col("id"))
    members = rim.union(far.where(open_).select("key", "id", cluster.alias("cluster")))
    several = members.groupBy("key").agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n")).where("clusters > 1")
    blocks = members.join(several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "cluster").join(one_each, "id")
    spread = blocks.select("key", "i", "j", "block", "id", "cluster", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.union(spread.mapInArrow(_in_blocks(least), "u long, v long"))


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    n_hashes: int = N_HASHES,
    bands: int = N_BANDS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_id, group_id, n_links) for every document that shares its group with another one.

    group_id is the least doc_id of the group; the group's own first document
    has a row too.  Similarity is the estimated Jaccard index of sets of
    3-word shingles (the share of equal minima, by their low 16 bits), linked
    where it reaches the threshold; groups are the connected components of the
    links.  n_links counts the verified links of a document that hold the groups
    together; links within a cluster whose members are connected already aren't
    sought.

    Within a band bucket no link between members that aren't connected yet is
    left out, and buckets of copies cost one comparison a member; members that
    are like neither centre of their bucket are compared in blocks.

    Nulls: a null id or null text is in no group.  Texts without any word
    (empty, only punctuation) are in no group.  Texts shorter than a shingle
    count as one shingle.  Repeated rows of one id are one document; if their
    texts differ, it is alike whatever any of them is alike.  Whole texts are
    read, however long.  An empty table gives no rows.  Other columns are ignored.
    Ids are cast to long.
    """
    scratch: list[str] = []
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sigs = written(base.mapInArrow(_signer(n_hashes, bands, shingle), "id long, sig binary, keys array<long>"), "minhash", scratch)
    links = written(_links(sigs, math.ceil(threshold * n_hashes - 1e-9), n_hashes, scratch).where("u <> v").distinct(), "minhash-links")
    removed(docs.sparkSession, scratch)
    roots = cut(connected_components(links))
    degree = links.select(F.col("u").alias("doc_id")).union(links.select("v")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    members = roots.select(F.col("u").alias("doc_id"), F.col("root").alias("group_id"))
    members = members.union(roots.select(F.col("root").alias("doc_id"), F.col("root").alias("group_id")).distinct())
    return members.join(degree, "doc_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the members of each group other than its least id; all columns kept.

    Rows with a null id or text stay.  Of several rows with one id, one stays:
    the one with the least text, then the least other columns.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **params)
    gone = groups.where("doc_id <> group_id").select(F.col("doc_id").alias(id_col))
    kept = docs.join(gone, id_col, "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if again.isEmpty():
        return kept
    order = [F.col(text_col).asc_nulls_last(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).asc()]
    repeated = kept.join(again, id_col, "left_semi")
    place = "__place_in_id__"
    one = repeated.withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col(place) == 1).drop(place)
    return kept.join(again, id_col, "left_anti").union(one)
