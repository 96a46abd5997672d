"""Language identification: cosine to several clustered TF-IDF centroids per language, with rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm._kernels import IS_WORD, buffers, slices
from chronotext.llm._spark import table

CELLS = 1 << 14
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: training sample: labelled rows of all languages together, bytes of a text, languages
MAX_ROWS, MAX_BYTES, MAX_LANGS = 1200, 1 << 20, 200
#: share of right answers that may be rejected, and pieces of training texts in each class of length to measure it by
REJECT, PIECES = 0.001, 1000
#: share of that quantile that is accepted still
SLACK = 0.7
LENGTHS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
_AS_SIGN = np.where(IS_WORD, np.arange(256), 32).astype(np.uint8)
for _c in b"0123456789":
    _AS_SIGN[_c] = 32


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte 1- to 3-grams of each lower-cased text, as a dense row.

    Digits and signs count as spaces, runs of them as one.
    """
    data, off = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(off) - 1
    out = np.zeros((n, CELLS), dtype=np.float32)
    if not len(data):
        return out
    d = _AS_SIGN[data]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != 32) | (d[:-1] != 32)
    first = off[:-1]
    keep[first[first < len(d)]] = True
    at = np.searchsorted(np.flatnonzero(keep), off)
    d = d[keep].astype(np.uint32)
    for k in ORDERS:
        code = d.copy() if k == 1 else None
        if k == 2:
            code = d[:-1] << np.uint32(8) | d[1:] if len(d) > 1 else d[:0]
        elif k == 3:
            code = d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:] if len(d) > 2 else d[:0]
        if k == 1:
            cell = code.astype(np.int64)
        else:
            cell = 256 + ((code * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(18)).astype(np.int64) % (CELLS - 256)
        for i in range(n):
            a, b = at[i], at[i + 1] - k + 1
            if b > a:
                out[i] += np.bincount(cell[a:b], minlength=CELLS)
    out[:, 32] = 0
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + log count) * idf with length 1; a text without any letter is a row of zeros."""
    v = np.zeros_like(counts)
    np.log(counts, out=v, where=counts > 0)
    v += counts > 0
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.where(norm > 0, norm, 1)[:, None]
    return v


@dataclass
class Centroids:
    """Unit centroids with their language, and the least cosine that is accepted by how many different n-grams a text has."""

    langs: list[str]
    of: np.ndarray
    centre: np.ndarray
    idf: np.ndarray
    edges: np.ndarray
    least: np.ndarray


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].sum(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1)
    return c


def _kinds(counts: np.ndarray) -> np.ndarray:
    """How many different n-grams each text has."""
    return (counts > 0).sum(axis=1)


def _pieces(texts: list[str], lo: int, hi: int, n: int, rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """n pieces of lo to hi-1 signs, and the texts they are cut from; whole texts where they are no longer."""
    able = [i for i, t in enumerate(texts) if len(t) >= lo]
    out, of = [], []
    for i in rng.choice(able, n) if able else []:
        size = int(rng.integers(lo, hi))
        a = int(rng.integers(0, max(1, len(texts[i]) - size + 1)))
        out.append(texts[i][a : a + size])
        of.append(int(i))
    return out, of


def fit(texts: pa.Array, langs: list[str], centroids: int = CENTROIDS, reject: float = REJECT, seed: int = 5) -> Centroids:
    """Spherical k-means in each language; acceptance by pieces of the training texts.

    Texts of few different n-grams lie far from any centroid, so the least accepted
    cosine is measured in classes of how many a text has: pieces of all lengths are
    cut from the training texts, and it is the `reject` quantile of a class's pieces
    that are answered right, times SLACK, but no less than that of the class below.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs], dtype=np.int64)
    counts = gram_counts(texts) if len(texts) else np.zeros((0, CELLS), np.float32)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = vectors(counts, idf)
    live = x.any(axis=1)
    centre, of = [], []
    for j in range(len(names)):
        own = x[(label == j) & live]
        if len(own):
            c = _kmeans(own, centroids, rng)
            centre.append(c)
            of += [j] * len(c)
    if not centre:
        return Centroids([], np.zeros(0, np.int64), np.zeros((0, CELLS), np.float32), idf, np.zeros(0), np.ones(1))
    centre, of = np.concatenate(centre).astype(np.float32), np.array(of)
    strings = texts.to_pylist()
    cos, kinds, right = [], [], []
    for lo in (1, *LENGTHS):
        some, own = _pieces(strings, lo, 2 * lo + 2, PIECES, rng)
        if some:
            c = gram_counts(pa.array(some, pa.string()))
            y = vectors(c, idf) @ centre.T
            cos.append(y.max(axis=1))
            kinds.append(_kinds(c))
            right.append((kinds[-1] > 0) & (of[y.argmax(axis=1)] == label[own]))
    cos, kinds, right = (np.concatenate(v) if v else np.zeros(0) for v in (cos, kinds, right))
    edges = np.array([4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048], dtype=np.float64)
    least = np.zeros(len(edges) + 1)
    floor = 0.0
    for b in range(len(least)):
        some = cos[(right > 0) & (np.searchsorted(edges, kinds, side="right") == b)]
        if len(some) >= 20:
            floor = max(floor, SLACK * float(np.quantile(some, reject)))
        least[b] = floor
    return Centroids(names, of, centre, idf, edges, least)


def fit_on_labels(docs: DataFrame, max_rows: int = MAX_ROWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_bytes: int = MAX_BYTES) -> Centroids:
    """Trains on at most max_rows labelled rows of at most max_bytes each, as many of each language, chosen by a hash of their id.

    Languages are those of the MAX_LANGS most rows; a rare one has all of its rows
    in the sample.  Null ids, labels and texts are left out; of several texts of an
    id the least is taken.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(F.octet_length("text") <= max_bytes)
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    each = max(1, max_rows // max(1, len(langs)))
    if not langs:
        return fit(pa.array([], pa.string()), [])
    # three times as many as wanted by a threshold on the hash, then the first ones: no exchange of the whole table
    share = F.create_map(*[F.lit(v) for r in langs for v in (r.lang, min(1.0, (3 * each + 30) / r.n))])
    mark = F.xxhash64("id")
    some = rows.where(F.pmod(mark, F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))
    one = some.groupBy("id", "lang").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(mark, F.lit(1 << 30)), "id"))
    got = one.withColumn("place", place).where(F.col("place") <= each).select("id", "lang", "text").orderBy("id", "lang").toArrow()
    return fit(got.column("text").combine_chunks(), got.column("lang").to_pylist())


def identified(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, cosine, margin, rejected) for every row, over the whole text.

    language: that of the nearest centroid; cosine: to it; margin: over the best
    centroid of another language.  rejected: the text lies further from its
    centroid than texts of as many n-grams do; its language is then null.  A few letters
    tell little: their language is a guess.

    Null and empty texts, and texts without any letter, are rejected with cosine
    0.  Equal cosines go to the language first in the alphabet.  Null ids and
    repeated rows are kept.  An empty table gives no rows; a model without
    languages rejects all.  Other columns are ignored.  Ids are cast to long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for piece in slices(batch, "text", 1 << 19):
                for lo in range(0, piece.num_rows, 256):
                    part = piece.slice(lo, 256)
                    yield _answer(part, m)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, language string, cosine double, margin double, rejected boolean")


def _answer(part: pa.RecordBatch, m: Centroids) -> pa.RecordBatch:
    n = part.num_rows
    counts = gram_counts(part.column("text"))
    per = np.full((n, max(1, len(m.langs))), -1.0)
    if len(m.langs):
        cos = vectors(counts, m.idf) @ m.centre.T
        for j in range(len(m.langs)):
            if (m.of == j).any():
                per[:, j] = cos[:, m.of == j].max(axis=1)
    best = per.argmax(axis=1)
    top = per.max(axis=1)
    if per.shape[1] > 1:
        second = np.partition(per, -2, axis=1)[:, -2]
    else:
        second = np.zeros(n)
    size = _kinds(counts)
    no = (top <= 0) | (size == 0) | (top < m.least[np.searchsorted(m.edges, size, side="right")])
    top = np.maximum(top, 0)
    lang = [None if r else m.langs[b] for b, r in zip(best, no)]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(top, 5).astype(np.float64)), pa.array(np.round(np.maximum(top - np.maximum(second, 0), 0), 5).astype(np.float64)), pa.array(no)],
        names=["doc_id", "language", "cosine", "margin", "rejected"],
    )


def model_for(spark: SparkSession, sf_dir: str) -> Centroids:
    return fit_on_labels(table(spark, sf_dir, "documents"))
