"""Toxic spans and documents by a linear-chain conditional random field.

The chain has two labels, toxic and other, over the words of a sentence.  Its
features are hashed names of the word, its prefixes and suffixes and its two
neighbours; everything is array arithmetic over word names, no Python per word.
Training needs labelled tokens: words of toxic-labelled documents that carry a
feature significantly bound to that label (likelihood ratio against the number
of features tried) are the toxic ones, all other words are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm._kernels import U64, Words, char_positions, mix, ragged_arange, slices
from chronotext.llm._spark import table
from chronotext.llm.minhash_dedup import band_keys, signatures

TABLE_BITS = 22
PREFIXES = (5, 6, 7, 8, 9)
SUFFIXES = (4, 6)
#: words of a chain that are worked through together; longer chains carry their messages from piece to piece
PIECE = 128
#: training sample: rows of either label, bytes of their texts, chains without a toxic word
MAX_TOXIC, MAX_OTHER, MAX_BYTES, QUIET_CHAINS = 1000, 3000, 48 << 20, 12_000
_BREAK = np.zeros(256, dtype=bool)
for _c in b".!?\n\r":
    _BREAK[_c] = True


@dataclass
class Crf:
    """cells, weights: the non-zero part of the hashed weight table; trans[i, j]: score of label j after label i."""

    cells: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    min_words: float = 1.0
    min_share: float = 0.0

    def dense(self) -> np.ndarray:
        t = np.zeros(1 << TABLE_BITS, dtype=np.float32)
        t[self.cells] = self.weights
        return t


def _blocks(w: Words, max_bytes: int) -> Iterator[Words]:
    """The words of runs of whole texts of about max_bytes each; a longer text is alone."""
    n, a = len(w.offsets) - 1, 0
    while a < n:
        b = min(max(int(np.searchsorted(w.offsets, w.offsets[a] + max_bytes, side="right")) - 1, a + 1), n)
        own, lo, hi = Words.__new__(Words), w.offsets[a], w.offsets[b]
        own.data, own.offsets = w.data[lo:hi], w.offsets[a : b + 1] - lo
        own.start, own.end = w.start[w.first[a] : w.first[b]] - lo, w.end[w.first[a] : w.first[b]] - lo
        own.first = w.first[a : b + 1] - w.first[a]
        yield own
        a = b


def word_features(w: Words, max_bytes: int = 1 << 20) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Names: of each word, of its prefixes and suffixes; 0 where a word is no longer than the affix.

    Names don't depend on the place, so large samples are named in blocks: sums
    and powers are eight bytes for each byte of text.
    """
    if len(w.data) > max_bytes and len(w.offsets) > 2:
        parts = [(x, *p, *s) for x, p, s in (word_features(b, max_bytes) for b in _blocks(w, max_bytes))]
        word, *rest = (np.concatenate(c) for c in zip(*parts))
        return word, rest[: len(PREFIXES)], rest[len(PREFIXES) :]
    sums = w.prefix_sums()
    size = w.end - w.start
    word = w.span_hash(sums, w.start, w.end)
    pre, suf = [], []
    for k in PREFIXES:
        h = w.span_hash(sums, w.start, np.minimum(w.start + k, w.end))
        pre.append(np.where(size > k, mix(h + U64(k)), U64(0)))
    for k in SUFFIXES:
        h = w.span_hash(sums, np.maximum(w.end - k, w.start), w.end)
        suf.append(np.where(size > k, mix(h + U64(100 + k)), U64(0)))
    return word, pre, suf


def _cell(h: np.ndarray) -> np.ndarray:
    c = (h >> U64(64 - TABLE_BITS)).astype(np.int64)
    return np.where(h == 0, 0, c)


def chains(w: Words) -> np.ndarray:
    """First word of each chain, a sentence of any length; one more entry closes the last."""
    n = len(w)
    if not n:
        return np.zeros(1, dtype=np.int64)
    breaks = np.zeros(len(w.data) + 1, dtype=np.int32)
    np.cumsum(_BREAK[w.data], out=breaks[1:])
    new = np.ones(n, dtype=bool)
    new[1:] = breaks[w.start[1:]] > breaks[w.end[:-1]]
    new[w.first[:-1][w.first[:-1] < n]] = True
    return np.r_[np.flatnonzero(new), n]


def _cells_of(w: Words, first: np.ndarray) -> np.ndarray:
    """Table cells, one row for each feature: word, affixes, neighbour before, neighbour after."""
    word, pre, suf = word_features(w)
    n = len(word)
    head = np.zeros(n, dtype=bool)
    head[first[:-1]] = True
    before, after = np.zeros_like(word), np.zeros_like(word)
    if n:
        before[1:] = mix(word[:-1] + U64(1001))
        before[head] = 0
        after[:-1] = mix(word[1:] + U64(1002))
        after[:-1][head[1:]] = 0
    return np.stack([_cell(h).astype(np.int32) for h in (word, *pre, *suf, before, after)])


def emissions(cells: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    e = np.full(cells.shape[1], bias, dtype=np.float64)
    for row in cells:
        e += weights[row]
    return e


def _messages(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward log-odds of each word, over all chains at once, one time step after another.

    A step maps the odds before to (t01 + t11 x) / (t00 + t10 x) times the word's
    own: a product of 2x2 matrices.  The pieces of long chains are multiplied out
    side by side, then each gets what comes in from the piece before it.
    """
    a = np.empty_like(e)
    size = np.diff(first)
    if not len(size):
        return a
    t = np.exp(trans)
    pieces = -(-size // PIECE)
    chain, place = np.repeat(np.arange(len(size)), pieces), ragged_arange(pieces)
    start = first[:-1][chain] + place * PIECE
    length = np.minimum(first[1:][chain] - start, PIECE)
    before = np.full(len(start), np.nan)
    going_on = np.flatnonzero(place < pieces[chain] - 1)
    if len(going_on):
        m = np.zeros((2, 2, len(going_on)))  # rows: numerator and denominator of the odds after, by those before
        m[0, 0] = m[1, 1] = 1
        heads = place[going_on] == 0
        for k in range(PIECE):
            x = np.exp(np.clip(e[start[going_on] + k], -50, 50))
            num, den = x * (t[0, 1] * m[1] + t[1, 1] * m[0]), t[0, 0] * m[1] + t[1, 0] * m[0]
            if k == 0:  # nothing comes before a chain's first word
                num[:, heads], den[:, heads] = np.stack([0 * x, x])[:, heads], np.array([[0.0], [1.0]])
            m = np.stack([num, den]) / np.maximum(num, den).max(axis=0)
        order = np.argsort(place[going_on], kind="stable")
        cut = np.searchsorted(place[going_on][order], np.arange(int(place.max()) + 1))
        for lo, hi in zip(cut, np.r_[cut[1:], len(order)]):
            own = order[lo:hi]
            odds = np.exp(np.clip(np.nan_to_num(before[going_on[own]]), -50, 50))
            num, den = m[:, 0, own] * odds + m[:, 1, own]
            before[going_on[own] + 1] = np.log(np.maximum(num, 1e-300)) - np.log(np.maximum(den, 1e-300))
    order = np.argsort(-length, kind="stable")
    start, length, before = start[order], length[order], before[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    for k in range(length[0]):
        at = start[: live[k]] + k
        x = np.exp(np.clip(a[at - 1] if k else before, -50, 50))
        step = np.log((t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))
        a[at] = e[at] + (step if k else np.nan_to_num(step))
    return a


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains.

    e: log-odds of the toxic label for each word.  Returns the marginal log-odds
    of each word, and the forward and backward parts.  Both messages are kept as
    the log-odds between the two labels, which is all the marginals need.
    """
    a = _messages(e, first, trans)
    # backwards it is the same with the labels of a transition exchanged
    b = _messages(e[::-1], (first[-1] - first)[::-1], trans.T)[::-1] - e
    return a + b, a, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(cells: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 60, l2: float = 0.5, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Maximum likelihood by Adam on the whole batch: (table cells, their weights, bias, trans)."""
    used, where = np.unique(cells, return_inverse=True)
    where = where.reshape(cells.shape).astype(np.int32)
    dead = int(np.searchsorted(used, 0)) if 0 in used else -1
    n = cells.shape[1]
    theta = np.zeros(len(used) + 5)
    theta[-5] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1]] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    for epoch in range(1, epochs + 1):
        trans = theta[-4:].reshape(2, 2)
        e = theta[where[0]]
        for row in where[1:]:
            e += theta[row]
        e += theta[-5]
        log_odds, a, b = marginals(e, first, trans)
        p = _sigmoid(log_odds)
        grad = np.zeros_like(theta)
        err = p - y
        for row in where:
            grad[: len(used)] += np.bincount(row, weights=err, minlength=len(used))
        grad[-5] = err.sum()
        # joint marginals of neighbours, from the forward log-odds before and the backward log-odds after
        s = np.zeros((2, 2, len(inner)))
        for i in (0, 1):
            for j in (0, 1):
                s[i, j] = i * a[inner - 1] + trans[i, j] + j * (e[inner] + b[inner])
        s -= s.max(axis=(0, 1))
        q = np.exp(s)
        q /= q.sum(axis=(0, 1))
        grad[-4:] = (q.sum(axis=2) - seen).ravel()
        grad[: len(used)] += l2 * theta[: len(used)]
        grad /= n
        if dead >= 0:
            grad[dead] = 0
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
        if dead >= 0:
            theta[dead] = 0
    return used, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)


def one_per_family(texts: pa.Array) -> np.ndarray:
    """Indices of texts that share no MinHash band with an earlier kept one: copies must not vote twice."""
    seen: set[int] = set()
    kept, done = [], 0
    for piece in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        sig, has = signatures(piece.column("text"), 32)
        keys = band_keys(sig, 8)
        for i in np.flatnonzero(has):
            own = keys[i].tolist()
            if seen.isdisjoint(own):
                kept.append(done + i)
            seen.update(own)
        done += piece.num_rows
    return np.array(kept, dtype=np.int64)


def token_labels(w: Words, toxic: np.ndarray) -> np.ndarray:
    """1 for each word of a toxic document that has a feature bound to the toxic label."""
    families = np.zeros((1 + len(PREFIXES), len(w)), dtype=U64)
    done = 0
    for own in _blocks(w, 1 << 20):
        word, pre, _ = word_features(own)
        families[:, done : done + len(own)] = [mix(word), *pre]
        done += len(own)
    owner = w.text_of_word().astype(np.int32)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    rate = n_bad / (n_bad + n_good)
    counts = []
    for h in families:
        order = np.argsort(h, kind="stable").astype(np.int32)  # words stand by document, so equal names do too
        order = order[len(h) - np.count_nonzero(h) :]
        name, doc = h[order], owner[order]
        del order
        once = np.ones(len(name), dtype=bool)
        once[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        name, doc = name[once], doc[once]
        begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        n = np.diff(np.r_[begin, len(name)])
        bad = np.add.reduceat(toxic[doc], begin) if len(begin) else begin
        often = n >= 3
        counts.append((name[begin][often], bad[often], (n - bad)[often]))
    tried = sum(len(names) for names, _, _ in counts)
    y = np.zeros(len(w), dtype=np.int64)
    for h, (names, bad, good) in zip(families, counts):
        n = bad + good
        share = np.clip(bad / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        gain = bad * np.log(share / rate) + good * np.log((1 - share) / (1 - rate))
        fair = (bad / n_bad) / (bad / n_bad + good / n_good + 1e-12)
        strong = names[(share > rate) & (fair >= 0.9) & (gain > np.log(max(tried, 2)) + 2)]
        if len(strong):  # names stand in order
            y |= strong[np.minimum(np.searchsorted(strong, h), len(strong) - 1)] == h
    return y & toxic[owner]


def train(texts: pa.Array, toxic: list[int], seed: int = 11, quiet_chains: int = QUIET_CHAINS) -> Crf:
    """A field from labelled documents; a third of them is held out to set the document thresholds.

    All chains with a toxic word are learned from, and of the others four times as
    many, quiet_chains at least.  Without any toxic label, or without any feature
    bound to it, nothing is ever toxic.
    """
    arr = pc.fill_null(texts, "")
    label = np.array([int(bool(x)) for x in toxic], dtype=np.int64)
    kept = one_per_family(arr) if len(arr) else np.zeros(0, np.int64)
    arr, label = arr.take(pa.array(kept)), label[kept]
    none = Crf(np.zeros(1, np.int64), np.zeros(1), -30.0, np.zeros((2, 2)), float("inf"))
    if not label.any():
        return none
    rng = np.random.default_rng(seed)
    w = Words(arr)
    y = token_labels(w, label)
    if not y.any():
        return none
    first = chains(w)
    held = rng.random(len(arr)) < 1 / 3
    c_owner = np.searchsorted(w.first, first[:-1], side="right") - 1
    c_toxic = np.add.reduceat(y, first[:-1]) > 0
    pick = np.flatnonzero(c_toxic & ~held[c_owner])
    rest = np.flatnonzero(~c_toxic & ~held[c_owner])
    rest = rng.permutation(rest)[: max(4 * len(pick), quiet_chains)]
    pick = np.sort(np.r_[pick, rest])
    size = np.diff(first)[pick]
    words = np.repeat(first[:-1][pick], size) + ragged_arange(size)
    cells, done = [], 0
    for own in _blocks(w, 1 << 20):
        lo, hi = np.searchsorted(words, [done, done + len(own)])
        cells.append(_cells_of(own, chains(own))[:, words[lo:hi] - done])
        done += len(own)
    used, weights, bias, trans = fit(np.concatenate(cells, axis=1), np.r_[0, np.cumsum(size)], y[words])
    del cells
    big = np.abs(weights) > 1e-3
    crf = Crf(used[big], weights[big].astype(np.float32), bias, trans)
    table_ = crf.dense()
    score = np.concatenate([_said(own, table_, crf)[1] for own in _blocks(w, 1 << 20)])
    share = score / np.maximum(np.diff(w.first), 1)
    if not (held & (label == 1)).any():
        held[:] = True
    tried = []
    for at_least in (0.5, 1, 1.5, 2, 2.5, 3, 4):
        for part in (0.0, 0.0005, 0.001, 0.002, 0.004):
            said = (score >= at_least) & (share >= part)
            hit = (said & (label == 1) & held).sum()
            tried.append((2 * hit / max(1, (said & held).sum() + ((label == 1) & held).sum()), at_least, part))
    top = max(t[0] for t in tried)
    equal = [t for t in tried if t[0] >= top - 1e-9]
    margin = sorted({t[1] for t in equal})
    crf.min_words = margin[len(margin) // 2]  # of equal ones the middle count, then the least share
    crf.min_share = min(t[2] for t in equal if t[1] == crf.min_words)
    return crf


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER, max_bytes: int = MAX_BYTES) -> Crf:
    """Trains on at most max_toxic + max_other labelled rows, chosen by a hash of their id, whole texts of max_bytes together.

    A text that would exceed max_bytes is passed over.  Null ids and labels are
    left out; an id with both labels counts for both; of several texts of an id the
    least is taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").distinct()
    mark = F.xxhash64("id")
    some = rows.where("toxic = 1").orderBy(mark, "id").limit(max_toxic).union(rows.where("toxic = 0").orderBy(mark, "id").limit(max_other))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    chosen = texts.join(F.broadcast(some.select("id").distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    sized = chosen.withColumn("size", F.octet_length("text")).withColumn("mark", mark)
    upto = F.sum(F.col("size").cast("long")).over(Window.orderBy("mark", "id"))  # some thousand rows
    got = sized.withColumn("upto", upto).where(F.col("upto") <= max_bytes).join(F.broadcast(some), "id").select("id", "text", "toxic").orderBy("id", "text", "toxic").toArrow()
    return train(got.column("text").combine_chunks(), got.column("toxic").to_pylist())


def _said(w: Words, table_: np.ndarray, crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each word, and the score of each text."""
    first = chains(w)
    p = _sigmoid(marginals(emissions(_cells_of(w, first), table_, crf.bias), first, crf.trans)[0])
    return p, np.bincount(w.text_of_word(), weights=p * (p > 0.5), minlength=len(w.first) - 1)


def _score(texts: pa.Array, table_: np.ndarray, crf: Crf) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    w = Words(texts)
    p, score = _said(w, table_, crf)
    share = score / np.maximum(np.diff(w.first), 1)
    return w, p, score, (score >= crf.min_words) & (share >= crf.min_share)


def toxic_spans(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic, spans) of each document that the model rejects.

    score: the expected number of toxic words among those with a marginal above
    one half; sentences are chains of any length.  spans: the offending words as (start, end, p), in characters of
    the text; neighbouring offending words are one span with the largest p.
    The offsets are those of the lower-cased text where lower-casing changes a
    length (some dotted capital letters).

    Null and empty texts are never toxic.  A null id is kept as null.  Repeated
    rows each give a row.  Whole texts are scored, however long.  No documents
    give no rows; no labels give a model that rejects nothing.  Other columns
    are ignored.  Ids are cast to long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = model.dense()
        for batch in batches:
            for piece in slices(batch, "text"):
                w, p, score, bad = _score(piece.column("text"), weights, model)
                at = np.flatnonzero(bad)
                spans = []
                for i in at:
                    lo, hi = w.first[i], w.first[i + 1]
                    hit = np.flatnonzero(p[lo:hi] > 0.5) + lo
                    run = np.r_[0, np.flatnonzero(np.diff(hit) > 1) + 1]
                    ends = np.r_[run[1:], len(hit)] - 1
                    origin = w.offsets[i]
                    text = w.data[origin : w.offsets[i + 1]].tobytes()
                    s = char_positions(text, w.start[hit[run]] - origin)
                    e = char_positions(text, w.end[hit[ends]] - origin)
                    top = np.maximum.reduceat(p[hit], run)
                    spans.append([{"start": int(x), "end": int(z), "p": round(float(q), 6)} for x, z, q in zip(s, e, top)])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(at)), pa.array(np.round(score[at], 6)), pa.array(np.ones(len(at), bool)), pa.array(spans, kind)],
                    names=["doc_id", "score", "toxic", "spans"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(find, "doc_id long, score double, toxic boolean, spans array<struct<start:int,end:int,p:double>>")


def drop_toxic(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects: one pass, no shuffle, all columns kept.

    Rows with a null or empty text stay, and so do rows with a null id that aren't
    toxic; repeated rows are judged one by one, by their whole texts.  No rows give
    no rows; a model without labels drops nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = model.dense()
        for batch in batches:
            for piece in slices(batch, text_col):
                yield piece.filter(pa.array(~_score(piece.column(text_col), weights, model)[3]))

    return docs.mapInArrow(keep, docs.schema)


def model_for(spark: SparkSession, sf_dir: str) -> Crf:
    return fit_on_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
