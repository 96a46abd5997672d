"""Text normalization with the span of every token in the original text.

The default normalization has a closed form: each run of signs other than white
space is NFKC-normalized, lower-cased and stripped of what is neither letter,
digit nor underscore; its pieces between white space keep the span of the whole
run.  It runs as one map over Arrow arrays, without an exchange and without
Python objects per token.  Other rule lists go through a general span map.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_WORD = r"[^\p{L}\p{N}_\s]"
#: (pattern, replacement, literal): the default rules for a general span map
Rule = tuple[str, "str | Callable[[re.Match], str]"]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


# --- columns -----------------------------------------------------------------------------------------------------------


def normalized_text(text: Column | str) -> Column:
    """Lower case, no punctuation, single spaces, trimmed: text only, all on the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), NOT_WORD, ""), r"\s+", " "))


def rewrite(text: Column | str, rules: Sequence[tuple[str, str]], literal: bool = False) -> Column:
    """Applies (pattern, replacement) rules one after another where no spans are needed; replacements are literal text.

    Patterns are Java expressions; with literal=True they are plain text.
    """
    text = F.col(text) if isinstance(text, str) else text
    for pattern, replacement in rules:
        if literal:
            text = F.replace(text, F.lit(pattern), F.lit(replacement))
        else:
            text = F.regexp_replace(text, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def fold_case(text: Column | str, case: str) -> Column:
    """Newlines as spaces and the case of the vocabulary: "lower", "upper" or "mixed" (kept)."""
    text = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\n"), F.lit(" "))
    return {"lower": F.lower, "upper": F.upper, "mixed": lambda c: c}[case](text)


def vocabulary_case(vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """One row, column case: "lower", "upper" or "mixed" by the single letters of a vocabulary; "lower" without any."""
    letters = vocab.where(F.length(token_col) == 1).where(F.lower(token_col) != F.upper(token_col))
    return letters.agg(
        F.when(F.count("*") == 0, "lower")
        .when(F.bool_and(F.col(token_col) == F.lower(token_col)), "lower")
        .when(F.bool_and(F.col(token_col) == F.upper(token_col)), "upper")
        .otherwise("mixed")
        .alias("case")
    )


def no_leading_space(text: Column | str) -> Column:
    """The text; an error if it begins with white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^\s"), F.raise_error(F.lit("text begins with white space"))).otherwise(text)


# --- default token map ---------------------------------------------------------------------------------------------------


def _spaces(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, by the same signs as Python's str.isspace."""
    s = _SPACE[b]
    if len(b) > 1 and (b >= 0xC2).any():
        two = np.flatnonzero((b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0)))
        s[two] = s[two + 1] = True
        if len(b) > 2:
            x, y, z = b[:-2], b[1:-1], b[2:]
            three = np.flatnonzero(
                ((x == 0xE1) & (y == 0x9A) & (z == 0x80))
                | ((x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)))
                | ((x == 0xE2) & (y == 0x81) & (z == 0x9F))
                | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
            )
            s[three] = s[three + 1] = s[three + 2] = True
    return s


def _places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each text's first byte, code points before each byte, and (text index, first byte, end byte) of each run between white space."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    space = _spaces(b)
    inside = ~space
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    cut = off[:-1]
    before[cut[cut < len(b)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:] & before[1:]
    end = np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(off, start, side="right") - 1
    points = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=points[1:])
    return b, off, points, owner, start, end


def picked(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The strings between bytes lo and hi of b."""
    size = hi - lo
    bounds = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    packed = b[np.repeat(lo - bounds[:-1], size) + np.arange(int(bounds[-1]))] if len(lo) else b[:0]
    return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))])


def runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Runs between white space: (text index, run, start, end), offsets in code points of the text."""
    b, off, points, owner, start, end = _places(texts)
    origin = points[off[owner]] if len(owner) else owner
    return owner, picked(b, start, end), points[start] - origin, points[end] - origin


def _normalized(texts: pa.Array, owner: np.ndarray, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Normalized tokens of runs and the run of each."""
    strange = [i for i, t in enumerate(texts.to_pylist()) if t and not unicodedata.is_normalized("NFKC", t)]
    if strange:
        at = np.flatnonzero(np.isin(owner, strange))
        words_ = words.to_pylist()
        for i in at.tolist():
            words_[i] = unicodedata.normalize("NFKC", words_[i])
        composed = pa.array(words_, pa.large_string())
    else:
        composed = words
    norm = pc.replace_substring_regex(pc.utf8_lower(composed), pattern=NOT_WORD, replacement="")
    # normalizing can bring in white space: such a run is several tokens with one span
    pieces = pc.utf8_split_whitespace(norm)
    at = np.asarray(pc.list_parent_indices(pieces))
    flat = pc.list_flatten(pieces)
    live = np.flatnonzero(np.asarray(pc.utf8_length(flat)) > 0)
    return flat.take(pa.array(live)), at[live]


def default_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(text index, position, normalized token, original text, start, end) of every token."""
    owner, words, start, end = runs(texts)
    flat, at = _normalized(texts, owner, words)
    owner = owner[at]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    pos = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return owner, pos, flat, words.take(pa.array(at)), start[at], end[at]


#: a map over texts takes so many bytes of them at once, or one text
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text_col: str = "__text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some `size` bytes of text: what a map holds doesn't grow with the rows of a batch."""
    size = size or SLICE_BYTES
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def with_following(texts: pa.Array, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Extended end and full text of each token: up to the next token with another span, or to the text's end."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(owner)
    ext = size[owner] if n else owner
    if n:
        new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        nxt = np.r_[head[1:], n]
        inner = (nxt < n) & (owner[np.minimum(nxt, n - 1)] == owner[head])
        stop = np.where(inner, start[np.minimum(nxt, n - 1)], size[owner[head]])
        ext = stop[group]
    full, strings = [], {}
    for i, a, b in zip(owner.tolist(), start.tolist(), ext.tolist()):
        if i not in strings:
            strings = {i: texts[i].as_py() or ""}
        full.append(strings[i][a:b])
    return ext, pa.array(full, pa.string())


FOLLOWING_FIELDS = [T.StructField("end_char_extended", T.IntegerType()), T.StructField("text_span_full", T.StringType())]
TOKEN_FIELDS = [
    T.StructField("tok_pos", T.IntegerType()),
    T.StructField("normalized_token", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
]


def _token_batch(keys: pa.RecordBatch, key_cols: list[str], owner, pos, norm, text, start, end) -> pa.RecordBatch:
    rows = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [*(keys.column(c).take(rows) for c in key_cols), pa.array(pos.astype(np.int32)), norm.cast(pa.string()), text.cast(pa.string()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
        names=[*key_cols, *(f.name for f in TOKEN_FIELDS)],
    )


def token_map(texts: DataFrame, key_cols: Sequence[str], text_col: str = "text", deletions: bool = False) -> DataFrame:
    """Normalized tokens of each text with their place in it: keys, tok_pos, normalized_token, text, start_char, end_char.

    With deletions also end_char_extended and text_span_full: what follows a
    token and was dropped belongs to it.  Taken here because the text is at hand:
    no token row ever carries its document.
    """
    keys = list(key_cols)
    slim = texts.select(*keys, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = default_tokens(part.column("__text"))
                out = _token_batch(part, keys, *found)
                if deletions:
                    ext, full = with_following(part.column("__text"), found[0], found[4], found[5])
                    out = out.append_column("end_char_extended", pa.array(ext.astype(np.int32))).append_column("text_span_full", full)
                yield out

    return slim.mapInArrow(run, T.StructType([slim.schema[k] for k in keys] + TOKEN_FIELDS + FOLLOWING_FIELDS * deletions))


# --- general span map ------------------------------------------------------------------------------------------------------


class SpanMap:
    """A text under rewriting, with the original span of every character held in two integer arrays."""

    def __init__(self, text: str):
        self.original = self.text = text
        self.lo = np.arange(len(text), dtype=np.int64)
        self.hi = self.lo + 1

    def rewrite(self, pattern: str, replacement: str | Callable[[re.Match], str]) -> "SpanMap":
        """Replaces each match; all characters of a replacement get the span of the whole match, literal text included.

        An empty match stands for the empty span at its place, at the end for the end of the original.
        """
        pieces, first, last, size, done = [], [], [], [], 0
        text = self.text
        for m in re.finditer(pattern, text):
            a, b = m.span()
            new = replacement(m) if callable(replacement) else replacement
            if b - a == 1 and new == text[a]:
                continue  # the same sign with the same span
            pieces += [text[done:a], new]
            first.append(a)
            last.append(b)
            size.append(len(new))
            done = b
        if not pieces:
            return self
        pieces.append(text[done:])
        a, b, n = (np.array(x, dtype=np.int64) for x in (first, last, size))
        # kept and new pieces in turn: where each begins in the old text, and how long it is
        begin, long = np.zeros(2 * len(a) + 1, np.int64), np.empty(2 * len(a) + 1, np.int64)
        begin[2::2], begin[1::2] = b, -1
        long[0::2], long[1::2] = np.r_[a, len(text)] - begin[0::2], n
        kept = np.repeat(begin >= 0, long)
        lo, hi = np.empty(len(kept), np.int64), np.empty(len(kept), np.int64)
        at = (np.repeat(begin - np.r_[0, np.cumsum(long)[:-1]], long) + np.arange(len(kept)))[kept]
        lo[kept], hi[kept] = self.lo[at], self.hi[at]
        start = np.r_[self.lo, len(self.original)][a]
        lo[~kept] = np.repeat(start, n)
        hi[~kept] = np.repeat(np.where(a < b, np.r_[0, self.hi][b], start), n)
        self.text, self.lo, self.hi = "".join(pieces), lo, hi
        return self

    def places(self, level: str = "word") -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """Tokens, their original texts, starts and ends: words or characters other than white space."""
        if level not in ("word", "char"):
            raise ValueError("level is word or char")
        found = [(m.group(), *m.span()) for m in re.finditer(r"\S+" if level == "word" else r"\S", self.text)]
        names, a, b = zip(*found) if found else ((), (), ())
        lo, hi = self.lo[np.array(a, dtype=np.int64)], self.hi[np.array(b, dtype=np.int64) - 1]
        return list(names), [self.original[x:y] for x, y in zip(lo.tolist(), hi.tolist())], lo, hi

    def tokens(self, level: str = "word") -> list[tuple[str, str, int, int]]:
        """(token, original text, start, end) for each word or character other than white space."""
        names, text, lo, hi = self.places(level)
        return list(zip(names, text, lo.tolist(), hi.tolist()))


def _lower(m: re.Match) -> str:
    return m.group().lower()


def _nfkc(m: re.Match) -> str:
    return unicodedata.normalize("NFKC", m.group())


DEFAULT_RULES: list[Rule] = [(r"\S+", _nfkc), (r"\S+", _lower), (r"[^\w\s]", ""), (r"\s+", " "), (r"\A\s+|\s+\Z", "")]
#: drops bracketed remarks, lone punctuation, other punctuation; single spaces; lower case
TRANSCRIPT_RULES: list[Rule] = [(r"\(.*?\)", ""), (r"\s[^\s\w]\s", " "), (r"[^\s\w]+", ""), (r"\s+", " "), (r"\A\s+|\s+\Z", ""), (r"\w+", _lower)]


def expansions(table: dict[str, str]) -> list[Rule]:
    """Rules from plain text to its expansion, the longest first."""
    return [(re.escape(k), v) for k, v in sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0]))]


def token_map_with(texts: DataFrame, rules: Sequence[Rule], key_cols: Sequence[str], text_col: str = "text", level: str = "word") -> DataFrame:
    """token_map() under any rules: patterns of Python's re with literal or callable replacements."""
    keys, rules = list(key_cols), list(rules)
    slim = texts.select(*keys, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, original, start, end, n = [], [], [], [], []
                for text in part.column("__text").to_pylist():
                    m = SpanMap(text or "")
                    for pattern, replacement in rules:
                        m.rewrite(pattern, replacement)
                    found, own, lo, hi = m.places(level)
                    names += found
                    original += own
                    start.append(lo)
                    end.append(hi)
                    n.append(len(found))
                pos = np.concatenate([np.arange(k) for k in n])
                yield _token_batch(part, keys, np.repeat(np.arange(len(n)), n), pos, pa.array(names, pa.string()), pa.array(original, pa.string()), np.concatenate(start), np.concatenate(end))

    return slim.mapInArrow(run, T.StructType([slim.schema[k] for k in keys] + TOKEN_FIELDS))


# --- sentences ----------------------------------------------------------------------------------------------------------------

SENTENCE = r"[^.!?\n]*(?:[.!?]+[\"')\]]*|\n|\Z)\s*"


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Spans that tile a text: a sentence runs through its closing signs and the white space after them, or to a line's end."""
    return [m.span() for m in re.finditer(SENTENCE, text) if m.end() > m.start()]


def sentence_spans(texts: DataFrame, key_cols: Sequence[str], text_col: str = "text", splitter: Callable[[str], list[tuple[int, int]]] = sentences_of) -> DataFrame:
    """Spans of each text: keys, seg_pos, start_char, end_char; any function from a text to spans can split.

    One linear map without an exchange; null and empty texts have no spans.
    """
    keys = list(key_cols)
    slim = texts.select(*keys, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [(i, k, a, b) for i, t in enumerate(part.column("__text").to_pylist()) if t for k, (a, b) in enumerate(splitter(t))]
                cols = list(zip(*found)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(cols[0], pa.int64())) for c in keys), *(pa.array(c, pa.int32()) for c in cols[1:])], names=[*keys, "seg_pos", "start_char", "end_char"])

    extra = [T.StructField(n, T.IntegerType()) for n in ("seg_pos", "start_char", "end_char")]
    return slim.mapInArrow(run, T.StructType([slim.schema[k] for k in keys] + extra))

