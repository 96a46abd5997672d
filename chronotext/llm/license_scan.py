"""License wordings in documents, by token automata compiled from template markup."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm._kernels import slices
from chronotext.llm.license_templates import TEMPLATES

_MARK = re.compile(r'<<(beginOptional|endOptional|var;name="([^"]*)";original="([^"]*)";match="([^"]*)")>>')
_TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_ANYTHING = re.compile(r"\.(?:([*+])|\{(\d*),(\d*)\})")
#: spellings that count as one
_SAME = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "maximise": "maximize", "merchantibility": "merchantability", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: two words that count as one, written with a hyphen, a space or neither
_PAIRS = {("non", "commercial"): "noncommercial", ("sub", "license"): "sublicense", ("sub", "licenses"): "sublicenses", ("sub", "licensed"): "sublicensed", ("non", "infringement"): "noninfringement", ("per", "cent"): "percent", ("third", "parties"): "thirdparties"}


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): lower-cased words and dotted numbers, equal spellings as one; signs and spacing don't count."""
    out: list[tuple[str, int, int]] = []
    for m in _TOKEN.finditer(text):
        w = m.group().lower()
        w = _SAME.get(w, w)
        if out and (out[-1][0], w) in _PAIRS:
            out[-1] = _PAIRS[out[-1][0], w], out[-1][1], m.end()
        else:
            out.append((w, m.start(), m.end()))
    return out


class Region:
    """What a replaceable region accepts: words joined by single spaces, of any number that its expression allows."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = pattern
        m = _ANYTHING.fullmatch(pattern)
        self.any = m is not None
        if m:
            self.least = int(m.group(2) or 0) if m.group(1) is None else int(m.group(1) == "+")
            self.most = int(m.group(3)) if m.group(3) else math.inf
        else:
            self.match = regex.compile(pattern, regex.I | regex.S).fullmatch

    def takes(self, words: list[str], upto: list[int], a: int, b: int) -> tuple[bool, bool]:
        """(accepts words[a:b], could accept more); upto: signs of the words before each."""
        if self.any:
            n = upto[b] - upto[a] + max(0, b - a - 1)
            return self.least <= n <= self.most, n < self.most
        m = self.match(" ".join(words[a:b]), partial=True)
        return m is not None and not m.partial, m is not None


@dataclass
class Automaton:
    """Instructions: ("tok", word) consumes that word; ("var", region) consumes any number of words that the region
    accepts; ("split", a, b) goes on at both; ("jump", a); ("accept",)."""

    name: str
    kind: str
    code: list[tuple] = field(default_factory=list)
    anchor: str = ""

    def closure(self, pcs) -> list[int]:
        seen, todo = {}, list(pcs)[::-1]
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen[p] = True
            op = self.code[p]
            if op[0] == "split":
                todo += [op[2], op[1]]
            elif op[0] == "jump":
                todo.append(op[1])
        return list(seen)

    def heads(self) -> set[str] | None:
        """Words that an accepted text can begin with; None if it can begin with a replaceable region."""
        out = set()
        for p in self.closure([0]):
            op = self.code[p]
            if op[0] == "var":
                return None
            if op[0] == "tok":
                out.add(op[1])
        return out

    def longest(self, words: list[str], at: int, upto: list[int] | None = None) -> int | None:
        """End of the longest accepted run of words from `at` on."""
        upto = lengths(words) if upto is None else upto
        best = None
        # a thread is (instruction, first word of the region it is in or -1)
        threads = self._enter([(p, -1) for p in self.closure([0])], words, upto, at)
        i = at
        while threads:
            if any(self.code[p][0] == "accept" for p, _ in threads):
                best = i
            if i >= len(words):
                break
            w = words[i]
            nxt = []
            for p, since in threads:
                op = self.code[p]
                if op[0] == "tok":
                    if op[1] == w:
                        nxt += [(q, -1) for q in self.closure([p + 1])]
                elif op[0] == "var":
                    nxt.append((p, i if since < 0 else since))
            i += 1
            threads = self._enter(nxt, words, upto, i)
        return best

    def _enter(self, threads: list[tuple[int, int]], words: list[str], upto: list[int], i: int) -> list[tuple[int, int]]:
        """Adds what follows a region that may end before word i; regions that can't go on are left out."""
        seen = dict.fromkeys(threads)
        todo, over = list(seen), []
        while todo:
            p, since = todo.pop()
            op = self.code[p]
            if op[0] != "var":
                continue
            done, more = op[1].takes(words, upto, i if since < 0 else since, i)
            if not more and since >= 0:
                over.append((p, since))
            if done:
                for t in ((q, -1) for q in self.closure([p + 1])):
                    if t not in seen:
                        seen[t] = None
                        todo.append(t)
        for t in over:
            del seen[t]
        return list(seen)


def lengths(words: list[str]) -> list[int]:
    """Signs of all words before each, and of all of them."""
    return [0, *accumulate(map(len, words))]


def compile_template(name: str, kind: str, template: str) -> Automaton:
    """Parses the markup; unbalanced optional regions are an error."""
    a = Automaton(name, kind)
    opened: list[int] = []
    must: list[str] = []

    def words(text: str) -> None:
        for w, _, _ in tokens(text):
            a.code.append(("tok", w))
            if not opened:
                must.append(w)

    at = 0
    for m in _MARK.finditer(template):
        words(template[at : m.start()])
        at = m.end()
        if m.group(1) == "beginOptional":
            opened.append(len(a.code))
            a.code.append(("split",))
        elif m.group(1) == "endOptional":
            if not opened:
                raise ValueError(f"{name}: an optional region ends that hasn't begun")
            p = opened.pop()
            a.code[p] = ("split", p + 1, len(a.code))
        else:
            a.code.append(("var", Region(m.group(4))))
    if opened:
        raise ValueError(f"{name}: an optional region doesn't end")
    words(template[at:])
    if not must:
        raise ValueError(f"{name}: nothing is mandatory")
    a.code.append(("accept",))
    telling = [w for w in must if w in ("license", "spdx", "permission", "redistribution", "public", "mozilla", "warranty", "cc", "gnu", "apache", "creative")]
    a.anchor = max(telling or must, key=len)
    return a


class Scanner:
    """All automata, what can begin them, and a quick test that passes over texts without any anchor word."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.automata = [compile_template(*t) for t in templates]
        self.by_head: dict[str, list[int]] = {}
        self.free: list[int] = []
        for k, a in enumerate(self.automata):
            heads = a.heads()
            if heads is None:
                self.free.append(k)
            for h in heads or ():
                self.by_head.setdefault(h, []).append(k)
        spellings = {a.anchor for a in self.automata}
        spellings |= {old for old, new in _SAME.items() if new in spellings}
        spellings |= {first for (first, _), new in _PAIRS.items() if new in spellings}
        self.hint = "(?i)" + "|".join(sorted(map(re.escape, spellings)))

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(automaton, start, end): longest matches of each automaton, from left to right, not overlapping one another."""
        toks = tokens(text)
        words = [t[0] for t in toks]
        upto_sign = lengths(words)
        have = set(words)
        able = {k for k, a in enumerate(self.automata) if a.anchor in have}
        upto = dict.fromkeys(able, 0)
        out = []
        if not able:
            return out
        for i, w in enumerate(words):
            for k in (*self.by_head.get(w, ()), *self.free):
                if k in able and i >= upto[k]:
                    end = self.automata[k].longest(words, i, upto_sign)
                    if end is not None and end > i:
                        upto[k] = end
                        out.append((k, toks[i][1], toks[end - 1][2]))
        # a notice inside a full text of any license is part of it
        full = [(s, e) for k, s, e in out if self.automata[k].kind == "text"]
        out = [h for h in out if self.automata[h[0]].kind == "text" or not any(s <= h[1] and h[2] <= e for s, e in full)]
        return sorted(out, key=lambda h: (h[1], h[2], h[0]))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, kind, start, end) of each license wording, in characters of the text.

    A wording is accepted if its mandatory words are there exactly, in order and
    without others between, whatever the case, signs and spacing; optional
    regions may be missing, replaceable ones hold what their expression accepts.

    kind: "text" (a license's whole wording), "header" (the notice that it asks for
    in files), "notice" (a sentence that names it) or "tag".

    Null and empty texts have no rows; null ids stay null; repeated rows each
    give theirs.  Of wordings that one template accepts from one place the
    longest is reported, and a template's matches don't overlap; different
    templates each report, but for what lies within a whole wording: it is part of
    that one.  Regions may be as long as their expression allows.  Whole texts are
    scanned.  Empty tables give no rows; other columns are ignored.  Ids are cast to
    long.
    """
    scanner = Scanner(templates)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch in batches:
            for piece in slices(batch, "text"):
                some = piece.filter(pc.fill_null(pc.match_substring_regex(piece.column("text"), s.hint), False))
                ids, name, kind, start, end = [], [], [], [], []
                for i, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    for k, a, b in s.scan(text):
                        ids.append(i)
                        name.append(s.automata[k].name)
                        kind.append(s.automata[k].kind)
                        start.append(a)
                        end.append(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(name, pa.string()), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    names=["doc_id", "license", "kind", "start", "end"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, kind string, start int, end int")
