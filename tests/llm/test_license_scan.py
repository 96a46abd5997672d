import random
import re

import pytest

from chronotext.llm.license_scan import _MARK, Scanner, compile_template, licenses, tokens
from chronotext.llm.license_templates import TEMPLATES


def as_regex(template):
    """The same language as a plain expression over tokens, each followed by one space."""
    out, at = "", 0
    words = lambda t: "".join(re.escape(w) + " " for w, _, _ in tokens(t))
    for m in _MARK.finditer(template):
        out += words(template[at : m.start()])
        at = m.end()
        if m.group(1) == "beginOptional":
            out += "(?:"
        elif m.group(1) == "endOptional":
            out += ")?"
        else:
            out += f"(?:(?:{m.group(4)}) |(?={m.group(4)}))" if re.fullmatch(m.group(4), "", re.I) else f"(?:{m.group(4)}) "
    return out + words(template[at:])


def variant(rng, template, spoil=False):
    """A text of the template: optional regions kept or not, replaceable ones as given."""
    parts, depth_keep, at = [], [True], 0
    for m in _MARK.finditer(template):
        if all(depth_keep):
            parts.append(template[at : m.start()])
        at = m.end()
        if m.group(1) == "beginOptional":
            depth_keep.append(rng.random() < 0.6)
        elif m.group(1) == "endOptional":
            depth_keep.pop()
        elif all(depth_keep):
            parts.append(" " + m.group(3) + " ")
    parts.append(template[at:])
    return " ".join(parts)


def dressed(rng, text):
    words = text.split()
    return "".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", "  ", "\n", " * "]) for w in words)


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def test_every_template_accepts_its_variants(scanner):
    rng = random.Random(1)
    for k, (name, kind, template) in enumerate(TEMPLATES):
        for _ in range(6):
            text = dressed(rng, variant(rng, template))
            a = scanner.automata[k]
            words = [t[0] for t in tokens("unrelated words before " + text + " and after")]
            ends = [a.longest(words, i) for i in range(len(words))]
            assert any(e is not None for e in ends), (name, text)


def test_one_wrong_mandatory_word_is_no_license(scanner):
    rng = random.Random(2)
    for k, (name, kind, template) in enumerate(TEMPLATES):
        must = compile_template(name, kind, template)
        plain = [i for i, op in enumerate(must.code) if op[0] == "tok"]
        optional = set()
        for i, op in enumerate(must.code):
            if op[0] == "split":
                optional |= set(range(op[1], op[2]))
        if any(op[0] == "var" and op[1].any for op in must.code):
            continue  # such a region could take the wrong word in
        for i in rng.sample([i for i in plain if i not in optional], 2):
            words = [op[1] for op in must.code if op[0] == "tok"]
            spoiled = list(words)
            spoiled[[j for j in plain].index(i)] = "zzz"
            assert must.longest(spoiled, 0) is None


def test_same_spans_as_plain_expressions(scanner):
    rng = random.Random(3)
    some = [t for t in TEMPLATES if t[1] != "text"]
    one_by_one = [(Scanner([t]), re.compile(as_regex(t[2]), re.I)) for t in some]
    for _ in range(150):
        pieces = [rng.choice(["the license", "under the", "GNU work", "cc", "released", "MIT", "a b c", "version 3", "Apache License", "licence", variant(rng, rng.choice(some)[2])]) for _ in range(rng.randint(1, 7))]
        text = dressed(rng, " ".join(pieces))
        toks = tokens(text)
        line = "".join(t[0] + " " for t in toks)
        starts = [0]
        for t in toks:
            starts.append(starts[-1] + len(t[0]) + 1)
        for s, expression in one_by_one:
            got = [(a, b) for _, a, b in s.scan(text)]
            want, i = [], 0
            while i < len(toks):
                ends = [j for j in range(i + 1, len(toks) + 1) if expression.fullmatch(line, starts[i], starts[j])]
                if ends:
                    want.append((toks[i][1], toks[ends[-1] - 1][2]))
                    i = ends[-1]
                else:
                    i += 1
            assert got == want, (text, expression.pattern)


def test_whole_wordings_are_spans_of_plain_expressions(scanner):
    """Templates of whole wordings accept the longest run that their expression accepts, from each place."""
    rng = random.Random(5)
    for k, (name, kind, template) in enumerate(TEMPLATES):
        if kind != "text" or len(template) > 8000:
            continue
        expression = re.compile(as_regex(template), re.I)
        for spoil in (False, False, True):
            words = [t[0] for t in tokens("copyright and so on " + dressed(rng, variant(rng, template)) + " the end")]
            if spoil:
                del words[rng.randrange(len(words) // 2, len(words) - 8)]
            line = "".join(w + " " for w in words)
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w) + 1)
            for i in range(0, 12):
                m = None
                for j in range(len(words), i, -1):
                    if m := expression.fullmatch(line, starts[i], starts[j]):
                        break
                assert scanner.automata[k].longest(words, i) == (j if m else None), (name, i, spoil)


def test_full_texts_are_found_whole(scanner):
    rng = random.Random(6)
    for k, (name, kind, template) in enumerate(TEMPLATES):
        if kind == "text":
            text = "Some words before it.\n" + dressed(rng, _MARK.sub(lambda m: f" {m.group(3) or str()} ", template)) + "\nother words"
            found = [(scanner.automata[j].name, a, b) for j, a, b in scanner.scan(text)]
            assert (name, 22) in {(n, a) for n, a, _ in found} and max(b for _, _, b in found) >= len(text) - 40, (name, found)


@pytest.mark.parametrize(
    "match, n, fits",
    [(".+", 9, True), (".+", 500, True), (".+", 0, False), (".*", 0, True), (".{0,2000}", 81, True), (".{0,2000}", 401, False), ("[0-9. ]+", 12, True), ("(?:word ?)*", 30, True), (".{0,20}", 4, True), (".{0,20}", 5, False)],
)
def test_regions_are_as_long_as_their_expression_allows(match, n, fits):
    a = compile_template("x", "text", f'begin here <<var;name="x";original="";match="{match}">> license ends')
    words = "begin here".split() + (["12"] if match[0] == "[" else ["word"]) * n + "license ends".split()
    assert a.longest(words, 0) == (len(words) if fits else None)


def test_copyright_of_many_holders(scanner):
    mit = next(t for n, k, t in TEMPLATES if (n, k) == ("MIT", "text"))
    rng = random.Random(7)
    body = variant(rng, mit[mit.index("Permission is hereby") :])
    text = "Copyright (c) " + ", ".join(f"20{k:02d} Holder Number{k} of Somewhere" for k in range(30)) + "\n" + body
    assert ("MIT", 0) in {(scanner.automata[k].name, a) for k, a, _ in scanner.scan(text)}


def test_spellings_that_count_as_one(scanner):
    assert [t[0] for t in tokens("Non-commercial noncommercial NON COMMERCIAL")] == ["noncommercial"] * 3
    free = next(t for n, k, t in TEMPLATES if n == "Unlicense")
    text = variant(random.Random(1), free).replace("non-commercial", "noncommercial")
    assert any(scanner.automata[k].name == "Unlicense" for k, *_ in scanner.scan(text))
    notice = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    assert [scanner.automata[k].name for k, *_ in scanner.scan(notice)] == ["MPL-2.0"]


def test_markup_errors():
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            compile_template("x", "text", bad)


def test_tag_and_odd_rows(spark, scanner):
    assert [(scanner.automata[k].name, a, b) for k, a, b in scanner.scan("// SPDX-License-Identifier: Apache-2.0\nfoo")] == [("SPDX", 3, 38)]
    rows = [(1, "x\nReleased under the MIT License. y", "k", 0), (1, "x\nReleased under the MIT License. y", "k", 0), (2, None, None, None), (3, "", "", 1), (None, "Licensed under CC BY-NC 4.0.", "", 2), (4, "word " * 50000 + "Licensed under the Apache Licence, Version 2.0 end", "", 3), (5, "a license to use", "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, start int")
    text = {r[0]: r[1] for r in rows}
    got = sorted((r.doc_id or 0, r.license, r.kind, text[r.doc_id][r.start : r.end]) for r in licenses(docs).collect())
    mit = (1, "MIT", "notice", "Released under the MIT License")
    assert got == [(0, "CC", "notice", "Licensed under CC BY-NC 4.0"), mit, mit, (4, "Apache", "notice", "Licensed under the Apache Licence, Version 2.0")]
    assert licenses(docs.limit(0)).count() == 0
