import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chronotext.llm.decontaminate import ERROR, Index, banded, bound, budget, drop_leaks, find, index_of, leaks

WORDS = "the and tion here ble wörd ñandú of on ing ther edst whin ouor lyed ereat".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        p = rng.randrange(len(t))
        what = rng.randrange(3)
        if what == 0:
            t[p] = "q"
        elif what == 1:
            t.insert(p, "q")
        else:
            del t[p]
    return "".join(t)


def normal_text(t):
    return " ".join(re.findall(r"\w+", t.lower()))


def best_edits(pattern, text):
    """Plain semi-global edit distance over bytes."""
    p, t = pattern.encode(), text.encode()
    row = np.zeros(len(t) + 1, dtype=int)
    tb = np.frombuffer(t, np.uint8)
    for i, c in enumerate(p, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (tb != c), row[1:] + 1)
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        row = new
    return int(row.min())


def test_every_occurrence_of_brute_force_is_found():
    rng = random.Random(3)
    items = [prose(rng, rng.randint(12, 50)) for _ in range(25)]
    index = Index(list(range(25)), items)
    docs = []
    for _ in range(60):
        d = prose(rng, rng.randint(5, 200)).split()
        if rng.random() < 0.7:
            at = rng.randrange(len(d))
            d[at:at] = [edited(rng, rng.choice(items), rng.randint(0, 14))]
        docs.append("!  ".join(d) if rng.random() < 0.3 else " ".join(d))
    found = {(d, i) for d, i, *_ in find(pa.array(docs), index)}
    brute = set()
    for d, t in enumerate(docs):
        for i, x in enumerate(items):
            x = normal_text(x)
            if best_edits(x, normal_text(t)) <= budget(len(x.encode())):
                brute.add((d, i))
    assert found == brute and len(brute) > 10


def test_offsets_hold_the_passage():
    item = "The quick brown fox jumps over the lazy dog and then some more words follow it"
    text = "Ünrelated — start. " + item.upper().replace(" ", "!!  ") + ". And the end."
    ((d, i, s, e, k),) = find(pa.array([text]), Index([9], [item]))
    assert (d, i, k) == (0, 0, 0) and normal_text(text[s:e]) == item.lower()


def test_band_is_the_whole_matrix_when_wide():
    rng = random.Random(5)
    for _ in range(30):
        p, t = prose(rng, 8), prose(rng, 20)
        pb, tb = p.encode(), t.encode()
        got = banded(pb, tb, -len(pb), len(tb))
        assert got[0] == best_edits(p, t)
        assert best_edits(p, tb[got[1] : got[2]].decode(errors="replace")) <= got[0] + 4


def test_lemma_numbers():
    assert budget(200) == int(200 * ERROR) and bound(200) == 200 - 9 - 16 * 10
    assert bound(45) > 0 and budget(45) < 45 * ERROR + 1


def test_nulls_empty_repeats_and_extra_columns(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    schema = "doc_id long, text string, item_id string, start int"
    rows = [(1, "x " + item + " y", "a", 0), (1, "x " + item + " y", "a", 0), (2, None, None, None), (3, "", "b", 1), (None, item, "c", 2), (4, "clean words " * 5000, "d", 3)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(7, item, 1), (8, None, 2), (None, item, 3), (9, "", 4)], "item_id long, text string, doc_id int")
    index = index_of(bench)
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in leaks(docs, index).collect())
    assert got == [(0, 7, 0), (1, 7, 0), (1, 7, 0)]
    kept = drop_leaks(docs, index)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    empty = docs.limit(0)
    assert leaks(empty, index).count() == 0 and drop_leaks(docs, index_of(bench.limit(0))).count() == 6


def test_short_items_are_found_word_for_word():
    items = ["What is the capital of France? Paris.", "Paris", "forty two", "no", "an ox", "?!"]
    index = Index(list(range(6)), items)
    assert len(index.ids) == 5
    texts = ["He asked: what is the CAPITAL of france -- Paris. No!", "comparison of parishes", "forty-two; an  ox", "an oxen know", "", None, "paris"]
    found = find(pa.array(texts), index)
    want = {(0, 0), (0, 1), (0, 3), (2, 2), (2, 4), (6, 1)}
    assert {(d, i) for d, i, *_ in found} == want
    for d, i, s, e, k in found:
        assert k == 0 and normal_text(texts[d][s:e]) == normal_text(items[i])
    assert not find(pa.array(["what is the capitol of france paris"]), index)[1:]  # one sign off: only the word itself


def test_items_with_a_common_prompt_cost_little():
    """Items that share a prompt, and a text that holds it again and again."""
    import time

    rng = random.Random(7)
    prompt = prose(rng, 30)[:110]
    items = [prompt + " " + prose(rng, 6) for _ in range(20)]
    text = " ".join(prompt + " " + prose(rng, 1) for _ in range(60)) + " " + items[3]
    index = Index(list(range(20)), items)
    find(pa.array([text[:200]]), index)
    began = time.process_time()
    found = find(pa.array([text]), index)
    assert time.process_time() - began < 2
    whole = normal_text(text)
    want = {i for i, x in enumerate(items) if best_edits(normal_text(x), whole) <= budget(len(normal_text(x).encode()))}
    assert {i for _, i, *_ in found} == want and 3 in want


def test_counting_in_parts_gives_the_same(monkeypatch):
    from chronotext.llm import decontaminate

    rng = random.Random(9)
    items = [prose(rng, rng.randint(3, 40)) for _ in range(30)]
    texts = [" ".join([prose(rng, 30), edited(rng, rng.choice(items), 4), prose(rng, 10)]) for _ in range(40)]
    index = Index(list(range(30)), items)
    want = find(pa.array(texts), index)
    monkeypatch.setattr(decontaminate, "EXPANDED", 50)
    monkeypatch.setattr(decontaminate, "SIDE_BY_SIDE", 3)
    assert find(pa.array(texts), index) == want and want


def test_large_benchmarks_are_an_error(spark):
    bench = spark.createDataFrame([(1, "word " * 100)], "item_id long, text string")
    with pytest.raises(ValueError):
        index_of(bench, max_bytes=100)
