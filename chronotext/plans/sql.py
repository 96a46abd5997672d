"""SQL of queries that need a state from row to row: recursive common table expressions."""

from __future__ import annotations

LOW = "'-infinity'::DOUBLE"


def mincut(source: str, onset: float, offset: float, longest: float) -> str:
    """CTEs up to reg(k, region, a, b): activity with cuts, from source, a SELECT of k, t, y.

    The row's state is (begun, active, buffer of scores and times since the last
    closing sign); a row that closes or cuts a region carries its bounds along.
    """
    return f"""
ev AS (SELECT k, t, y, row_number() OVER (PARTITION BY k ORDER BY t) AS rn FROM ({source}) q),
st AS (SELECT k, rn, t, t AS begun, y > {onset} AS active, [{{'y': y, 't': t}}] AS buf, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM ev WHERE rn = 1
      UNION ALL
      SELECT k, rn, t, CASE WHEN NOT active THEN CASE WHEN y > {onset} THEN t ELSE begun END WHEN cut THEN buf[low].t WHEN y < {offset} THEN t ELSE begun END,
             CASE WHEN NOT active THEN y > {onset} WHEN cut THEN true ELSE y >= {offset} END,
             CASE WHEN NOT active THEN buf WHEN cut THEN list_append(buf[low + 1:], {{'y': y, 't': t}}) WHEN y < {offset} THEN [{{'y': y, 't': t}}] ELSE list_append(buf, {{'y': y, 't': t}}) END,
             CASE WHEN active AND (cut OR y < {offset}) THEN begun END, CASE WHEN active AND cut THEN buf[low].t WHEN active AND y < {offset} THEN t END
      FROM (SELECT *, half + list_position(late, list_min(late)) AS low FROM (
            SELECT ev.k, ev.rn, ev.t, ev.y, st.begun, st.active, st.buf, st.active AND ev.t - st.begun > {longest} AS cut, len(st.buf) // 2 AS half,
                   list_transform(st.buf[len(st.buf) // 2 + 1:], lambda x: x.y) AS late
            FROM st JOIN ev ON ev.k = st.k AND ev.rn = st.rn + 1) x) y),
fin AS (SELECT k, rn, a, b FROM st WHERE a IS NOT NULL
        UNION ALL SELECT k, rn + 1, begun, t FROM (SELECT *, max(rn) OVER (PARTITION BY k) AS last FROM st) q WHERE rn = last AND active),
reg AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY rn) - 1)::INTEGER AS region, a, b FROM fin)"""


def packed(first_end: str, size: float) -> str:
    """CTEs from reg(k, a, b) up to chunks(k, chunk_pos, a, b, n_segments)."""
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b) AS rn FROM reg),
f AS (SELECT k, 0::BIGINT AS rn, a AS cs, {first_end} AS ce, 0 AS held, false AS flush, 0.0::DOUBLE AS fs, 0.0::DOUBLE AS fe, 0 AS fh FROM r WHERE rn = 1
      UNION ALL
      SELECT k, rn, CASE WHEN fl THEN a ELSE cs END, b, CASE WHEN fl THEN 1 ELSE held + 1 END, fl, cs, ce, held
      FROM (SELECT f.k, r.rn, f.cs, f.ce, f.held, r.a, r.b, (r.b - f.cs > {size} AND f.ce - f.cs > 0) AS fl FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1) q),
o AS (SELECT k, rn, fs AS a, fe AS b, fh AS n FROM f WHERE flush
      UNION ALL SELECT k, rn + 1, cs, ce, held FROM (SELECT *, max(rn) OVER (PARTITION BY k) AS last FROM f) q WHERE rn = last),
chunks AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY rn) - 1)::INTEGER AS chunk_pos, a, b, n::INTEGER AS n_segments FROM o)"""


#: CTEs from vit(k, ext, em, sizes) up to placed(k, word, first, last, score): the best path and its words.  ext: the
#: states' labels; em: frames of scores; sizes: signs of each word.  Of equal ways staying goes before advancing before skipping.
VITERBI = f"""
fw AS (SELECT k, 1 AS t, list_transform(range(1, len(ext) + 1), lambda s: CASE WHEN s <= 2 THEN em[1][ext[s] + 1] ELSE {LOW} END) AS a, []::INTEGER[] AS mv FROM vit
      UNION ALL
      SELECT x.k, x.t, list_transform(range(1, len(ext) + 1), lambda s: greatest(stay[s], one[s], two[s]) + em[x.t][ext[s] + 1]),
             list_transform(range(1, len(ext) + 1), lambda s: CASE WHEN two[s] > greatest(stay[s], one[s]) THEN 2 WHEN one[s] > stay[s] THEN 1 ELSE 0 END)
      FROM (SELECT fw.k, fw.t + 1 AS t, ext, em, a AS stay, list_prepend({LOW}, a) AS one,
                   list_transform(range(1, len(ext) + 1), lambda s: CASE WHEN s > 2 AND ext[s] <> 0 AND ext[s] <> ext[s - 2] THEN a[s - 2] ELSE {LOW} END) AS two
            FROM fw JOIN vit ON vit.k = fw.k WHERE fw.t < len(em)) x),
bw AS (SELECT fw.k, t, CASE WHEN a[len(ext)] >= a[len(ext) - 1] THEN len(ext) ELSE len(ext) - 1 END AS s FROM fw JOIN vit ON vit.k = fw.k WHERE t = len(em)
      UNION ALL SELECT bw.k, bw.t - 1, bw.s - mv[bw.s] FROM bw JOIN fw ON fw.k = bw.k AND fw.t = bw.t WHERE bw.t > 1),
fr AS (SELECT bw.k, t, ext[s] AS lab, em[t][ext[s] + 1] AS p FROM bw JOIN vit ON vit.k = bw.k),
ch AS (SELECT *, CASE WHEN lab IS DISTINCT FROM lag(lab) OVER (PARTITION BY k ORDER BY t) THEN 1 ELSE 0 END AS fresh FROM fr),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY t) AS g FROM ch),
sp AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY g) AS i, min(t) - 1 AS first, max(t) AS last, sum(p) AS s, count(*) AS n FROM rn WHERE lab NOT IN (0, 27) GROUP BY k, g),
ws AS (SELECT k, unnest(sizes) AS size, unnest(range(len(sizes))) AS word FROM vit),
wt AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY word) AS upto FROM ws),
placed AS (SELECT wt.k, word, min(first) AS first, max(last) AS last, sum(s) / sum(n) AS score FROM wt JOIN sp ON sp.k = wt.k AND sp.i > upto - size AND sp.i <= upto GROUP BY wt.k, word)"""


def states(ids: str) -> str:
    """Blanks around and between the ids of a list."""
    return f"list_append(flatten(list_transform({ids}, lambda x: [0, x])), 0)"


def letters(word: str) -> str:
    """Ids of a lower-case word's signs: a to z are 1 to 26, all others 28."""
    return f"list_transform(string_split({word}, ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 AND ascii(c) < 128 THEN ascii(c) - 96 ELSE 28 END)"


def joined(words: str) -> str:
    """Ids of words (a list of lists of ids) with the boundary between."""
    return f"flatten(list_prepend({words}[1], list_transform({words}[2:], lambda w: list_prepend(27, w))))"


SPAN_REWRITE = r"""WITH p AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '\([^\n]*?\)|[^(]+|\(') AS l FROM documents) q),
o AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY n) - length(x) AS a FROM p),
c AS (SELECT doc_id, a + unnest(range(length(x))) AS pos, unnest(string_split(x, '')) AS ch FROM o WHERE NOT (length(x) > 1 AND x LIKE '(%)')),
k AS (SELECT *, CASE WHEN ch IN ('%', '&', '$') THEN 'x' WHEN regexp_matches(ch, '\s') THEN 's' WHEN regexp_matches(ch, '[\p{L}\p{N}_]') THEN 'w' END AS kind FROM c),
b AS (SELECT *, CASE WHEN kind <> 'w' OR lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = 'x' THEN 1 ELSE 0 END AS fresh FROM k WHERE kind IS NOT NULL),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM b),
t AS (SELECT doc_id, g, min(pos) AS a, max(pos) + 1 AS e, string_agg(CASE ch WHEN '%' THEN 'procent' WHEN '&' THEN 'och' WHEN '$' THEN 'dollar' ELSE lower(ch) END, '' ORDER BY pos) AS x
      FROM g WHERE kind <> 's' GROUP BY doc_id, g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS tok_pos, x AS normalized_token, substr(text, a::BIGINT + 1, (e - a)::BIGINT) AS text, a::INTEGER AS start_char, e::INTEGER AS end_char
FROM t JOIN documents USING (doc_id)"""
