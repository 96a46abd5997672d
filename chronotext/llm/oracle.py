"""SQL of those queries of the subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_SIGNS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: all pairs by brute force, then the least id that is reachable
EMBEDDING_NEAR_DEDUP = """WITH RECURSIVE e AS (SELECT DISTINCT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0),
p AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT x AS vec_id, least(x, min(y)) AS group_id FROM r GROUP BY x"""

#: occurrences without edits: each item's words with any signs between
DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, trim(regexp_replace(lower(text), '{_SIGNS}', ' ', 'g')) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT DISTINCT item_id, w, replace(w, ' ', '{_SIGNS}') AS pat FROM i WHERE length(w) >= 40),
h AS (SELECT doc_id, item_id, t, pat, w FROM (SELECT *, regexp_replace(t, '{_SIGNS}', ' ', 'g') AS s FROM d) x JOIN k ON contains(x.s, k.w)),
c AS (SELECT doc_id, item_id, pat, unnest(l) AS piece, unnest(range(len(l))) AS n FROM (SELECT *, regexp_extract_all(t, '(?s).*?(?:' || pat || ')') AS l FROM h) x),
o AS (SELECT doc_id, item_id, length(regexp_extract(piece, '(?s)(?:' || pat || ')\z')) AS m, sum(length(piece)) OVER (PARTITION BY doc_id, item_id ORDER BY n) AS e FROM c)
SELECT doc_id, item_id, (e - m)::INTEGER AS start, e::INTEGER AS "end", 0 AS edits FROM o"""



def _repeated(places: str) -> str:
    """Windows of 50 words with two places, united where they overlap or touch."""
    return rf"""WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 50], ' ')) AS h FROM u),
r AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT {places}) > 1),
f AS (SELECT DISTINCT doc_id, s FROM g WHERE h IN (SELECT h FROM r)),
b AS (SELECT *, CASE WHEN s > max(s + 50) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM f),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM b)
SELECT doc_id, min(s)::INTEGER AS start_word, (max(s) + 50)::INTEGER AS end_word, (max(s) + 50 - min(s))::INTEGER AS n_words FROM n GROUP BY doc_id, part"""

SQL: dict[str, str] = {
    "op3_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op9_suffix_array_dedup": _repeated("doc_id"),
    "op9_with_repeats_within": _repeated("(doc_id, s)"),
}
