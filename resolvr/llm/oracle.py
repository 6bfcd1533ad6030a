"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _vectors(factor: int, extra: str = "") -> str:
    return f"""v AS (
  SELECT row_number() OVER () AS r, vec_id, {extra}
         [floor({factor} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""


OP3 = f"""
WITH {_vectors(64)},
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 20
"""

# Windows of n consecutive words stand for items of n words, or of 13 and more.
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p
             FROM (SELECT item, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
             FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n)),
m AS (SELECT r, dw.n, p, item FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM m) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
"""

OP12 = f"""
WITH {_vectors(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")},
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, c.label = a.label AS same,
             CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.r <> a.r AND len(c.v) = len(a.v)
      WHERE a.label IS NOT NULL AND c.label IS NOT NULL),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.vec_id, s.cr) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.vec_id, s.cr) <= 5
"""

OP13 = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
      FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS p
            FROM w JOIN (VALUES (1), (2), (3), (4)) t(k) ON len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first_part, array_to_string(w[j + 1:k], ' ') AS rest
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r,
                  CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.first_part
                     JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c WHERE k > 2))
           GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
         WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op3_exact_top_k": OP3, "op8_benchmark_decontamination": OP8, "op9_warc_revisits": OP9,
          "op12_hard_negatives": OP12, "op13_phrase_collocations": OP13}
