"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import centroids
from .decontaminate import SHARE, WINDOW

_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

OP4 = f"""
WITH item AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM item WHERE len(w) > 0),
part AS (
  SELECT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS run
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM sized)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
  FROM doc CROSS JOIN (SELECT DISTINCT m FROM part) WHERE len(w) >= m
),
met AS (
  SELECT DISTINCT place.doc_id, place.s, place.m, part.item_id
  FROM place JOIN part ON part.m = place.m AND array_to_string(list_slice(place.w, s, s + place.m - 1), ' ') = part.run
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM met) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
  FROM (SELECT DISTINCT doc_id, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP7 = """
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, s, l[s] AS a, l[s + 1] AS b, l[s + 2] AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM doc WHERE len(l) >= 3)
),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, s) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 3)) AS p FROM ranked WHERE nth > 1),
line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS one FROM doc),
kept AS (
  SELECT doc_id, string_agg(one, chr(10) ORDER BY p) AS text
  FROM line ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN n_removed IS NULL THEN doc.text ELSE coalesce(kept.text, '') END AS text
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP9 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p
"""

#: CRC-32 of the decimal conv_id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x // 2, (x % 2) * 3988292384))))"""

OP11 = rf"""
WITH turn AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
conv AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS head, {_CRC32} % 4 AS h FROM turn),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.k, t.id, t.words FROM conv c JOIN turn t ON t.conv_id = c.head AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.id, t.words FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.k > c.h
),
path AS (
  SELECT conv_id, d, list_slice(ids, 1, d) AS node, n = d AS ends, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words
  FROM (
    SELECT conv_id, coalesce(ids, []) AS ids, ws, len(coalesce(ids, [])) AS n, unnest(range(0, len(coalesce(ids, [])) + 1)) AS d
    FROM conv LEFT JOIN (SELECT conv_id, list(id ORDER BY own, k) AS ids, list(words ORDER BY own, k) AS ws FROM rebuilt GROUP BY conv_id) USING (conv_id)
  )
),
node AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM path GROUP BY node, d
),
child AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT list_slice(node, 1, up) AS node, sum((n - 1) * words) AS saved, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT node, n, words, n_children, unnest(range(0, d + 1)) AS up FROM node LEFT JOIN child USING (node)) GROUP BY 1
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM node v JOIN below USING (node) LEFT JOIN child USING (node)
LEFT JOIN node up ON v.d > 0 AND up.d = v.d - 1 AND up.node = list_slice(v.node, 1, v.d - 1)
"""

OP12 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
win AS (
  SELECT r, doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS run
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM doc WHERE len(w) >= 13 AND doc_id IS NOT NULL)
),
least AS (SELECT run, min(doc_id) AS least FROM win GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM win JOIN least USING (run) WHERE least < doc_id),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS one FROM doc),
kept AS (SELECT r, count(*) AS n, string_agg(one, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""


def _lloyd(k: int, dimensions: int, rounds: int, largest: int) -> str:
    def assign(r: int) -> str:
        away = f"CAST(list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (w.v[i] - c.v[i]) * (w.v[i] - c.v[i]))) AS BIGINT)"
        return f"""a{r} AS MATERIALIZED (
  SELECT v, n, k, away FROM (SELECT w.v, w.n, c.k, {away} AS away FROM w CROSS JOIN c{r} c)
  QUALIFY row_number() OVER (PARTITION BY v ORDER BY away, k) = 1
)"""

    def move(r: int) -> str:
        return f"""s{r} AS (SELECT k, i, sum(CAST(v[i] AS HUGEINT) * n) AS s, sum(n) AS n FROM (SELECT *, unnest(range(1, {dimensions + 1})) AS i FROM a{r}) GROUP BY k, i),
m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (k))"""

    fine = f"lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {largest}"
    steps = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, {fine})) = {dimensions}
),
w AS MATERIALIZED (SELECT v, count(*) AS n FROM kept GROUP BY v),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY drawn, v) - 1 AS k, v
  FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS drawn, v FROM kept ORDER BY drawn, v LIMIT {k})
),
{steps},
{assign(rounds)},
own AS (SELECT k, sum(CAST(away AS HUGEINT) * n) AS s FROM a{rounds} GROUP BY k)
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, a.away AS distance, CAST(own.s AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(s) FROM own) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (v) JOIN own USING (k) JOIN c{rounds} c USING (k)
"""


OP13 = _lloyd(centroids.K, centroids.DIMENSIONS, centroids.ROUNDS, centroids.LARGEST)
