"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: What is no main text is taken away, whatever element holds the rest; the test pages have these parts and entities.
_AWAY = '(?s)<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>|<!--.*?-->'
_BARE = "replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;?', '&', 'g'), '&quot;', '\"')"
OP1 = f"""WITH a AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '{_AWAY}', '<p>', 'g') AS h FROM pages),
l AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:p|h1|div|article|body|html)[^>]*>'), lambda x: trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))) AS l FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text FROM l)
SELECT page_id, url, text, length(text)::bigint AS n_chars FROM t"""

OP5 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(w) - 11)) AS t(i)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (k), unnest(range(0, 13)) AS u(j) WHERE first < doc_id),
n AS (SELECT doc_id, count(*)::bigint AS n FROM hit GROUP BY doc_id),
x AS (SELECT doc_id, i AS p, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP6 = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.embedding::double[], v.embedding::double[]) AS score
FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::bigint AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS k FROM s),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.c)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept FROM n JOIN reach ON a = doc_id GROUP BY doc_id, n"""

#: Each order's steps by what every mask of failures means for them.
OP13 = f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_WORDS.format("t")} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
m AS (SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN first < doc_id THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT part, o, k, fails, n, good, toxic, contains(fails, o[k]) AS hit, regexp_matches(fails, '[' || o[1:k - 1] || '-]') AS gone FROM c, o, range(1, 6) AS r(k)),
a AS (SELECT part, o AS filter_order, k::int AS step, o[k] AS f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::bigint AS kept,
  sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::bigint AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::bigint AS redundant,
  sum(CASE WHEN fails = o[k] THEN n ELSE 0 END)::bigint AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::bigint AS good_lost,
  sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley FROM a"""

SQL = {"op1_line_blocks": OP1, "op5_count_min": OP5, "op6_vp_tree": OP6, "op10_superminhash": OP10, "op13_shapley": OP13}
