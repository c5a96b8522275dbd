"""DuckDB SQL for the queries that SQL can express, over the same tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_STEP = """s{k} AS (SELECT d.id, d.source, d.h, d.size, p.gap AS was, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS cum FROM {docs} d JOIN {gaps} p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size <= {most}),
f{k} AS (SELECT *, cum <= was AS fits FROM s{k}),
g{k} AS (SELECT p.source, p.gap - coalesce(sum(f.size) FILTER (f.fits), 0) AS gap, arg_min(f.size, f.h) FILTER (NOT f.fits) AS edge, min(f.h) FILTER (NOT f.fits) AS cut FROM {gaps} p LEFT JOIN f{k} f ON f.source IS NOT DISTINCT FROM p.source GROUP BY p.source, p.gap),
l{k} AS (SELECT id, source, h, size FROM f{k} WHERE NOT fits)"""

OP1 = rf"""WITH docs AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS w FROM docs GROUP BY source),
o AS (SELECT *, 200 * source_size AS cap, coalesce(sum(200 * source_size) OVER u, 0) AS paid, sum(w) OVER () - coalesce(sum(w) OVER u, 0) AS heavy, 150 * sum(source_size) OVER () AS total FROM src WINDOW u AS (ORDER BY 200.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT paid, heavy, total FROM o WHERE w * (total - paid) < cap * heavy ORDER BY paid LIMIT 1),
tgt AS (SELECT o.source, o.source_size, coalesce(least(o.cap::DOUBLE, o.w * (l.total - l.paid)::DOUBLE / l.heavy::DOUBLE), o.cap::DOUBLE) / 100 AS target FROM o LEFT JOIN lvl l ON true),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM tgt),
b AS (SELECT source, target - whole * source_size AS gap FROM plan WHERE source_size > 0),
d0 AS (SELECT * FROM docs WHERE size > 0),
{_STEP.format(k=0, docs="d0", gaps="b", most="d.size")},
{_STEP.format(k=1, docs="l0", gaps="g0", most="p.gap")},
{_STEP.format(k=2, docs="l1", gaps="g1", most="p.gap")},
e AS (SELECT g2.source, g2.gap, list_min([{{'e': abs(coalesce(g0.edge::DOUBLE, 'inf') - g2.gap), 'k': 0, 'cut': g0.cut}}, {{'e': abs(coalesce(g1.edge::DOUBLE, 'inf') - g2.gap), 'k': 1, 'cut': g1.cut}}, {{'e': abs(coalesce(g2.edge::DOUBLE, 'inf') - g2.gap), 'k': 2, 'cut': g2.cut}}]) AS x
  FROM g2 JOIN g1 ON g1.source IS NOT DISTINCT FROM g2.source JOIN g0 ON g0.source IS NOT DISTINCT FROM g2.source),
once AS (SELECT id, h FROM f0 WHERE fits UNION ALL SELECT id, h FROM f1 WHERE fits UNION ALL SELECT id, h FROM f2 WHERE fits UNION ALL SELECT d0.id, d0.h FROM d0 JOIN e ON d0.source IS NOT DISTINCT FROM e.source AND d0.h = e.x.cut AND e.x.e < e.gap),
n AS (SELECT d.id AS doc_id, d.size::BIGINT AS size, p.source_size, p.target, (p.whole + CASE WHEN o.h IS NOT NULL AND p.target > p.whole * p.source_size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN (SELECT DISTINCT h FROM once) o ON o.h = d.h)
SELECT *, copies * size AS taken FROM n"""

OP2 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents), i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
iw AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM iw), ks AS (SELECT DISTINCT k FROM wins),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
m AS (SELECT dw.doc_id, dw.p, dw.k, wins.item FROM dw JOIN wins ON wins.k = dw.k AND wins.win = array_to_string(dw.w[dw.p:dw.p + dw.k - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM m) GROUP BY 1), its AS (SELECT doc_id, list(DISTINCT item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(array_to_string(list_sort(coalesce(items, [])), ',')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP4 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
dup AS (SELECT doc_id, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT x) AS g FROM (SELECT doc_id, unnest(range(p, p + 35)) AS x FROM dup) GROUP BY 1),
words AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d JOIN gone USING (doc_id)),
left_ AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept FROM words LEFT JOIN (SELECT doc_id, unnest(g) AS p FROM gone) x ON x.doc_id = words.doc_id AND x.p = words.p WHERE x.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)"""

OP6 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[p:p + 4], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other), m AS (SELECT id, min(other) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id"""

OP9 = r"""WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 600 AS INT) AS fetched, nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '^www\.', ''), '') AS host,
list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS steps FROM pages),
h AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host IS NOT NULL),
k AS (SELECT DISTINCT page_id, fetched, unnest(list_concat(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: 'h:' || array_to_string(labels[i:], '.')), list_transform(range(1, least(len(steps), 2) + 1), lambda i: 'p:' || host || '/' || array_to_string(steps[1:i], '/')))) AS key FROM h),
n AS (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 4))::INT AS x, ('0x' || substr(md5(key), 5, 4))::INT AS y FROM k),
e AS (SELECT key, x % 300 AS d, y, ['ads', 'malware', 'spam'][1 + y % 3] AS category FROM n WHERE x % 3 = 0),
spans AS (SELECT key, category, DATE '2024-01-01' + d AS f, CASE WHEN y % 4 <> 0 THEN DATE '2024-01-01' + (d + 30 + y % 200) END AS u FROM e UNION ALL SELECT key, category, DATE '2024-01-01' + (d + 50 + y % 200), NULL FROM e WHERE y % 4 <> 0 AND y % 5 = 0),
hit AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS c, min(k.key) AS first_key FROM k JOIN spans s ON s.key = k.key AND k.fetched >= s.f AND (s.u IS NULL OR k.fetched < s.u) GROUP BY 1)
SELECT p.page_id, p.fetched::VARCHAR AS fetched, p.host, coalesce(n, 0)::BIGINT AS n_active, coalesce(c, '') AS categories, first_key, coalesce(n, 0) > 0 AS blocked FROM p LEFT JOIN hit USING (page_id)"""

ORACLES = {"op1_mix_sources": OP1, "op2_decontaminate": OP2, "op4_substring_dedup": OP4, "op6_minhash_near_dedup": OP6, "op9_url_filters": OP9}
