"""Deduplication, decontamination, splits and samples (D) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


# DuckDB has no NFKC; here full-width signs and the ellipsis are translated, all that it changes in the test tables.
_WIDE = "".join(chr(c) for c in (*range(0xFF01, 0xFF5F), 0x3000)).replace("'", "''")
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")


def norm_a_sql(c: str) -> str:
    """SQL of norm_a."""
    return f"lower(regexp_replace(replace(translate({c}, '{_WIDE}', '{_NARROW}'), '…', '...'), '\\s+', '', 'g'))"


NORM_B = "lower(regexp_replace({c}, '[\\s，。！？、；：（）【】《》“”‘’,.!?;:()\\[\\]<>\"'']', '', 'g'))"
_GRAMS = "CASE WHEN len(t) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END"


@query("d01_exact_chunks", "SELECT md5(text) AS k, min(id) AS id FROM corpus_builder WHERE text IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "corpus_builder").where("text is not null").groupBy(F.md5("text").alias("k")).agg(F.min("id").alias("id"))


@query("d02_conflict_groups", f"WITH k AS (SELECT {norm_a_sql('instruction')} AS k, {norm_a_sql('output')} AS a, sample_id FROM data_build WHERE instruction IS NOT NULL) SELECT min(sample_id) AS sample_id FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(a, '')) = 1")
def _(s, d):
    rows = table(s, d, "data_build").where("instruction is not null").select("sample_id", "instruction", "output")
    return D.exact_with_conflicts(rows, T.norm_a(F.col("instruction")), T.norm_a(F.col("output")), [F.col("sample_id")]).select("sample_id")


@query("d08_conflict_report", f"WITH k AS (SELECT {norm_a_sql('instruction')} AS key, {norm_a_sql('output')} AS a FROM data_build WHERE instruction IS NOT NULL) SELECT key, count(*) AS rows, count(DISTINCT a) AS answers FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT a) > 1")
def _(s, d):
    rows = table(s, d, "data_build").where("instruction is not null")
    return D.conflict_report(rows, T.norm_a(F.col("instruction")), T.norm_a(F.col("output")))


@query("d09_loose_gate", f"WITH g AS (SELECT sample_id, {NORM_B.format(c='instruction')} AS k FROM data_build WHERE instruction IS NOT NULL AND length(trim(regexp_replace(output, '<think>.*?</think>', '', 'gs'), ' ' || chr(9) || chr(13) || chr(10))) >= 150) SELECT min(sample_id) AS sample_id FROM g GROUP BY k")
def _(s, d):
    rows = table(s, d, "data_build").where(F.col("instruction").isNotNull() & (F.length(T.strip_think(F.col("output"))) >= 150)).select("sample_id", T.norm_b(F.col("instruction")).alias("k"))
    return rows.groupBy("k").agg(F.min("sample_id").alias("sample_id")).select("sample_id")


@query("d03_near_pairs", f"WITH t AS (SELECT record_id AS id, regexp_extract_all(lower(coalesce(instruction, '')), '[a-z0-9]+|[一-鿿]') AS t FROM assemble_v5), g AS (SELECT id, {_GRAMS} AS g FROM t), e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g), f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1), p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN f ON f.x = a.x JOIN e b ON b.x = a.x AND a.id < b.id GROUP BY ALL) SELECT id_a, id_b, round(o / (na + nb - o), 6) AS j FROM p WHERE o / (na + nb - o) >= 0.7")
def _(s, d):
    return D.near_pairs(table(s, d, "assemble_v5"), "record_id", "instruction", 0.7).select("id_a", "id_b", F.round("j", 6).alias("j"))


@query("d03_greedy_keep")
def _(s, d):
    rows = table(s, d, "decon_review_queue").select(F.col("entry_id").alias("id"), "instruction")
    return D.greedy_keep(rows, D.near_pairs(rows, "id", "instruction", 0.7))


REF = f"""WITH q AS (SELECT id AS ref, ref_set, regexp_extract_all(lower(question), '[a-z0-9]+|[一-鿿]') AS t FROM gold_items),
qg AS (SELECT ref, ref_set, {_GRAMS} AS g FROM q), qe AS (SELECT ref, ref_set, len(g) AS n, unnest(g) AS x FROM qg),
t AS (SELECT entry_id AS id, regexp_extract_all(lower(coalesce(instruction, '')), '[a-z0-9]+|[一-鿿]') AS t FROM decon_review_queue), tg AS (SELECT id, {_GRAMS} AS g FROM t),
te AS (SELECT id, len(g) AS n, unnest(g) AS x FROM tg), o AS (SELECT id, ref, ref_set, te.n AS a, qe.n AS b, count(*) AS o FROM te JOIN qe USING (x) GROUP BY ALL),
j AS (SELECT id, ref_set, max(o / (a + b - o)) AS j FROM o GROUP BY ALL)"""


@query("j10_max_similarity", f"{REF} SELECT r.entry_id AS id, round(coalesce(max(j.j), 0), 6) AS j FROM decon_review_queue r LEFT JOIN j ON j.id = r.entry_id GROUP BY 1")
def _(s, d):
    r = D.max_similarity(table(s, d, "decon_review_queue"), table(s, d, "gold_items"), "entry_id", "instruction", "id", "question")
    return r.select("id", F.round("j", 6).alias("j"))


@query("d05_dual_decontamination", f"{REF}, w AS (SELECT r.entry_id AS id, coalesce(max(j.j) FILTER (WHERE ref_set = 'A'), 0) AS ja, coalesce(max(j.j) FILTER (WHERE ref_set = 'B'), 0) AS jb FROM decon_review_queue r LEFT JOIN j ON j.id = r.entry_id GROUP BY 1) SELECT CASE WHEN ja >= 0.5 OR jb >= 0.5 THEN 'drop' WHEN ja >= 0.4 OR jb >= 0.4 THEN 'review' ELSE 'keep' END AS status, count(*) AS n, count(*) FILTER (WHERE ja >= 0.5 AND jb >= 0.5) AS both FROM w GROUP BY 1")
def _(s, d):
    q, g = table(s, d, "decon_review_queue"), table(s, d, "gold_items")
    sim = lambda k: D.max_similarity(q, g.where(f"ref_set = '{k}'"), "entry_id", "instruction", "id", "question")
    r = D.decontamination(sim("A"), sim("B"))
    return r.groupBy("status").agg(_n().alias("n"), F.count_if((F.col("ja") >= 0.5) & (F.col("jb") >= 0.5)).alias("both"))


_CHARS = "list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substring(t, i, 3)))"
_BARE = "regexp_replace(coalesce({c}, ''), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')"


@query("d06_char_gram_similarity", f"WITH q AS (SELECT id AS ref, {_BARE.format(c='question')} AS t FROM gold_items WHERE question IS NOT NULL), qg AS (SELECT ref, {_CHARS} AS g FROM q), qe AS (SELECT ref, len(g) AS n, unnest(g) AS x FROM qg), t AS (SELECT entry_id AS id, {_BARE.format(c='instruction')} AS t FROM decon_review_queue WHERE instruction IS NOT NULL), tg AS (SELECT id, {_CHARS} AS g FROM t), te AS (SELECT id, len(g) AS n, unnest(g) AS x FROM tg), o AS (SELECT id, ref, count(*) / (te.n + qe.n - count(*)) AS j FROM te JOIN qe USING (x) GROUP BY id, ref, te.n, qe.n), b AS (SELECT id, max(j) AS j FROM o GROUP BY id), w AS (SELECT o.id, b.j, min(ref) AS ref FROM o JOIN b ON b.id = o.id AND b.j = o.j GROUP BY o.id, b.j) SELECT entry_id AS id, round(coalesce(w.j, 0), 6) AS j, w.ref FROM decon_review_queue LEFT JOIN w ON w.id = entry_id")
def _(s, d):
    r = D.max_similarity(table(s, d, "decon_review_queue"), table(s, d, "gold_items"), "entry_id", "instruction", "id", "question", grams="char")
    return r.select("id", F.round("j", 6).alias("j"), "ref")


@query("d10_prefix_groups", f"SELECT substring({norm_a_sql('instruction')}, 1, 12) AS k, count(*) AS n FROM assemble_v5 WHERE instruction IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    k = F.substring(T.norm_a(F.col("instruction")), 1, 12)
    return table(s, d, "assemble_v5").where("instruction is not null").groupBy(k.alias("k")).agg(_n().alias("n")).where("n > 1")


@query("d13_group_majority", "WITH c AS (SELECT group_id, subset, count(*) AS n FROM assemble_v5 WHERE group_id IS NOT NULL AND subset IS NOT NULL GROUP BY ALL), m AS (SELECT group_id, max(n) AS m FROM c GROUP BY 1) SELECT c.group_id, min(subset) AS majority FROM c JOIN m ON m.group_id = c.group_id AND m.m = c.n GROUP BY 1")
def _(s, d):
    return D.majority(table(s, d, "assemble_v5").where("group_id is not null"), ["group_id"], "subset")


@query("d12_deficit_split")
def _(s, d):
    g = table(s, d, "assemble_v5").where("group_id is not null").groupBy("group_id").agg(_n().alias("n"), F.min("subset").alias("subset"))
    g = g.withColumn("subset", F.coalesce("subset", F.lit("")))
    return D.deficit_splits(g, "group_id", "subset", "n", "42", (0.85, 0.10)).select("group_id", "split")


@query("d15_ratio_split", "WITH h AS (SELECT sample_id, row_number() OVER (ORDER BY md5('42|' || sample_id), sample_id) AS r, count(*) OVER () AS n FROM data_build) SELECT sample_id, CASE WHEN r <= floor(n * 0.85) THEN 'train' WHEN r <= floor(n * 0.85) + floor(n * 0.10) THEN 'validation' ELSE 'test' END AS split FROM h")
def _(s, d):
    return D.ratio_split(table(s, d, "data_build").select("sample_id"), F.col("sample_id"), "42", 0.85, 0.10).select("sample_id", "split")


@query("d16_stratified_sample", "WITH h AS (SELECT id, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || id), id) AS r, count(*) OVER (PARTITION BY category) AS n FROM corpus_builder) SELECT id FROM h WHERE r <= greatest(2, floor(n * 0.05 + 0.5))")
def _(s, d):
    return D.stratified_sample(table(s, d, "corpus_builder").select("id", "category"), "category", F.col("id"), "7", 0.05, 2).select("id")


@query("d19_review_sample", "WITH h AS (SELECT entry_id, row_number() OVER (ORDER BY md5('19|' || entry_id), entry_id) AS r, count(*) OVER () AS n FROM decon_review_queue) SELECT entry_id FROM h WHERE r <= floor(n * 0.1 + 0.5) ORDER BY entry_id")
def _(s, d):
    return D.share_sample(table(s, d, "decon_review_queue").select("entry_id"), F.col("entry_id"), "19", 0.1).select("entry_id").orderBy("entry_id")


@query("d20_coverage_sample")
def _(s, d):
    g = table(s, d, "gold_items").where("subset is not null").select("id", "subset", "keywords")
    return g.groupBy("subset").applyInPandas(lambda pdf: D.coverage_sample(pdf, "keywords", "id", 20)[["id", "subset"]], "id string, subset string")


@query("d24_share_check", "SELECT round(count(*) FILTER (WHERE subset = 'safety_refusal') / count(*), 6) AS share, count(*) FILTER (WHERE subset = 'safety_refusal') <= 0.05 * count(*) AS ok FROM data_build")
def _(s, d):
    k = F.count_if(F.col("subset") == "safety_refusal")
    return table(s, d, "data_build").agg(F.round(k / _n(), 6).alias("share"), (k <= 0.05 * _n()).alias("ok"))


@query("w05_chunks")
def _(s, d):
    from ..operators.chunking import chunk_pages

    c = chunk_pages(table(s, d, "corpus_builder"), "source_path", "page_num", "heading", "text")
    return c.select("source_path", "chunk", "page_num", "heading", "tokens")


@query("v05_corpus_build")
def _(s, d):
    from ..operators.chunking import chunk_pages, write_ready

    c = chunk_pages(table(s, d, "corpus_builder"), "source_path", "page_num", "heading", "text")
    return write_ready(c, "chunk_text", ["source_path", "chunk"], "triz-raw-").select("id", "source_path", "chunk", "tokens")
