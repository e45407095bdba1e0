"""Joins, aggregations, window-like operations, ranking and set operations (J, A, W, O, U) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import scoring as E
from ..sources import io
from ..operators.ranking import first_rows, numbered
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


@query("j01_paired_scores", "SELECT entry_id, a.j AS ja, b.j AS jb, round(b.j - a.j, 6) AS diff FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL")
def _(s, d):
    q = table(s, d, "decon_review_queue")
    a, b = q.where("a.j is not null").select("entry_id", F.col("a.j").alias("ja")), q.where("b.j is not null").select("entry_id", F.col("b.j").alias("jb"))
    return a.join(b, "entry_id").select("entry_id", "ja", "jb", F.round(F.col("jb") - F.col("ja"), 6).alias("diff"))


@query("j03_in_all_arms", "SELECT subset FROM assemble_v5 WHERE subset IS NOT NULL INTERSECT SELECT subset FROM data_build INTERSECT SELECT subset FROM gold_items")
def _(s, d):
    arms = [table(s, d, t).where("subset is not null").select("subset").distinct().withColumn("arm", F.lit(t)) for t in ("assemble_v5", "data_build", "gold_items")]
    u = arms[0].unionByName(arms[1]).unionByName(arms[2])
    return u.groupBy("subset").agg(F.count_distinct("arm").alias("n")).where("n = 3").select("subset")


@query("j04_source_pages", "SELECT g.id, coalesce(c.category, '') AS page_category, coalesce(length(c.text), 0) AS chars FROM gold_items g LEFT JOIN corpus_builder c ON c.id = g.source_chunk_id")
def _(s, d):
    pages = table(s, d, "corpus_builder").select(F.col("id").alias("source_chunk_id"), F.col("category").alias("pc"), F.length("text").alias("n"))
    return table(s, d, "gold_items").select("id", "source_chunk_id").join(pages, "source_chunk_id", "left").select("id", F.coalesce("pc", F.lit("")).alias("page_category"), F.coalesce("n", F.lit(0)).alias("chars"))


@query("j05_before_after", "WITH b AS (SELECT subset, count(*) AS n FROM data_build WHERE subset IS NOT NULL GROUP BY 1), a AS (SELECT subset, count(*) AS n FROM assemble_v5 WHERE subset IS NOT NULL GROUP BY 1) SELECT coalesce(a.subset, b.subset) AS subset, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, CASE WHEN coalesce(b.n, 0) = 0 THEN 0 ELSE round((coalesce(a.n, 0) - coalesce(b.n, 0)) / b.n * 100, 4) END AS delta_pct FROM b FULL JOIN a ON a.subset = b.subset")
def _(s, d):
    count = lambda t, c: table(s, d, t).where("subset is not null").groupBy("subset").agg(_n().alias(c))
    j = count("data_build", "b").join(count("assemble_v5", "a"), "subset", "full_outer").select("subset", F.coalesce("b", F.lit(0)).alias("n_before"), F.coalesce("a", F.lit(0)).alias("n_after"))
    delta = F.col("n_after") - F.col("n_before")
    return j.select("*", delta.alias("delta"), F.when(F.col("n_before") == 0, F.lit(0.0)).otherwise(F.round(delta / F.col("n_before") * 100, 4)).alias("delta_pct"))


@query("j06_semi_pages_used", "SELECT file_type, count(*) AS n FROM corpus_builder WHERE id IN (SELECT source_chunk_id FROM gold_items WHERE source_chunk_id IS NOT NULL) GROUP BY file_type")
def _(s, d):
    used = table(s, d, "gold_items").select(F.col("source_chunk_id").alias("id"))
    return table(s, d, "corpus_builder").join(used, "id", "left_semi").groupBy("file_type").agg(_n().alias("n"))


@query("j08_anti_pages_unused", "SELECT file_type, count(*) AS n FROM corpus_builder c WHERE NOT EXISTS (SELECT 1 FROM gold_items g WHERE g.source_chunk_id = c.id) GROUP BY file_type")
def _(s, d):
    used = table(s, d, "gold_items").select(F.col("source_chunk_id").alias("id"))
    return table(s, d, "corpus_builder").join(used, "id", "left_anti").groupBy("file_type").agg(_n().alias("n"))


_B = "regexp_replace(lower({c}), '\\s', '', 'g')"


@query("j07_boost_minus_keys", f"SELECT sample_id FROM data_build WHERE origin = 'ariz_boost' AND instruction IS NOT NULL AND {_B.format(c='instruction')} NOT IN (SELECT {_B.format(c='instruction')} FROM assemble_v5 WHERE instruction IS NOT NULL) AND {_B.format(c='instruction')} NOT IN (SELECT {_B.format(c='question')} FROM gold_items)")
def _(s, d):
    key = lambda c: F.regexp_replace(F.lower(F.col(c)), r"\s", "").alias("k")
    boost = table(s, d, "data_build").where("origin = 'ariz_boost' and instruction is not null").select("sample_id", key("instruction"))
    pool, gold = table(s, d, "assemble_v5").where("instruction is not null").select(key("instruction")), table(s, d, "gold_items").select(key("question"))
    return boost.join(pool, "k", "left_anti").join(gold, "k", "left_anti").select("sample_id")


@query("j09_key_difference", "SELECT DISTINCT lower(regexp_replace(instruction, '\\s+', '', 'g')) AS k FROM decon_review_queue WHERE instruction IS NOT NULL EXCEPT SELECT lower(regexp_replace(instruction, '\\s+', '', 'g')) FROM assemble_v5")
def _(s, d):
    from ..functions.text import norm_c

    key = lambda t: table(s, d, t).where("instruction is not null").select(norm_c(F.col("instruction")).alias("k"))
    return key("decon_review_queue").subtract(key("assemble_v5"))


@query("j13_same_length_bucket", "WITH x AS (SELECT entry_id, CASE WHEN length(a.ref) < 60 THEN 0 WHEN length(a.ref) < 90 THEN 1 ELSE 2 END AS ba, CASE WHEN length(b.ref) < 60 THEN 0 WHEN length(b.ref) < 90 THEN 1 ELSE 2 END AS bb FROM decon_review_queue WHERE a.ref IS NOT NULL AND b.ref IS NOT NULL) SELECT ba AS bucket, count(*) AS n FROM x WHERE ba = bb GROUP BY 1")
def _(s, d):
    q = table(s, d, "decon_review_queue")
    bucket = lambda c: F.when(F.length(c) < 60, 0).when(F.length(c) < 90, 1).otherwise(2).alias("bucket")
    a, b = (q.where(f"{k}.ref is not null").select("entry_id", bucket(f"{k}.ref")) for k in "ab")
    return a.join(b, ["entry_id", "bucket"]).groupBy("bucket").agg(_n().alias("n"))


@query("j14_other_family", "SELECT x.origin AS contestant, y.origin AS judge, x.n * y.n AS pairs FROM (SELECT origin, count(*) AS n FROM decon_review_queue GROUP BY 1) x JOIN (SELECT origin, count(*) AS n FROM decon_review_queue GROUP BY 1) y ON left(x.origin, 4) <> left(y.origin, 4)")
def _(s, d):
    c = table(s, d, "decon_review_queue").groupBy("origin").agg(_n().alias("n"))
    x, y = c.select(F.col("origin").alias("contestant"), F.col("n").alias("nx")), c.select(F.col("origin").alias("judge"), F.col("n").alias("ny"))
    return x.join(y, F.left("contestant", F.lit(4)) != F.left("judge", F.lit(4))).select("contestant", "judge", (F.col("nx") * F.col("ny")).alias("pairs"))


@query("j15_last_record_wins", "SELECT doc_id, arg_max(area, (labelled_at, annotator)) AS area FROM subject_labels WHERE area IS NOT NULL GROUP BY doc_id")
def _(s, d):
    rows = table(s, d, "subject_labels").where("area is not null")
    return io.latest(rows, ["doc_id"], F.struct("labelled_at", "annotator"), "area")


@query("j16_orphans", "SELECT count(*) AS n FROM gold_items WHERE source_chunk_id IS NOT NULL AND source_chunk_id NOT IN (SELECT id FROM corpus_builder)")
def _(s, d):
    g = table(s, d, "gold_items").where("source_chunk_id is not null").select(F.col("source_chunk_id").alias("id"))
    return g.join(table(s, d, "corpus_builder").select("id"), "id", "left_anti").agg(_n().alias("n"))


@query("j17_keyword_aliases", "WITH k AS (SELECT id, unnest(keywords) AS keyword FROM gold_items) SELECT a.area, count(*) AS n FROM k JOIN subject_areas a ON contains(a.description_zh, substring(k.keyword, 1, 2)) GROUP BY 1")
def _(s, d):
    k = table(s, d, "gold_items").select(F.explode("keywords").alias("keyword"))
    a = table(s, d, "subject_areas").select("area", "description_zh")
    return k.join(F.broadcast(a), F.contains("description_zh", F.substring("keyword", 1, 2))).groupBy("area").agg(_n().alias("n"))


@query("a01_count_by_key", "SELECT subset, style, origin, count(*) AS n FROM assemble_v5 GROUP BY ALL")
def _(s, d):
    return table(s, d, "assemble_v5").groupBy("subset", "style", "origin").agg(_n().alias("n"))


@query("a02_token_stats", "WITH t AS (SELECT category, len(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')) AS n FROM corpus_builder WHERE text IS NOT NULL) SELECT category, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS mean, min(n) AS least, max(n) AS most FROM t GROUP BY 1")
def _(s, d):
    from ..functions.text import estimated_tokens

    t = table(s, d, "corpus_builder").where("text is not null").select("category", estimated_tokens(F.col("text")).cast("long").alias("n"))
    return t.groupBy("category").agg(_n().alias("chunks"), F.sum("n").alias("total"), F.round(F.avg("n"), 2).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("a03_length_distribution", "SELECT style, count(*) AS n, round(avg(length(output)), 1) AS mean, quantile_cont(length(output), 0.5) AS p50, round(quantile_cont(length(output), 0.95), 4) AS p95, round(quantile_cont(length(output), 0.99), 4) AS p99, max(length(output)) AS most FROM assemble_v5 WHERE output IS NOT NULL GROUP BY style")
def _(s, d):
    x = table(s, d, "assemble_v5").where("output is not null").select("style", F.length("output").alias("n"))
    q = S.quantile_linear(F.col("n"), 0.5, 0.95, 0.99)
    return x.groupBy("style").agg(_n().alias("n"), F.round(F.avg("n"), 1).alias("mean"), q.alias("q"), F.max("n").alias("most")).select("style", "n", "mean", F.col("q")[0].alias("p50"), F.round(F.col("q")[1], 4).alias("p95"), F.round(F.col("q")[2], 4).alias("p99"), "most")


@query("a04_field_lengths", " UNION ALL ".join(f"SELECT '{c}' AS field, min(length({c})) AS least, quantile_cont(length({c}), 0.5) AS p50, round(quantile_cont(length({c}), 0.95), 4) AS p95, max(length({c})) AS most FROM data_build" for c in ("instruction", "input", "output")))
def _(s, d):
    x = table(s, d, "data_build").select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.length(c).alias("n")) for c in ("instruction", "input", "output")))).alias("r")).select("r.*")
    q = S.quantile_linear(F.col("n"), 0.5, 0.95)
    return x.groupBy("field").agg(F.min("n").alias("least"), q.alias("q"), F.max("n").alias("most")).select("field", "least", F.col("q")[0].alias("p50"), F.round(F.col("q")[1], 4).alias("p95"), "most")


@query("a05_index_quantile", "WITH r AS (SELECT origin, length(output) AS v, row_number() OVER (PARTITION BY origin ORDER BY length(output)) - 1 AS k, count(*) OVER (PARTITION BY origin) AS n FROM data_build WHERE output IS NOT NULL) SELECT origin, v AS p95 FROM r WHERE k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))")
def _(s, d):
    x = table(s, d, "data_build").select("origin", F.length("output").alias("v"))
    return S.quantile_index(x, "v", ["origin"], 0.95, "p95")


@query("a06_duplicate_rate", "SELECT origin, count(*) AS n, round((count(*) - count(DISTINCT lower(regexp_replace(instruction, '\\s+', '', 'g')))) / count(*) * 100, 4) AS rate FROM assemble_v5 WHERE instruction IS NOT NULL GROUP BY origin")
def _(s, d):
    from ..functions.text import norm_c

    x = table(s, d, "assemble_v5").where("instruction is not null").select("origin", norm_c(F.col("instruction")).alias("k"))
    return x.groupBy("origin").agg(_n().alias("n"), F.round((_n() - F.count_distinct("k")) / _n() * 100, 4).alias("rate"))


@query("a07_fixed_categories", "WITH c AS (SELECT CASE WHEN subset IN ('concept_explanation', 'contradiction_analysis', 'case_generation') THEN subset ELSE 'other' END AS subset FROM assemble_v5), k AS (SELECT unnest(['concept_explanation', 'contradiction_analysis', 'case_generation', 'other', 'absent']) AS subset) SELECT k.subset, count(c.subset) AS n FROM k LEFT JOIN c ON c.subset = k.subset GROUP BY 1")
def _(s, d):
    names = ["concept_explanation", "contradiction_analysis", "case_generation"]
    c = table(s, d, "assemble_v5").groupBy(F.when(F.col("subset").isin(*names), F.col("subset")).otherwise("other").alias("subset")).agg(_n().alias("n"))
    k = s.createDataFrame([(x,) for x in [*names, "other", "absent"]], "subset string")
    return k.join(c, "subset", "left").select("subset", F.coalesce("n", F.lit(0)).alias("n"))


@query("a08_conditional_counts", "SELECT count(*) FILTER (WHERE length(output) > 600) AS over, count(*) FILTER (WHERE length(output) BETWEEN 500 AND 600) AS near, count(*) FILTER (WHERE regexp_matches(output, '<think>\\s*</think>')) AS empty_think FROM data_build")
def _(s, d):
    n = F.length("output")
    return table(s, d, "data_build").agg(F.count_if(n > 600).alias("over"), F.count_if(n.between(500, 600)).alias("near"), F.count_if(F.col("output").rlike(r"<think>\s*</think>")).alias("empty_think"))


@query("a09_distinct_2", "WITH t AS (SELECT subset, regexp_replace(coalesce(question, ''), '\\s+', '', 'g') AS t FROM gold_items), g AS (SELECT subset, unnest(list_transform(range(1, greatest(length(t), 1)), lambda i: substring(t, i, 2))) AS g FROM t) SELECT subset, count(DISTINCT g) AS types, count(*) AS total, round(count(DISTINCT g) / count(*), 6) AS ratio FROM g GROUP BY subset")
def _(s, d):
    return E.distinct_n(table(s, d, "gold_items"), "question", 2, ["subset"]).select("subset", "types", "total", F.round("ratio", 6).alias("ratio"))


_WILSON = "{p} AS p, round(greatest(0, ({p} + 3.8414588206941227 / (2 * {n}) - 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 3.8414588206941227 / (4 * {n} * {n}))) / (1 + 3.8414588206941227 / {n})), 6) AS low, round(least(1, ({p} + 3.8414588206941227 / (2 * {n}) + 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 3.8414588206941227 / (4 * {n} * {n}))) / (1 + 3.8414588206941227 / {n})), 6) AS high"


@query("a11_pass_rates", "WITH g AS (SELECT subset, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE length(output) >= 150) AS DOUBLE) AS k FROM data_build GROUP BY subset), w AS (SELECT subset, n, k, k / n AS p0 FROM g) SELECT subset, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS passes, " + _WILSON.format(p="p0", n="n").replace("p0 AS p", "round(p0, 6) AS p") + ", CASE WHEN n < 30 THEN 'descriptive' ELSE '' END AS note FROM w")
def _(s, d):
    r = E.pass_rates(table(s, d, "data_build"), F.length("output") >= 150, ["subset"])
    return r.select("subset", "n", "passes", *(F.round(c, 6).alias(c) for c in ("p", "low", "high")), "note")


@query("a12_composite", "SELECT subset, round(avg(a.j) * 0.4 + avg(b.j) * 0.6, 6) AS composite FROM decon_review_queue GROUP BY subset")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("subset", F.col("a.j").alias("ja"), F.col("b.j").alias("jb"))
    return E.composite(q, {"ja": 0.4, "jb": 0.6}, ["subset"]).select("subset", F.round("composite", 6).alias("composite"))


@query("a13_top_keywords", "WITH k AS (SELECT unnest(keywords) AS keyword FROM gold_items) SELECT keyword, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, keyword LIMIT 30")
def _(s, d):
    return table(s, d, "gold_items").select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(_n().alias("n")).orderBy(F.desc("n"), "keyword").limit(30)


@query("a14_keyword_density", "SELECT ref_set, round(1000.0 * sum(len(list_filter(keywords, lambda k: contains(coalesce(reference_answer, ''), k)))) / sum(length(coalesce(reference_answer, ''))), 6) AS density FROM gold_items GROUP BY ref_set")
def _(s, d):
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.coalesce("reference_answer", F.lit("")), k)))
    return table(s, d, "gold_items").groupBy("ref_set").agg(F.round(1000.0 * F.sum(hits) / F.sum(F.length(F.coalesce("reference_answer", F.lit("")))), 6).alias("density"))


@query("a16_confusion", "SELECT count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE NOT x AND y) AS only_b, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM (SELECT a.j >= 0.45 AS x, b.j >= 0.45 AS y FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL)")
def _(s, d):
    q = table(s, d, "decon_review_queue").where("a.j is not null and b.j is not null")
    return E.confusion(q, F.col("a.j") >= 0.45, F.col("b.j") >= 0.45)


@query("a17_sign_quadrants", "SELECT sign(b.j - a.j) AS direction, count(*) AS n FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "decon_review_queue").where("a.j is not null and b.j is not null").groupBy(F.signum(F.col("b.j") - F.col("a.j")).cast("tinyint").alias("direction")).agg(_n().alias("n"))


@query("a18_majority_label", "WITH c AS (SELECT doc_id, area, count(*) AS n FROM subject_labels WHERE area IS NOT NULL GROUP BY ALL), m AS (SELECT doc_id, max(n) AS m FROM c GROUP BY 1) SELECT c.doc_id, CASE WHEN count(*) > 1 THEN 'tie' ELSE min(area) END AS majority FROM c JOIN m ON m.doc_id = c.doc_id AND c.n = m.m GROUP BY 1")
def _(s, d):
    from ..operators.dedup import majority

    return majority(table(s, d, "subject_labels"), ["doc_id"], "area", tie="tie")


@query("a19_flip_rates", "WITH c AS (SELECT doc_id, coalesce(area, '') AS area, count(*) AS n FROM subject_labels GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS runs, count(*) AS verdicts, round(1 - max(n) / sum(n), 6) AS flip FROM c GROUP BY doc_id")
def _(s, d):
    rows = table(s, d, "subject_labels").select("doc_id", F.coalesce("area", F.lit("")).alias("area"))
    return E.flip_rate(rows, ["doc_id"], "area").select("doc_id", "runs", "verdicts", F.round("flip", 6).alias("flip"))


@query("a20_first_votes", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY labelled_at, annotator) AS k FROM subject_labels WHERE area IS NOT NULL) SELECT k, count(*) AS n, count(DISTINCT area) AS areas FROM r WHERE k <= 3 GROUP BY k")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("labelled_at", "annotator")
    r = table(s, d, "subject_labels").where("area is not null").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3")
    return r.groupBy("k").agg(_n().alias("n"), F.count_distinct("area").alias("areas"))


@query("a25_progress_summary", "SELECT event_type, count(*) AS n, max(ts) AS latest, arg_max(user_id, (ts, user_id)) AS last_user FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(_n().alias("n"), F.max("ts").alias("latest"), F.max_by("user_id", F.struct("ts", "user_id")).alias("last_user"))


@query("a26_weighted_perplexity", "SELECT l_returnflag, round(exp(sum(CAST(l_tax AS DOUBLE) * CAST(l_quantity AS DOUBLE)) / sum(CAST(l_quantity AS DOUBLE))), 6) AS ppl FROM lineitem GROUP BY 1")
def _(s, d):
    x = table(s, d, "lineitem")
    return x.groupBy("l_returnflag").agg(F.round(E.perplexity(F.col("l_tax").cast("double"), F.col("l_quantity").cast("double")), 6).alias("ppl"))


@query("a27_histogram", "SELECT CAST(floor(a.j * 50) AS BIGINT) AS bin, count(*) AS n FROM decon_review_queue WHERE a.j IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "decon_review_queue").where("a.j is not null").groupBy(F.floor(F.col("a.j") * 50).alias("bin")).agg(_n().alias("n"))


@query("a28_unpivot_means", "SELECT 'a' AS step, subset, round(avg(a.j), 6) AS mean FROM decon_review_queue GROUP BY subset UNION ALL SELECT 'b', subset, round(avg(b.j), 6) FROM decon_review_queue GROUP BY subset")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("subset", F.col("a.j").alias("a"), F.col("b.j").alias("b"))
    return q.unpivot(["subset"], ["a", "b"], "step", "x").groupBy("step", "subset").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("a29_missing_numbers", "WITH f AS (SELECT DISTINCT CAST(unnest(regexp_extract_all(coalesce(output, ''), '第([0-9]{1,2})步', 1)) AS INTEGER) AS n FROM data_build) SELECT CAST(k AS INTEGER) AS n FROM range(1, 41) r(k) WHERE k NOT IN (SELECT n FROM f WHERE n IS NOT NULL)")
def _(s, d):
    found = table(s, d, "data_build").select(F.explode(F.regexp_extract_all(F.coalesce("output", F.lit("")), F.lit("第([0-9]{1,2})步"), F.lit(1))).alias("n")).select(F.col("n").cast("int").alias("n")).distinct()
    return s.range(1, 41).select(F.col("id").cast("int").alias("n")).join(found, "n", "left_anti")


@query("w01_first_per_key", "SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY md5(coalesce(instruction, '')) ORDER BY record_id) AS k FROM assemble_v5) WHERE k = 1")
def _(s, d):
    from ..operators.dedup import keep_first

    rows = table(s, d, "assemble_v5").select("record_id", F.md5(F.coalesce("instruction", F.lit(""))).alias("k"))
    return keep_first(rows, F.col("k"), [F.col("record_id")]).select("record_id")


@query("w02_longest_per_key", "SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY instruction ORDER BY coalesce(length(output), 0) DESC, sample_id) AS k FROM data_build WHERE instruction IS NOT NULL) WHERE k = 1")
def _(s, d):
    from ..operators.dedup import keep_longest

    rows = table(s, d, "data_build").where("instruction is not null").select("sample_id", "instruction", "output")
    return keep_longest(rows, F.col("instruction"), "output", [F.col("sample_id")]).select("sample_id")


@query("w03_average_ranks", "SELECT entry_id, rank() OVER (PARTITION BY subset ORDER BY a.j) + (count(*) OVER (PARTITION BY subset, a.j) - 1) / 2.0 AS r FROM decon_review_queue WHERE a.j IS NOT NULL")
def _(s, d):
    q = table(s, d, "decon_review_queue").where("a.j is not null").select("entry_id", "subset", F.col("a.j").alias("j"))
    return S.average_ranks(q, "j", ["subset"], "r").select("entry_id", "r")


@query("w04_equal_buckets", "WITH r AS (SELECT entry_id, row_number() OVER (PARTITION BY subset ORDER BY length(instruction), entry_id) AS r, count(*) OVER (PARTITION BY subset) AS m FROM decon_review_queue) SELECT entry_id, CAST(floor((r * 4 - 1) / m) AS INTEGER) AS bucket FROM r")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("entry_id", "subset", F.length("instruction").alias("n"))
    return E.ranks_of_length(q, "subset", [F.asc_nulls_last("n"), F.col("entry_id")], 4).select("entry_id", "bucket")


@query("w06_running_index", "SELECT id, row_number() OVER (PARTITION BY source_path ORDER BY page_num NULLS LAST, id) - 1 AS local FROM corpus_builder")
def _(s, d):
    w = Window.partitionBy("source_path").orderBy(F.asc_nulls_last("page_num"), "id")
    return table(s, d, "corpus_builder").select("id", (F.row_number().over(w) - 1).cast("long").alias("local"))


@query("w08_carried_forward", "SELECT id, last_value(heading IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM (SELECT id, source_path, CASE WHEN heading <> '' THEN heading END AS heading FROM corpus_builder)")
def _(s, d):
    rows = table(s, d, "corpus_builder").select("id", "source_path", F.when(F.col("heading") != "", F.col("heading")).alias("h"))
    return io.carried_forward(rows, "h", ["source_path"], "id", "heading").select("id", "heading")


@query("w10_stride", "SELECT record_id, CAST((row_number() OVER (PARTITION BY subset ORDER BY record_id) * 3 + 1) % 40 AS BIGINT) AS slot FROM assemble_v5 WHERE style = 'long'")
def _(s, d):
    rows = numbered(table(s, d, "assemble_v5").where("style = 'long'").select("record_id", "subset"), ["subset"], [F.col("record_id")])
    return rows.select("record_id", ((F.col("k") * 3 + 1) % 40).cast("long").alias("slot"))


@query("w11_apportionment", "WITH c AS (SELECT subset, count(*) AS n FROM assemble_v5 WHERE subset IS NOT NULL GROUP BY 1), s AS (SELECT subset, 1000 * n / sum(n) OVER () AS x FROM c), r AS (SELECT subset, CAST(floor(x) AS BIGINT) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, subset) AS k, 1000 - CAST(sum(floor(x)) OVER () AS BIGINT) AS rest FROM s) SELECT subset, f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS quota FROM r")
def _(s, d):
    c = table(s, d, "assemble_v5").where("subset is not null").groupBy("subset").agg(_n().alias("n"))
    all_ = Window.partitionBy()  # one row for each subset
    x = c.withColumn("x", F.col("n") * 1000 / F.sum("n").over(all_)).withColumn("f", F.floor("x"))
    r = x.withColumn("k", F.row_number().over(all_.orderBy(F.desc(F.round(F.col("x") - F.col("f"), 9)), "subset"))).withColumn("rest", 1000 - F.sum("f").over(all_))
    return r.select("subset", (F.col("f") + F.when(F.col("k") <= F.col("rest"), 1).otherwise(0)).alias("quota"))


@query("w12_latest_by_number", "SELECT source_path, arg_max(id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)) AS id FROM corpus_builder GROUP BY source_path")
def _(s, d):
    return table(s, d, "corpus_builder").groupBy("source_path").agg(F.max_by("id", F.regexp_extract("id", "([0-9]+)$", 1).cast("long")).alias("id"))


@query("o01_longest_first_cap", "SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY subset ORDER BY coalesce(length(output), 0) DESC, record_id) AS k FROM assemble_v5) WHERE k <= 100")
def _(s, d):
    rows = table(s, d, "assemble_v5").select("record_id", "subset", F.coalesce(F.length("output"), F.lit(0)).alias("n"))
    return first_rows(rows, [F.col("subset")], [F.desc("n"), F.col("record_id")], 100).select("record_id")


@query("o03_top_gaps", "SELECT entry_id, round(abs(a.j - b.j), 6) AS gap FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL ORDER BY round(abs(a.j - b.j), 6) DESC, entry_id DESC LIMIT 10")
def _(s, d):
    q = table(s, d, "decon_review_queue").where("a.j is not null and b.j is not null")
    return q.select("entry_id", F.round(F.abs(F.col("a.j") - F.col("b.j")), 6).alias("gap")).orderBy(F.desc("gap"), F.desc("entry_id")).limit(10)


@query("u01_union_of_sources", "SELECT source, count(*) AS n, count(style) AS styled FROM (SELECT 'pool' AS source, instruction, style FROM assemble_v5 UNION ALL SELECT 'raw', instruction, NULL FROM data_build UNION ALL SELECT 'review', instruction, style FROM decon_review_queue) GROUP BY source")
def _(s, d):
    part = lambda t, name, *c: table(s, d, t).select("instruction", *c).withColumn("source", F.lit(name))
    u = part("assemble_v5", "pool", "style").unionByName(part("data_build", "raw"), allowMissingColumns=True).unionByName(part("decon_review_queue", "review", "style"))
    return u.groupBy("source").agg(_n().alias("n"), F.count("style").alias("styled"))


@query("u02_intersection", "SELECT instruction FROM data_build WHERE instruction IS NOT NULL INTERSECT SELECT instruction FROM assemble_v5")
def _(s, d):
    return table(s, d, "data_build").where("instruction is not null").select("instruction").intersect(table(s, d, "assemble_v5").select("instruction"))


@query("u04_disjoint", "SELECT count(*) AS shared FROM (SELECT id FROM gold_items WHERE ref_set = 'A' INTERSECT SELECT id FROM gold_items WHERE ref_set = 'B')")
def _(s, d):
    g = table(s, d, "gold_items")
    return g.where("ref_set = 'A'").select("id").intersect(g.where("ref_set = 'B'").select("id")).agg(_n().alias("shared"))
