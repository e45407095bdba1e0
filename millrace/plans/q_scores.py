"""Scores, statistics and decisions (E, X, G) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import scoring as E
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


_PAIRS = "SELECT entry_id, subset, a.j AS ja, b.j AS jb FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL"


def _pairs(s, d):
    return table(s, d, "decon_review_queue").where("a.j is not null and b.j is not null").select("entry_id", "subset", F.col("a.j").alias("ja"), F.col("b.j").alias("jb"))


@query("e01_keyword_hits", "SELECT id, len(list_filter(keywords, lambda k: contains(lower(coalesce(reference_answer, '')), lower(k)))) AS hits, CASE WHEN len(keywords) > 0 THEN round(len(list_filter(keywords, lambda k: contains(lower(coalesce(reference_answer, '')), lower(k)))) / len(keywords), 6) END AS rate FROM gold_items")
def _(s, d):
    k = E.keyword_hits(F.col("reference_answer"), F.col("keywords"))
    return table(s, d, "gold_items").select("id", k.alias("k")).select("id", F.size("k.hits").cast("long").alias("hits"), F.round("k.rate", 6).alias("rate"))


@query("e02_alias_hits", "WITH a AS (SELECT name_zh, area FROM subject_areas), k AS (SELECT id, reference_answer AS r, len(keywords) AS n, unnest(keywords) AS k FROM gold_items), h AS (SELECT id, n, k, contains(lower(coalesce(r, '')), lower(k)) OR EXISTS (SELECT 1 FROM a WHERE a.name_zh = k.k AND contains(lower(coalesce(r, '')), lower(a.area))) AS hit FROM k), s AS (SELECT id, count(*) FILTER (WHERE hit) / n AS rate FROM h GROUP BY id, n) SELECT g.id, round(s.rate, 6) AS rate FROM gold_items g LEFT JOIN s ON s.id = g.id")
def _(s, d):
    names = table(s, d, "subject_areas").select(F.map_from_entries(F.collect_list(F.struct("name_zh", F.array("area"))).over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy())).alias("aliases")).limit(1)
    k = E.alias_hits(F.col("reference_answer"), F.col("keywords"), F.col("aliases"))
    return table(s, d, "gold_items").join(F.broadcast(names)).select("id", k.alias("k")).select("id", F.round("k.rate", 6).alias("rate"))


@query("e04_miss_queue", "SELECT id FROM (SELECT id, length(reference_answer) / 200.0 AS rubric, CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(lower(coalesce(reference_answer, '')), lower(k)))) / len(keywords) END AS rate FROM gold_items) WHERE rubric >= 0.5 AND rate < 0.5")
def _(s, d):
    g = table(s, d, "gold_items").select("id", (F.length("reference_answer") / 200.0).alias("rubric"), E.keyword_hits(F.col("reference_answer"), F.col("keywords"))["rate"].alias("rate"))
    return E.miss_queue(g, "rubric", "rate").select("id")


@query("e08_e09_set_f1", "WITH x AS (SELECT id, list_distinct(regexp_extract_all(question, '[0-9]+')) AS q, list_distinct(regexp_extract_all(coalesce(reference_answer, ''), '[0-9]+')) AS a FROM gold_items) SELECT id, CASE WHEN len(a) = 0 THEN NULL WHEN len(list_intersect(q, a)) = 0 THEN 0 ELSE round(2.0 * len(list_intersect(q, a)) / (len(q) + len(a)), 6) END AS f1 FROM x")
def _(s, d):
    num = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return table(s, d, "gold_items").select("id", F.round(E.set_f1(num("question"), num("reference_answer")), 6).alias("f1"))


@query("e10_rouge")
def _(s, d):
    r = table(s, d, "gold_items").select("id", E.rouge("question", "reference_answer").alias("r"))
    return r.select("id", *(F.round(F.col("r")[i], 6).alias(n) for i, n in enumerate(("rouge1", "rouge2", "rougeL"))))


@query("e10_corpus_bleu")
def _(s, d):
    return E.corpus_bleu(table(s, d, "decon_review_queue").select("subset", F.col("a.ref").alias("ref"), "instruction"), "instruction", "ref", ["subset"])


@query("e14_rewards", "WITH x AS (SELECT sample_id, output, regexp_extract(output, '(?i)(?:answer|class)\\s*[:：is]*\\s*\\(?([A-HY])\\b', 1) AS m, regexp_extract(output, '(?:^|[^A-Za-z])([A-HY])(?:[^A-Za-z]|$)', 1) AS a, regexp_matches(lower(output), '(?:^|[^a-z])yes(?:[^a-z]|$)') AS y, regexp_matches(lower(output), '(?:^|[^a-z])no(?:[^a-z]|$)') AS n FROM data_build WHERE output IS NOT NULL) SELECT sample_id, CAST(y AND NOT n AS DOUBLE) AS yes, CAST(upper(CASE WHEN m <> '' THEN m ELSE a END) = 'A' AS DOUBLE) AS letter FROM x")
def _(s, d):
    x = table(s, d, "data_build").where("output is not null").select("sample_id", "output")
    return x.select("sample_id", E.yes_no_reward(F.col("output"), F.lit("yes")).alias("yes"), E.letter_reward(F.col("output"), F.lit("A")).alias("letter"))


@query("e15_length_buckets", "SELECT CASE WHEN n < 200 THEN '<200' WHEN n < 600 THEN '<600' WHEN n < 1200 THEN '<1200' ELSE '>=1200' END AS bucket, count(*) AS n FROM (SELECT length(coalesce(output, '')) AS n FROM assemble_v5) GROUP BY 1")
def _(s, d):
    return table(s, d, "assemble_v5").groupBy(E.length_bucket(F.col("output")).alias("bucket")).agg(_n().alias("n"))


_TERMS = {"split": ["分割", "拆成", "segmentation"], "inverse": ["反向", "倒推"], "feedback": ["反馈", "feedback"]}


@query("e22_term_tags", "SELECT sample_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(output, '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in _TERMS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM data_build WHERE output IS NOT NULL")
def _(s, d):
    return table(s, d, "data_build").where("output is not null").select("sample_id", F.array_join(E.tagged_terms(F.col("output"), _TERMS), ",").alias("tags"))


@query("e13_task_expansion", "SELECT task, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN category IS NOT NULL THEN 'class' END, CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN length(text) > 500 THEN 'long' END], lambda x: x IS NOT NULL)) AS task FROM documents) GROUP BY task")
def _(s, d):
    tasks = F.array_compact(F.array(F.when(F.col("category").isNotNull(), "class"), F.when(F.col("title").isNotNull(), "title"), F.when(F.length("text") > 500, "long")))
    return table(s, d, "documents").select(F.explode(tasks).alias("task")).groupBy("task").agg(_n().alias("n"))


TWO_SIDED = "least(1.0, 2 * list_sum(list_transform(range(0, CAST(m AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))))"


@query("x02_mcnemar", f"WITH p AS ({_PAIRS}), c AS (SELECT count(*) FILTER (WHERE ja >= 0.45 AND jb < 0.45) AS only_a, count(*) FILTER (WHERE ja < 0.45 AND jb >= 0.45) AS only_b FROM p), n AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS m FROM c) SELECT only_a, only_b, CASE WHEN n = 0 THEN 1 ELSE round({TWO_SIDED}, 6) END AS p FROM n")
def _(s, d):
    c = E.confusion(_pairs(s, d), F.col("ja") >= 0.45, F.col("jb") >= 0.45)
    return c.select("only_a", "only_b", F.round(S.mcnemar("only_a", "only_b"), 6).alias("p"))


@query("x03_paired_bootstrap")
def _(s, d):
    return S.paired_bootstrap(_pairs(s, d), "entry_id", "ja", "jb", ["subset"])


@query("x04_bootstrap_quantiles")
def _(s, d):
    return S.paired_bootstrap(_pairs(s, d), "entry_id", "ja", "jb", ["subset"], variant="numpy")


@query("x08_spearman", f"WITH p AS ({_PAIRS}), r AS (SELECT subset, rank() OVER (PARTITION BY subset ORDER BY ja) + (count(*) OVER (PARTITION BY subset, ja) - 1) / 2.0 AS x, rank() OVER (PARTITION BY subset ORDER BY jb) + (count(*) OVER (PARTITION BY subset, jb) - 1) / 2.0 AS y FROM p) SELECT subset, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(x, y), 6) END AS rho FROM r GROUP BY subset")
def _(s, d):
    return S.spearman(_pairs(s, d), "ja", "jb", ["subset"]).select("subset", "n", F.round("rho", 6).alias("rho"))


@query("x10_mann_whitney", "WITH x AS (SELECT style AS g, a.j AS v FROM decon_review_queue WHERE a.j IS NOT NULL AND style IN ('short', 'long')), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x), s AS (SELECT count(*) FILTER (WHERE g = 'short') AS n1, count(*) FILTER (WHERE g = 'long') AS n2, sum(r) FILTER (WHERE g = 'short') AS r1 FROM r) SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM s")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("style", F.col("a.j").alias("v"))
    return S.mann_whitney(q, "v", "style", "short", "long").select("n1", "n2", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"))


@query("x12_detectable", f"WITH p AS ({_PAIRS}) SELECT subset, count(*) AS n, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(jb - ja) / sqrt(count(*)), 6) AS mde FROM p GROUP BY subset HAVING count(*) > 1")
def _(s, d):
    g = _pairs(s, d).groupBy("subset").agg(_n().alias("n"), F.stddev_samp(F.col("jb") - F.col("ja")).alias("sd")).where("n > 1")
    return g.select("subset", "n", F.round(S.detectable_paired(F.col("sd"), F.col("n")), 6).alias("mde"))


@query("x13_double_order", f"WITH p AS ({_PAIRS}), v AS (SELECT CASE WHEN jb - ja > 0.02 THEN 'B' WHEN ja - jb > 0.02 THEN 'A' ELSE 'tie' END AS x, CASE WHEN jb - ja > 0.05 THEN 'A' WHEN ja - jb > 0.05 THEN 'B' ELSE 'tie' END AS y FROM p), s AS (SELECT CASE x WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END AS sx, CASE y WHEN 'B' THEN 1.0 WHEN 'A' THEN 0.0 ELSE 0.5 END AS sy, CAST(x = 'B' AS INTEGER) + CAST(y = 'B' AS INTEGER) AS b FROM v), g AS (SELECT count(*) AS items, sum((sx + sy) / 2) AS wins, count(*) FILTER (WHERE sx <> sy) AS inconsistent, sum(b) / (2.0 * count(*)) AS b_rate FROM s), w AS (SELECT *, wins / items AS p, 1.959963984540054 AS z FROM g) SELECT items, round(wins, 6) AS wins, round(p, 6) AS p, round(greatest(0, (p + z * z / (2 * items) - z * sqrt(p * (1 - p) / items + z * z / (4 * items * items))) / (1 + z * z / items)), 6) AS low, round(least(1, (p + z * z / (2 * items) + z * sqrt(p * (1 - p) / items + z * z / (4 * items * items))) / (1 + z * z / items)), 6) AS high, round(b_rate, 6) AS b_rate, inconsistent, inconsistent > 0.1 * items AS void FROM w")
def _(s, d):
    p = _pairs(s, d)
    v = lambda low: F.when(F.col("jb") - F.col("ja") > low, "B").when(F.col("ja") - F.col("jb") > low, "A").otherwise("tie")
    ab, ba = p.select("entry_id", F.lit("AB").alias("order"), v(0.02).alias("verdict")), p.select("entry_id", F.lit("BA").alias("order"), F.translate(v(0.05), "AB", "BA").alias("verdict"))
    r = E.double_order(ab.unionByName(ba), "entry_id", "order", "verdict")
    return r.select("items", *(F.round(c, 6).alias(c) for c in ("wins", "p", "low", "high", "b_rate")), "inconsistent", "void")


@query("x14_anchor_consistency", f"WITH p AS ({_PAIRS}) SELECT count(*) AS n, round(count(*) FILTER (WHERE abs(jb - ja) > 0.05) / count(*), 6) AS share, count(*) FILTER (WHERE abs(jb - ja) > 0.05) > 0.1 * count(*) AS alarm FROM p")
def _(s, d):
    off = F.count_if(F.abs(F.col("jb") - F.col("ja")) > 0.05)
    return _pairs(s, d).agg(_n().alias("n"), F.round(off / _n(), 6).alias("share"), (off > 0.1 * _n()).alias("alarm"))


@query("g09_verdict", "WITH p AS (SELECT subset, avg(b.j) - avg(a.j) AS diff FROM decon_review_queue GROUP BY subset), v AS (SELECT max(CASE WHEN diff < -0.15 THEN 3 WHEN diff IS NULL THEN 1 ELSE 0 END) AS r FROM p) SELECT CASE r WHEN 3 THEN 'FAIL' WHEN 2 THEN 'FREEZE' WHEN 1 THEN 'SKIP' ELSE 'ship' END AS verdict FROM v")
def _(s, d):
    g = table(s, d, "decon_review_queue").groupBy("subset").agg((F.avg("b.j") - F.avg("a.j")).alias("diff"))
    return E.verdict(g.select(F.when(F.col("diff") < -0.15, "FAIL").when(F.col("diff").isNull(), "SKIP").otherwise("ship").alias("severity")))


@query("g10_leaderboard", "WITH l AS (SELECT origin AS arm, entry_id, 'a' AS judge, a.j AS score FROM decon_review_queue UNION ALL SELECT origin, entry_id, 'b', b.j FROM decon_review_queue), g AS (SELECT arm, judge, count(DISTINCT entry_id) AS n, CASE WHEN count(DISTINCT entry_id) >= 20 THEN avg(score) END AS mean FROM l WHERE score IS NOT NULL GROUP BY ALL) SELECT g.arm, g.judge, g.n, round(g.mean, 6) AS mean, round(g.mean - h.mean, 6) AS vs_anchor FROM g LEFT JOIN g h ON h.judge = g.judge AND h.arm = 'v2_corpus'")
def _(s, d):
    q = table(s, d, "decon_review_queue")
    l = q.select(F.col("origin").alias("arm"), "entry_id", F.col("a.j").alias("a"), F.col("b.j").alias("b")).unpivot(["arm", "entry_id"], ["a", "b"], "judge", "score")  # noqa: E741
    r = E.leaderboard(l, "arm", "entry_id", "score", "judge", "v2_corpus", least=20)
    return r.select("arm", "judge", "n", F.round("mean", 6).alias("mean"), F.round("vs_anchor", 6).alias("vs_anchor"))


@query("g12_alert_levels", "SELECT CASE WHEN n >= 5000 THEN 'CRIT' WHEN n >= 1000 THEN 'WARN' ELSE 'OK' END AS level, count(*) AS docs FROM (SELECT coalesce(length(text), 0) AS n FROM documents) GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy(E.alert_level(F.coalesce(F.length("text"), F.lit(0)), 1000, 5000).alias("level")).agg(_n().alias("docs"))


@query("g11_pivot_table", "SELECT subset, count(*) FILTER (WHERE style = 'short') AS short, count(*) FILTER (WHERE style = 'long') AS long FROM assemble_v5 GROUP BY subset")
def _(s, d):
    p = table(s, d, "assemble_v5").groupBy("subset").pivot("style", ["short", "long"]).agg(_n())
    return p.select("subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("short", "long")))
