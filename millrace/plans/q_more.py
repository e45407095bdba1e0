"""The rest of the inventory, mostly small shapes of the operators before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import dedup as D
from ..operators import gates as G
from ..operators import projections as P
from ..operators import scoring as E
from ..operators.components import components
from ..operators.ranking import numbered
from ..shared import cut
from .q_dedup import norm_a_sql
from .q_scores import TWO_SIDED
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


_PAIRS = "SELECT entry_id, subset, origin, style, a.j AS ja, b.j AS jb FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL"


def _pairs(s, d):
    return table(s, d, "decon_review_queue").where("a.j is not null and b.j is not null").select("entry_id", "subset", "origin", "style", F.col("a.j").alias("ja"), F.col("b.j").alias("jb"))


@query("f03_closed_think", "SELECT sample_id, length(trim(regexp_replace(output, '<think>.*?</think>\\s*', '', 'gs'))) AS n FROM data_build WHERE output IS NOT NULL AND contains(output, '<think>')")
def _(s, d):
    x = table(s, d, "data_build").where(F.contains("output", F.lit("<think>")))
    return x.select("sample_id", F.length(F.trim(F.regexp_replace("output", r"(?s)<think>.*?</think>\s*", ""))).alias("n"))


@query("f08_char_limit", "SELECT count(*) FILTER (WHERE coalesce(length(instruction), 0) + coalesce(length(output), 0) <= 400) AS kept, count(*) AS rows FROM data_build")
def _(s, d):
    return table(s, d, "data_build").agg(F.count_if(G.max_chars(("instruction", "output"), 400).keep).alias("kept"), _n().alias("rows"))


@query("f24_probe_validation", "SELECT id, len(keywords) BETWEEN 1 AND 3 AND length(question) >= 4 AS valid FROM gold_items WHERE ref_set = 'B'")
def _(s, d):
    return table(s, d, "gold_items").where("ref_set = 'B'").select("id", (F.size("keywords").between(1, 3) & (F.length("question") >= 4)).alias("valid"))


@query("f27_diversity", "WITH r AS (SELECT id, row_number() OVER (PARTITION BY substring(question, 1, 30) ORDER BY id) AS k FROM gold_items) SELECT id FROM r WHERE k = 1")
def _(s, d):
    g = table(s, d, "gold_items")
    low = s.createDataFrame([(0.1, 0.1)], "d1 double, d2 double")
    return P.diverse(g.select("id", "question"), "question", "id", low).select("id")


@query("f31_chat_tags", "SELECT sample_id FROM data_build WHERE instruction IS NOT NULL AND sample_id % 4 NOT IN (0, 1)")
def _(s, d):
    """A quarter of the chats lack their closing tags, a quarter the assistant's opening: neither is valid."""
    chat = F.concat(T.chat_prompt("S", F.col("instruction")), F.coalesce("output", F.lit("")), F.lit("<|im_end|>"))
    chat = F.when(F.col("sample_id") % 4 == 0, F.replace(chat, F.lit("<|im_end|>"), F.lit(""))).when(F.col("sample_id") % 4 == 1, F.replace(chat, F.lit("<|im_start|>assistant"), F.lit(""))).otherwise(chat)
    return table(s, d, "data_build").where("instruction is not null").where(P.valid_chat(chat)).select("sample_id")


@query("f32_bad_calls", "SELECT sample_id, 1 + CASE WHEN sample_id % 3 = 0 THEN 0 ELSE 1 END AS calls FROM data_build")
def _(s, d):
    """Two calls a row, one with the row's own text as its argument, cut off in a third of the rows."""
    call = lambda i, a: F.struct(F.lit(i).alias("id"), F.lit("f").alias("name"), a.alias("arguments"))
    own = F.to_json(F.struct(F.coalesce("instruction", F.lit("")).alias("q")))
    raw = F.to_json(F.array(call("1", F.lit('{"a": 1}')), call("2", F.when(F.col("sample_id") % 3 == 0, F.substr(own, F.lit(1), (F.length(own) - 2).cast("int"))).otherwise(own))))
    return table(s, d, "data_build").select("sample_id", F.size(F.from_json(P.without_bad_calls(raw), "array<struct<id:string>>")).alias("calls"))


@query("f16_residual_zero", "SELECT count(*) FILTER (WHERE regexp_matches(regexp_replace(output, '<think>.*?</think>', '', 'gs'), '<think>|</think>')) AS residual, count(*) FILTER (WHERE contains(output, '<think>')) AS before FROM data_build WHERE output IS NOT NULL")
def _(s, d):
    """Answers that still hold a mark of thinking after closed blocks went (unclosed ones), and those that held one before."""
    x = table(s, d, "data_build").where("output is not null")
    return x.agg(F.count_if(T.has_think(T.strip_think(F.col("output")))).alias("residual"), F.count_if(F.contains("output", F.lit("<think>"))).alias("before"))


@query("p03_user_text", "SELECT sample_id, length(CASE WHEN trim(coalesce(input, '')) = '' THEN instruction ELSE instruction || chr(10) || chr(10) || input END) AS n FROM data_build")
def _(s, d):
    return table(s, d, "data_build").select("sample_id", F.length(T.user_text(F.col("instruction"), F.col("input"), "\n\n")).alias("n"))


@query("p05_unwrapped", "SELECT sample_id, md5(output) AS digest FROM data_build WHERE output IS NOT NULL AND NOT starts_with(ltrim(output), '{') AND NOT starts_with(ltrim(output), '[')")
def _(s, d):
    """Answers bare, wrapped once and wrapped twice, under different names."""
    o = F.col("output")
    one, two = F.to_json(F.struct(o.alias("response"))), F.to_json(F.struct(F.struct(o.alias("output")).alias("answer")))
    raw = F.when(F.col("sample_id") % 3 == 0, o).when(F.col("sample_id") % 3 == 1, one).otherwise(two)
    rows = table(s, d, "data_build").where("output is not null and not startswith(ltrim(output), '{') and not startswith(ltrim(output), '[')")
    return rows.select("sample_id", raw.alias("raw")).select("sample_id", P.unwrapped("raw").alias("text")).select("sample_id", F.md5("text").alias("digest"))


@query("p07_parsed_records", "SELECT sample_id, CASE sample_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS records, CASE WHEN sample_id % 4 < 3 THEN length(instruction) END AS chars FROM data_build WHERE instruction IS NOT NULL AND NOT regexp_matches(instruction, '[\\[\\]{}]')")
def _(s, d):
    """Responses that are an array inside other text, JSON lines, an object around one record, or no JSON at all."""
    rows = table(s, d, "data_build").where("instruction is not null").where(~F.col("instruction").rlike(r"[\[\]{}]"))
    item, m = F.to_json(F.struct(F.col("instruction").alias("q"))), F.col("sample_id") % 4
    raw = F.when(m == 0, F.concat(F.lit("text ["), item, F.lit(',{"q":"x"}] end'))).when(m == 1, F.concat(item, F.lit('\n{"q":"y"}'))).when(m == 2, F.concat(F.lit('{"items":['), item, F.lit("]}"))).otherwise(F.lit("no records here"))
    r = rows.select("sample_id", P.parsed_records(raw, "q:string").alias("r"))
    return r.select("sample_id", F.greatest(F.lit(0), F.coalesce(F.size("r"), F.lit(0))).alias("records"), F.length(F.try_element_at("r", F.lit(1))["q"]).alias("chars"))


@query("p12_examples_appended", "SELECT g.id, length(g.question || coalesce(chr(10) || a.description_zh, '')) AS n FROM gold_items g LEFT JOIN subject_areas a ON a.name_zh = g.category")
def _(s, d):
    e = table(s, d, "subject_areas").select(F.col("name_zh").alias("key"), F.col("description_zh").alias("example"))
    return P.appended_examples(table(s, d, "gold_items").select("id", "category", "question"), "category", "question", e).select("id", F.length("question").alias("n"))


@query("p14_variants", "SELECT g.id, CAST(v AS INTEGER) AS variant, CASE v WHEN 0 THEN question WHEN 1 THEN '请问，' || question WHEN 2 THEN '另外，' || question ELSE '请问，' || question END AS question FROM gold_items g, range(0, 4) r(v)")
def _(s, d):
    return P.variants(table(s, d, "gold_items").select("id", "question"), "question", ["请问，", "另外，"], 3).select("id", "variant", "question")


@query("p18_metric_deltas", "WITH b AS (SELECT style, avg(a.j) AS v FROM decon_review_queue GROUP BY 1), a AS (SELECT style, avg(b.j) AS v FROM decon_review_queue GROUP BY 1) SELECT b.style, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS delta, round((a.v - b.v) / b.v * 100, 4) AS delta_pct FROM b JOIN a ON a.style = b.style")
def _(s, d):
    q = table(s, d, "decon_review_queue")
    m = P.metric_deltas(q.groupBy("style").agg(F.avg("a.j").alias("v")), q.groupBy("style").agg(F.avg("b.j").alias("v")), "style", "v")
    return m.select("style", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta")), F.round("delta_pct", 4).alias("delta_pct"))


@query("p19_preferred_metric", "SELECT entry_id, coalesce(a.j, b.j) AS metric FROM decon_review_queue")
def _(s, d):
    return table(s, d, "decon_review_queue").select("entry_id", P.preferred("a.j", "b.j").alias("metric"))


@query("p21_candidate_view", f"WITH p AS ({_PAIRS}) SELECT entry_id, CASE WHEN jb > ja THEN 'win' WHEN jb < ja THEN 'loss' ELSE 'tie' END AS view FROM p")
def _(s, d):
    v = F.when(F.col("jb") > F.col("ja"), "B").when(F.col("jb") < F.col("ja"), "A").otherwise("tie")
    return _pairs(s, d).select("entry_id", P.candidate_view(F.lit("AB"), v).alias("view"))


@query("p22_tag_from_name", "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN '' ELSE coalesce(split, 'none') || '_' || style END AS tag FROM assemble_v5 WHERE style IS NOT NULL")
def _(s, d):
    """Names with a tag of several parts, and others of another form."""
    tag = F.concat_ws("_", F.coalesce("split", F.lit("none")), "style")
    name = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("eval_"), tag, F.lit(".json"))).otherwise(F.concat(F.lit("eval_v4_"), tag, F.lit("_20250301_010203.json")))
    return table(s, d, "assemble_v5").where("style is not null").select("record_id", P.tag_of(name).alias("tag"))


@query("p24_assistant_chars", "SELECT sample_id, length(output) AS n FROM data_build WHERE output IS NOT NULL AND instruction IS NOT NULL AND NOT contains(output, '<|im')")
def _(s, d):
    x = table(s, d, "data_build").where("output is not null and instruction is not null and not contains(output, '<|im')")
    return x.select("sample_id", P.assistant_chars(F.concat(T.chat_prompt("S", F.col("instruction")), F.col("output"), F.lit("<|im_end|>"))).alias("n"))


@query("j02_aligned_metrics", f"WITH p AS ({_PAIRS}) SELECT entry_id, row_number() OVER (PARTITION BY subset ORDER BY entry_id) AS k, ja, jb FROM p")
def _(s, d):
    return numbered(_pairs(s, d), ["subset"], [F.col("entry_id")]).select("entry_id", "k", "ja", "jb")


@query("j18_key_sheet", "WITH k AS (SELECT entry_id, CASE WHEN substring(md5('7|' || entry_id), 1, 1) < '8' THEN 'A' ELSE 'B' END AS first FROM decon_review_queue), v AS (" + _PAIRS + ") SELECT CASE WHEN (jb > ja) = (first = 'A') THEN 'one' ELSE 'two' END AS arm, count(*) AS n FROM v JOIN k USING (entry_id) GROUP BY 1")
def _(s, d):
    sheet = table(s, d, "decon_review_queue").select("entry_id", F.when(F.substring(D.hash_order("7", F.col("entry_id")), 1, 1) < "8", "A").otherwise("B").alias("first"))
    j = _pairs(s, d).join(sheet, "entry_id")
    return j.groupBy(F.when((F.col("jb") > F.col("ja")) == (F.col("first") == "A"), "one").otherwise("two").alias("arm")).agg(_n().alias("n"))


@query("a10_means_with_note", "SELECT subset, round(avg(a.j), 6) AS mean, count(a.j) AS n, CASE WHEN count(a.j) < 30 THEN 'descriptive' ELSE '' END AS note FROM decon_review_queue GROUP BY subset")
def _(s, d):
    g = table(s, d, "decon_review_queue").groupBy("subset").agg(F.round(F.avg("a.j"), 6).alias("mean"), F.count("a.j").alias("n"))
    return g.withColumn("note", F.when(F.col("n") < 30, "descriptive").otherwise(""))


@query("a15_framing_check", "SELECT ref_set, round(avg(CASE WHEN contains(question, '请') THEN 1.0 ELSE 0.0 END), 6) AS framed, round(median(length(reference_answer) / length(question)), 6) AS ratio FROM gold_items WHERE reference_answer IS NOT NULL GROUP BY 1")
def _(s, d):
    g = table(s, d, "gold_items").where("reference_answer is not null")
    return g.groupBy("ref_set").agg(F.round(F.avg(F.contains("question", F.lit("请")).cast("double")), 6).alias("framed"), F.round(F.median(F.length("reference_answer") / F.length("question")), 6).alias("ratio"))


@query("a21_null_flips", "SELECT source_path, page_num, count(*) AS runs, count(DISTINCT coalesce(heading, '')) > 1 OR count(*) > count(heading) AS flipped FROM corpus_builder WHERE page_num IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    g = table(s, d, "corpus_builder").where("page_num is not null").groupBy("source_path", "page_num").agg(_n().alias("runs"), F.count("heading").alias("h"), F.count_distinct(F.coalesce("heading", F.lit(""))).alias("k")).where("runs > 1")
    return g.select("source_path", "page_num", "runs", ((F.col("k") > 1) | (F.col("runs") > F.col("h"))).alias("flipped"))


@query("a22_hit_but_miss", "WITH k AS (SELECT unnest(keywords) AS keyword, coalesce(reference_answer, '') AS base, question AS cand FROM gold_items) SELECT keyword, count(*) FILTER (WHERE contains(base, keyword)) AS base_hits, count(*) FILTER (WHERE contains(base, keyword) AND NOT contains(cand, keyword)) AS lost FROM k GROUP BY 1")
def _(s, d):
    k = table(s, d, "gold_items").select(F.explode("keywords").alias("keyword"), F.coalesce("reference_answer", F.lit("")).alias("base"), F.col("question").alias("cand"))
    hit = F.contains("base", F.col("keyword"))
    return k.groupBy("keyword").agg(F.count_if(hit).alias("base_hits"), F.count_if(hit & ~F.contains("cand", F.col("keyword"))).alias("lost"))


@query("a23_artifact_or_missing", "WITH k AS (SELECT id, unnest(keywords) AS keyword, coalesce(reference_answer, '') AS a FROM gold_items) SELECT CASE WHEN contains(a, keyword) THEN 'hit' WHEN contains(a, substring(keyword, 1, 2)) THEN 'artifact' ELSE 'missing' END AS class, count(*) AS n FROM k GROUP BY 1")
def _(s, d):
    k = table(s, d, "gold_items").select(F.explode("keywords").alias("keyword"), F.coalesce("reference_answer", F.lit("")).alias("a"))
    c = F.when(F.contains("a", F.col("keyword")), "hit").when(F.contains("a", F.substring("keyword", 1, 2)), "artifact").otherwise("missing")
    return k.groupBy(c.alias("class")).agg(_n().alias("n"))


@query("a24_position_effect", f"WITH p AS ({_PAIRS}) SELECT style, round(avg(CASE WHEN jb > ja THEN 1.0 WHEN jb = ja THEN 0.5 ELSE 0.0 END), 6) AS win_rate, count(*) AS n FROM p GROUP BY style")
def _(s, d):
    w = F.when(F.col("jb") > F.col("ja"), 1.0).when(F.col("jb") == F.col("ja"), 0.5).otherwise(0.0)
    return _pairs(s, d).groupBy("style").agg(F.round(F.avg(w), 6).alias("win_rate"), _n().alias("n"))


@query("a30_premium_by_origin", f"WITH p AS ({_PAIRS}) SELECT origin, round(avg(jb) - avg(ja), 6) AS premium FROM p GROUP BY origin")
def _(s, d):
    return _pairs(s, d).groupBy("origin").agg(F.round(F.avg("jb") - F.avg("ja"), 6).alias("premium"))


@query("a31_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(avg(value), 6) AS mean, round(count(*) / sum(value), 6) AS rate FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.avg("value"), 6).alias("mean"), F.round(_n() / F.sum("value"), 6).alias("rate"))


@query("w07_run_ranks", f"WITH p AS ({_PAIRS}), m AS (SELECT origin, round(avg(ja), 6) AS loss FROM p GROUP BY 1) SELECT origin, loss, row_number() OVER (ORDER BY loss, origin) AS rank FROM m")
def _(s, d):
    m = _pairs(s, d).groupBy("origin").agg(F.round(F.avg("ja"), 6).alias("loss"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy("loss", "origin")))  # one row for each run


@query("o02_drop_most_similar", "SELECT entry_id FROM (SELECT entry_id, row_number() OVER (PARTITION BY subset ORDER BY coalesce(a.j, 0) DESC, entry_id) AS k, count(*) OVER (PARTITION BY subset) AS n FROM decon_review_queue) WHERE k > floor(n * 0.15)")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("entry_id", "subset", F.coalesce("a.j", F.lit(0.0)).alias("j"))
    n = q.groupBy(F.col("subset").alias("of")).agg(_n().alias("n"))
    r = numbered(q, ["subset"], [F.desc("j"), F.col("entry_id")])
    return r.join(F.broadcast(n), r["subset"].eqNullSafe(n["of"])).where(F.col("k") > F.floor(F.col("n") * F.lit(0.15))).select("entry_id")


@query("o04_spread_verdict", f"WITH p AS ({_PAIRS}), m AS (SELECT origin, avg(ja) AS v FROM p GROUP BY 1) SELECT round(max(v) - min(v), 6) AS spread, CASE WHEN max(v) - min(v) < 0.01 THEN 'tie' ELSE 'ranked' END AS verdict FROM m")
def _(s, d):
    m = _pairs(s, d).groupBy("origin").agg(F.avg("ja").alias("v"))
    gap = F.max("v") - F.min("v")
    return m.agg(F.round(gap, 6).alias("spread"), F.when(gap < 0.01, "tie").otherwise("ranked").alias("verdict"))


@query("o06_ordered_sample", "SELECT id, ref_set FROM (SELECT id, ref_set, row_number() OVER (PARTITION BY ref_set ORDER BY md5('3|' || id), id) AS k FROM gold_items) WHERE k <= 7")
def _(s, d):
    w = Window.partitionBy("ref_set").orderBy("_h", "id")
    g = table(s, d, "gold_items").select("id", "ref_set").withColumn("_h", D.hash_order("3", F.col("id")))
    return g.withColumn("k", F.row_number().over(w)).where("k <= 7").select("id", "ref_set")


@query("u03_difference", "SELECT DISTINCT origin FROM assemble_v5 EXCEPT SELECT origin FROM data_build")
def _(s, d):
    return table(s, d, "assemble_v5").select("origin").subtract(table(s, d, "data_build").select("origin"))


@query("u05_append", "SELECT md5(output) AS digest, count(*) AS n FROM (SELECT output FROM data_build WHERE output IS NOT NULL UNION ALL SELECT output FROM assemble_v5 WHERE style = 'long' AND output IS NOT NULL) GROUP BY 1")
def _(s, d):
    a, b = table(s, d, "data_build").where("output is not null").select("output"), table(s, d, "assemble_v5").where("style = 'long' and output is not null").select("output")
    return a.union(b).groupBy(F.md5("output").alias("digest")).agg(_n().alias("n"))


_G = "lower(regexp_replace(group_id, '^\\s+|\\s+$', '', 'g'))"
_K = f"substring({norm_a_sql('instruction')}, 1, 12)"


@query("d11_union_groups", f"WITH RECURSIVE e AS (SELECT DISTINCT 'g:' || {_G} AS a, 'k:' || {_K} AS b FROM assemble_v5 WHERE group_id IS NOT NULL AND {_G} <> '' AND {_K} <> '' AND length({_K}) = 12), s AS (SELECT b FROM e GROUP BY b HAVING count(*) > 1), l AS (SELECT e.a, e.b FROM e JOIN s USING (b)), u AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT x AS node, x AS root FROM (SELECT DISTINCT x FROM u) UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE u.y > r.root) SELECT substring(node, 3) AS group_id, min(root) AS root FROM r WHERE starts_with(node, 'g:') GROUP BY node")
def _(s, d):
    g = F.lower(F.regexp_replace("group_id", r"^\s+|\s+$", ""))
    k = F.substring(T.norm_a(F.col("instruction")), 1, 12)
    e = table(s, d, "assemble_v5").where("group_id is not null").select(g.alias("g"), k.alias("k")).where("g <> '' and length(k) = 12").distinct()
    shared = e.groupBy("k").agg(_n().alias("n")).where("n > 1").select("k")
    c = components(e.join(shared, "k").select(F.concat(F.lit("g:"), "g").alias("x"), F.concat(F.lit("k:"), "k").alias("y")))
    return c.where("node like 'g:%'").select(F.expr("substring(node, 3)").alias("group_id"), F.col("label").alias("root"))


_ROOTS = f"""WITH RECURSIVE x AS (SELECT record_id AS id, lower(trim(split)) AS split, CASE WHEN {_G} <> '' THEN {_G} END AS g, CASE WHEN length({_K}) = 12 THEN {_K} END AS k FROM assemble_v5),
u AS (SELECT 'g:' || g AS x, 'k:' || k AS y FROM x WHERE g IS NOT NULL AND k IS NOT NULL UNION SELECT 'k:' || k, 'g:' || g FROM x WHERE g IS NOT NULL AND k IS NOT NULL),
r AS (SELECT x AS node, x AS root FROM (SELECT DISTINCT x FROM u) UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE u.y > r.root), c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
o AS (SELECT id, split, coalesce(a.root, b.root, 'g:' || g, 'k:' || k, 'i:' || id) AS root FROM x LEFT JOIN c a ON a.node = 'g:' || g LEFT JOIN c b ON b.node = 'k:' || k)"""
_TG = "CASE WHEN len(t) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END"
_CROSS = f"""t AS (SELECT record_id AS id, lower(trim(split)) AS s, regexp_extract_all(lower(coalesce(instruction, '')), '[a-z0-9]+|[一-鿿]') AS t FROM assemble_v5), gr AS (SELECT id, s, {_TG} AS g FROM t), e AS (SELECT id, s, len(g) AS n, unnest(g) AS x FROM gr),
hit AS (SELECT DISTINCT id FROM (SELECT a.id, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.s IN ('validation', 'test') AND b.s = 'train' GROUP BY a.id, b.id, a.n, b.n) WHERE 2 * o >= na + nb - o)"""


@query("d14_moved_roots", f"{_ROOTS}, {_CROSS} SELECT o.id AS record_id, o.split FROM o JOIN (SELECT DISTINCT split, root FROM o JOIN hit USING (id)) m ON m.split = o.split AND m.root = o.root")
def _(s, d):
    """Rows of validation and test that go back to train: those of a root one of whose rows there is near a train row."""
    g, k = F.lower(F.regexp_replace("group_id", r"^\s+|\s+$", "")), F.substring(T.norm_a(F.col("instruction")), 1, 12)
    rows = cut(table(s, d, "assemble_v5").select(F.col("record_id").alias("id"), F.lower(F.trim("split")).alias("split"), F.when(g != "", F.concat(F.lit("g:"), g)).alias("g"), F.when(F.length(k) == 12, F.concat(F.lit("k:"), k)).alias("k"), "instruction"))
    root = components(rows.where("g is not null and k is not null").select(F.col("g").alias("x"), F.col("k").alias("y")))
    at = rows.join(root.select(F.col("node").alias("g"), F.col("label").alias("a")), "g", "left").join(root.select(F.col("node").alias("k"), F.col("label").alias("b")), "k", "left")
    at = cut(at.select("id", "split", F.coalesce("a", "b", "g", "k", F.concat(F.lit("i:"), F.col("id").cast("string"))).alias("root")))
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("validation", "test"), 1)
    hits = D.near_pairs(rows, "id", "instruction", 0.5, side).select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    moved = at.where("split in ('validation', 'test')").join(hits, "id", "left_semi").select("split", "root").distinct()
    return at.join(moved, ["split", "root"], "left_semi").select(F.col("id").alias("record_id"), "split")


@query("d17_ratio_sample", "WITH h AS (SELECT sample_id, row_number() OVER (PARTITION BY subset ORDER BY md5('5|' || sample_id), sample_id) AS r, count(*) OVER (PARTITION BY subset) AS n FROM data_build) SELECT sample_id FROM h WHERE r <= floor(n * 0.4 + 0.5)")
def _(s, d):
    return D.stratified_sample(table(s, d, "data_build").select("sample_id", "subset"), "subset", F.col("sample_id"), "5", 0.4).select("sample_id")


@query("d18_blinded_pairs", "SELECT entry_id, CASE WHEN substring(md5('4200|' || entry_id), 1, 1) < '8' THEN 'AB' ELSE 'BA' END AS \"order\" FROM decon_review_queue ORDER BY md5('18|' || entry_id), entry_id LIMIT 40")
def _(s, d):
    q = D.hash_sample(table(s, d, "decon_review_queue").select("entry_id"), F.col("entry_id"), "18", 40)
    return q.select("entry_id", F.when(F.substring(D.hash_order("4200", F.col("entry_id")), 1, 1) < "8", "AB").otherwise("BA").alias("order"))


@query("d23_reserve", "SELECT entry_id FROM decon_review_queue WHERE entry_id NOT IN (SELECT entry_id FROM decon_review_queue ORDER BY md5('80|' || entry_id), entry_id LIMIT 80)")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("entry_id")
    return q.join(D.hash_sample(q, F.col("entry_id"), "80", 80), "entry_id", "left_anti")


@query("e05_any_alias", "SELECT g.id, count(DISTINCT a.area) FILTER (WHERE contains(coalesce(g.reference_answer, ''), a.name_zh) OR contains(lower(coalesce(g.reference_answer, '')), a.area)) AS n FROM gold_items g CROSS JOIN subject_areas a GROUP BY g.id")
def _(s, d):
    a = table(s, d, "subject_areas").agg(F.collect_list(F.struct("name_zh", "area")).alias("names"))
    x = F.coalesce("reference_answer", F.lit(""))
    hit = F.filter("names", lambda p: F.contains(x, p["name_zh"]) | F.contains(F.lower(x), p["area"]))
    return table(s, d, "gold_items").join(F.broadcast(a)).select("id", F.size(hit).cast("long").alias("n"))


@query("e12_record_assembly", "SELECT q.entry_id, length(q.instruction) >= 60 AS gate, q.a.j AS kw, coalesce(q.b.j, -1) AS judge FROM decon_review_queue q")
def _(s, d):
    q = table(s, d, "decon_review_queue")
    judge = q.where("b.j is not null").select("entry_id", F.col("b.j").alias("jb"))
    return q.select("entry_id", (F.length("instruction") >= 60).alias("gate"), F.col("a.j").alias("kw")).join(judge, "entry_id", "left").select("entry_id", "gate", "kw", F.coalesce("jb", F.lit(-1.0)).alias("judge"))


@query("e17_score_report", f"WITH p AS ({_PAIRS}) SELECT origin, round((CASE WHEN avg(ja) <= 1 THEN avg(ja) * 100 ELSE avg(ja) END + least(avg(jb) * 100 / 2, 100)) / 2, 4) AS score FROM p GROUP BY 1")
def _(s, d):
    g = _pairs(s, d).groupBy("origin").agg(F.avg("ja").alias("a"), F.avg("jb").alias("b"))
    return g.select("origin", F.round((F.when(F.col("a") <= 1, F.col("a") * 100).otherwise(F.col("a")) + F.least(F.col("b") * 100 / 2, F.lit(100.0))) / 2, 4).alias("score"))


@query("x06_bootstrap_9750")
def _(s, d):
    return S.paired_bootstrap(_pairs(s, d), "entry_id", "ja", "jb", ["style"], high=9750)


@query("x09_spearman_p", f"WITH p AS ({_PAIRS}), r AS (SELECT style, rank() OVER (PARTITION BY style ORDER BY ja) + (count(*) OVER (PARTITION BY style, ja) - 1) / 2.0 AS x, rank() OVER (PARTITION BY style ORDER BY jb) + (count(*) OVER (PARTITION BY style, jb) - 1) / 2.0 AS y FROM p), c AS (SELECT style, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS rho FROM r GROUP BY style), t AS (SELECT *, abs(rho) * sqrt(n - 1) AS z FROM c) SELECT style, n, round(rho, 6) AS rho, abs(z) < 1.959963984540054 AS not_significant FROM t")
def _(s, d):
    r = S.spearman(_pairs(s, d), "ja", "jb", ["style"])
    return r.select("style", "n", F.round("rho", 6).alias("rho"), (S.spearman_p(F.col("rho"), F.col("n")) > 0.05).alias("not_significant"))


@query("x11_sign_test", f"WITH p AS ({_PAIRS}), g AS (SELECT style, count(*) FILTER (WHERE jb > ja) AS k, count(*) AS n FROM p WHERE ja <> jb GROUP BY style), t AS (SELECT *, least(k, n - k) AS m FROM g) SELECT style, k, n, round({TWO_SIDED}, 6) AS p FROM t")
def _(s, d):
    g = _pairs(s, d).where("ja <> jb").groupBy("style").agg(F.count_if(F.col("jb") > F.col("ja")).alias("k"), _n().alias("n"))
    return g.select("style", "k", "n", F.round(S.sign_test("k", "n"), 6).alias("p"))


@query("x15_arms_conflict", f"WITH p AS ({_PAIRS}) SELECT sign(avg(jb - ja) FILTER (WHERE style = 'short')) <> sign(avg(jb - ja) FILTER (WHERE style = 'long')) AS conflict FROM p")
def _(s, d):
    diff = F.col("jb") - F.col("ja")
    m = lambda k: F.signum(F.avg(F.when(F.col("style") == k, diff)))
    return _pairs(s, d).agg((m("short") != m("long")).alias("conflict"))


@query("x16_comparison_bundle")
def _(s, d):
    """Interval and exact test of each subset and of all rows (subset ``*``)."""
    p = _pairs(s, d).withColumn("subset", F.explode(F.array(F.col("subset"), F.lit("*"))))
    boot = S.paired_bootstrap(p, "entry_id", "ja", "jb", ["subset"])
    c = p.groupBy("subset").agg(F.count_if((F.col("ja") >= 0.45) & (F.col("jb") < 0.45)).alias("b"), F.count_if((F.col("ja") < 0.45) & (F.col("jb") >= 0.45)).alias("c"))
    return boot.join(c.select("subset", S.mcnemar("b", "c").alias("p")), boot["subset"].eqNullSafe(c["subset"])).select(boot["*"], "p")


@query("g_gate_table", f"WITH p AS ({_PAIRS}), g AS (SELECT subset, avg(jb - ja) AS diff, count(*) AS n FROM p GROUP BY subset) SELECT subset, n, round(diff, 6) AS diff, CASE WHEN n < 5 THEN 'SKIP' WHEN diff <= -0.15 THEN 'FAIL' WHEN diff <= -0.05 THEN 'FREEZE' ELSE 'PASS' END AS gate FROM g")
def _(s, d):
    g = _pairs(s, d).groupBy("subset").agg(F.avg(F.col("jb") - F.col("ja")).alias("diff"), _n().alias("n"))
    return g.select("subset", "n", F.round("diff", 6).alias("diff"), F.when(F.col("n") < 5, "SKIP").when(F.col("diff") <= -0.15, "FAIL").when(F.col("diff") <= -0.05, "FREEZE").otherwise("PASS").alias("gate"))


@query("r04_terminal_states", "SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'COMPLETED' ELSE 'ALIVE' END AS state FROM events GROUP BY 1")
def _(s, d):
    from ..streaming.incremental import terminal_state

    e = table(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("m"))
    return terminal_state(e, "user_id", "o", "m")


@query("v09_design_minus_done", "WITH i AS (SELECT id FROM gold_items WHERE ref_set = 'B'), c AS (SELECT id, o, CAST(r AS INTEGER) AS rep FROM i, (VALUES ('AB'), ('BA')) v(o), range(0, 3) q(r)) SELECT id, o AS \"order\", rep FROM c WHERE NOT (rep = 0 AND o = 'AB')")
def _(s, d):
    cells = F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("order")
    c = table(s, d, "gold_items").where("ref_set = 'B'").select("id", cells).select("id", "order", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rep"))
    done = c.where("rep = 0 and order = 'AB'")
    return c.join(done, ["id", "order", "rep"], "left_anti")


@query("v11_length_attribution", "SELECT origin, count(*) AS n, quantile_cont(length(output), 0.5) AS p50 FROM data_build WHERE output IS NOT NULL AND origin IN ('v2_corpus', 'gated_corpus') GROUP BY origin")
def _(s, d):
    x = table(s, d, "data_build").where("output is not null and origin in ('v2_corpus', 'gated_corpus')")
    return x.groupBy("origin").agg(_n().alias("n"), F.percentile(F.length("output"), F.lit(0.5)).alias("p50"))


@query("v12_phase_scores", "SELECT g.subset, round(avg(CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(lower(coalesce(reference_answer, '')), lower(k)))) / len(keywords) END), 6) AS coverage, count(*) AS n FROM gold_items g GROUP BY g.subset")
def _(s, d):
    k = E.keyword_hits(F.col("reference_answer"), F.col("keywords"))
    return table(s, d, "gold_items").groupBy("subset").agg(F.round(F.avg(k["rate"]), 6).alias("coverage"), _n().alias("n"))
