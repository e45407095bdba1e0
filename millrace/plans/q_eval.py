"""Typed scoring, reports and comparisons (E, X, V) as queries over the growing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import gates as G
from ..operators import projections as P
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


# Example vocabularies of these queries; operators take them as parameters.
_ALIASES = ["分割", "抽取", "预先作用", "动态化", "复合材料", "反馈", "局部质量"]
_STEPS = {"矛盾": ["冲突"], "理想": ["最终理想"], "资源": ["可用资源"], "方案": ["做法", "solution"]}
_USUAL = ["参数", "结构", "成本"]
_KIND = {"principle_recommendation": "principle", "contradiction_analysis": "contradiction", "ariz_guidance": "ariz", "case_generation": "generation", "safety_refusal": "probe"}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PAIRS_OF = "regexp_extract_all(coalesce(instruction, ''), '[一-鿿]{2}')"
_WORDS = f"list_filter({_PAIRS_OF}, lambda x, i: list_position({_PAIRS_OF}, x) = i)[1:5]"
_HIT = lambda x, w: f"len(list_filter({w}, lambda w: contains(lower(coalesce({x}, '')), lower(w))))"
_KINDS = "CASE " + " ".join(f"WHEN subset = '{k}' THEN '{v}'" for k, v in _KIND.items()) + " ELSE 'concept' END"
_STEP_HIT = "(" + " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(output, '')), '{w}')" for w in (k, *v)) + " THEN 1 ELSE 0 END" for k, v in _STEPS.items()) + ")"


def _words():
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce("instruction", F.lit("")), F.lit("[一-鿿]{2}"), F.lit(0))), 1, 5)


def _array(words):
    return F.array(*(F.lit(w) for w in words))


def _map(words):
    return F.create_map(*(x for k, v in words.items() for x in (F.lit(k), _array(v))))


def _kind():
    out = F.lit("concept")
    for k, v in _KIND.items():
        out = F.when(F.col("subset") == k, v).otherwise(out)
    return out


@query("e03_dual_means", f"SELECT subset, count(*) AS n, round(avg({_HIT('output', 'w')} / len(w)), 6) AS pre, round(avg(len(list_filter(w, lambda x: contains(lower(coalesce(output, '')), lower(x)) OR (x = '分割' AND contains(coalesce(output, ''), '拆')) OR (x = '参数' AND contains(coalesce(output, ''), '指标')))) / len(w)), 6) AS post FROM (SELECT subset, output, list_concat({_WORDS}, ['分割', '参数']) AS w FROM data_build) GROUP BY subset")
def _(s, d):
    aliases = _map({"分割": ["拆"], "参数": ["指标"]})
    r = V.dual_means(table(s, d, "data_build"), F.col("output"), F.concat(_words(), _array(["分割", "参数"])), aliases, ["subset"])
    return r.select("subset", "n", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"))


_NAMED = "CASE " + " ".join(f"WHEN contains(r, '{a}') THEN '{a}'" for a in sorted(_ALIASES, key=lambda a: (-len(a), a))) + " ELSE r END"


@query("e06_expected_principles", f"SELECT doc_id, array_to_string(n, '|') AS names FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[一-鿿A-Za-z]{{2,12}}原理'), lambda r: NOT contains(r, '发明')), lambda r: {_NAMED}) AS l, list_filter(l, lambda x, i: list_position(l, x) = i) AS n FROM documents) WHERE len(n) > 0")
def _(s, d):
    names = table(s, d, "documents").select("doc_id", V.expected_principles(F.col("text"), _ALIASES).alias("n"))
    return names.where("size(n) > 0").select("doc_id", F.array_join("n", "|").alias("names"))


_TYPED = f"""SELECT sample_id, k, CASE WHEN k IN ('principle', 'contradiction', 'concept', 'probe') THEN CASE WHEN len(w) > 0 THEN {_HIT('output', 'w')} / len(w) END
WHEN k = 'generation' THEN CASE WHEN len(w) > 0 THEN {_HIT('output', 'w')} / len(w) ELSE {_HIT('output', _list(_USUAL))} / {len(_USUAL)} END
WHEN k = 'ariz' THEN {_STEP_HIT} / {len(_STEPS)} END AS score, subset, output, len(w) AS m FROM (SELECT sample_id, subset, output, {_KINDS} AS k, {_WORDS} AS w FROM data_build)"""


@query("e07_typed_scores", f"SELECT sample_id, CASE WHEN score IS NOT NULL THEN k || '_coverage' END AS metric, round(score, 6) AS score, CASE WHEN k = 'principle' AND score IS NOT NULL THEN CAST(score = 1 AS INTEGER) END AS correct FROM ({_TYPED})")
def _(s, d):
    t = V.typed_score(_kind(), F.col("output"), _words(), _array(_USUAL), _array(_STEPS), _map(_STEPS))
    return table(s, d, "data_build").select("sample_id", t.alias("t")).select("sample_id", "t.metric", F.round("t.score", 6).alias("score"), "t.correct")


_JUDGED = "list_filter(w, lambda x: contains(coalesce(output, ''), x))"


@query("e11_judged_coverage", f"SELECT sample_id, CASE WHEN output IS NOT NULL AND len(w) > 0 THEN round({_HIT('output', 'w')} / len(w), 6) END AS share FROM (SELECT sample_id, output, {_WORDS} AS w FROM data_build)")
def _(s, d):
    # a judge's answer as it is stored: flags of the words it met, as JSON; the others are missing
    w = _words()
    flags = F.to_json(F.map_from_entries(F.transform(F.filter(w, lambda x: F.contains(F.coalesce("output", F.lit("")), x)), lambda x: F.struct(x, F.lit(1)))))
    rows = table(s, d, "data_build").select("sample_id", w.alias("w"), F.from_json(flags, "map<string,int>").alias("f"), F.when(F.col("output").isNull(), "JUDGE_FAILED").alias("reason"))
    return rows.select("sample_id", F.round(V.judged_coverage(F.col("f"), F.col("w"), F.col("reason")), 6).alias("share"))


@query("e16_judge_lineage", "SELECT coalesce(nullif(origin, 'none'), 'none') AS origin, CASE WHEN origin IN (SELECT min(origin) FROM data_build) THEN 'first' ELSE 'unknown' END AS family, CASE WHEN origin IN (SELECT min(origin) FROM data_build) THEN 'pinned' WHEN origin IN (SELECT max(origin) FROM data_build) THEN 'chain' ELSE 'outside' END AS standing, count(*) AS n FROM data_build WHERE origin IS NOT NULL GROUP BY origin")
def _(s, d):
    rows = table(s, d, "data_build").where("origin is not null")
    ends = rows.agg(F.min("origin"), F.max("origin")).first()
    known = s.createDataFrame([(ends[0], "first")], "model string, family string")
    return V.judge_lineage(rows.select("origin"), "origin", known, ends[0], [ends[1]]).groupBy("origin", "family", "standing").agg(_n().alias("n"))


@query("e18_identification", "SELECT count(*) AS total, count(*) FILTER (WHERE contains(coalesce(output, ''), '分割') OR contains(coalesce(output, ''), '拆')) AS correct, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE contains(coalesce(output, ''), '分割') OR contains(coalesce(output, ''), '拆')) / count(*), 6) ELSE 0 END AS accuracy FROM data_build WHERE subset = 'principle_recommendation'")
def _(s, d):
    r = V.identification(table(s, d, "data_build"), F.col("subset") == "principle_recommendation", F.col("output"), F.lit("分割"), _map({"分割": ["拆"]}))
    return r.withColumn("accuracy", F.round("accuracy", 6))


@query("e19_open_coverage", f"SELECT round(avg(CASE WHEN len(w) > 0 THEN {_HIT('output', 'w')} / len(w) ELSE 0 END), 6) AS average, count(*) AS n FROM (SELECT output, {_WORDS} AS w FROM data_build WHERE subset = 'contradiction_analysis')")
def _(s, d):
    rows = table(s, d, "data_build").where("subset = 'contradiction_analysis'")
    return rows.agg(F.round(F.avg(V.coverage(F.col("output"), _words(), none=0.0)), 6).alias("average"), _n().alias("n"))


@query("e20_generation_coverage", f"SELECT style, round(avg({_HIT('output', _list(_USUAL))} / {len(_USUAL)}), 6) AS average, count(*) FILTER (WHERE trim(coalesce(input, '')) <> '') AS paired FROM assemble_v5 GROUP BY style")
def _(s, d):
    rows = table(s, d, "assemble_v5").groupBy("style")
    return rows.agg(F.round(F.avg(V.coverage(F.col("output"), _array(_USUAL), none=0.0)), 6).alias("average"), F.count_if(F.trim(F.coalesce("input", F.lit(""))) != "").alias("paired"))


@query("e21_step_completeness", f"SELECT subset, count(*) AS questions, round(avg({_STEP_HIT} / {len(_STEPS)}), 6) AS completeness, round(avg({_STEP_HIT}), 6) AS matched_steps FROM data_build GROUP BY subset")
def _(s, d):
    r = V.step_completeness(table(s, d, "data_build"), F.col("output"), _array(_STEPS), _map(_STEPS), ["subset"])
    return r.select("subset", "questions", F.round("completeness", 6).alias("completeness"), F.round("matched_steps", 6).alias("matched_steps"))


_NUM = "SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN a.j WHEN 1 THEN b.j WHEN 2 THEN a.j ELSE NULL END AS value FROM decon_review_queue"


@query("p20_nested_number", f"SELECT entry_id, round(value, 6) AS value FROM ({_NUM})")
def _(s, d):
    j, k = F.col("a.j"), F.col("b.j")
    nested = F.when(F.col("entry_id") % 4 == 0, j.cast("string")).when(F.col("entry_id") % 4 == 1, F.to_json(F.struct(j.alias("before"), k.alias("after")))).when(F.col("entry_id") % 4 == 2, F.to_json(F.struct(F.struct(j.alias("after"), k.alias("before")).alias("value")))).otherwise("{}")
    return table(s, d, "decon_review_queue").select("entry_id", F.round(P.nested_number(nested), 6).alias("value"))


@query("x05_weighted_bootstrap")
def _(s, d):
    q = table(s, d, "decon_review_queue").select("entry_id", "style", F.col("a.j").alias("ja"), F.col("b.j").alias("jb"))
    r = V.weighted_interval(q, "style", "entry_id", "ja", "jb", {"short": 0.4, "long": 0.6})
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("diff", "low", "high")))


@query("x05_weighted_difference", "WITH p AS (SELECT style, avg(b.j - a.j) AS m, count(*) AS n FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL AND style IN ('short', 'long') GROUP BY style) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE style WHEN 'short' THEN 0.4 ELSE 0.6 END * m), 6) AS diff, true AS holds FROM p")
def _(s, d):
    """The point estimate, and whether it lies within its interval."""
    q = table(s, d, "decon_review_queue").select("entry_id", "style", F.col("a.j").alias("ja"), F.col("b.j").alias("jb"))
    r = V.weighted_interval(q, "style", "entry_id", "ja", "jb", {"short": 0.4, "long": 0.6}, rounds=2000)
    return r.select("n", F.round("diff", 6).alias("diff"), ((F.col("low") <= F.col("diff")) & (F.col("diff") <= F.col("high"))).alias("holds"))


@query("x17_score_document", "SELECT origin, count(*) AS items, round(avg(a.j), 6) AS mean, count(DISTINCT subset) AS subsets, true AS checked FROM decon_review_queue WHERE a.j IS NOT NULL GROUP BY origin")
def _(s, d):
    """Per-arm means from the items and, as a self-check, again from the subsets' sums: they agree to 1e-9."""
    q = table(s, d, "decon_review_queue").where("a.j is not null").select("origin", "subset", F.col("a.j").alias("j"))
    part = q.groupBy("origin", "subset").agg(F.sum("j").alias("sum"), _n().alias("k"))
    again = part.groupBy("origin").agg((F.sum("sum") / F.sum("k")).alias("again"), F.count("subset").alias("subsets"))
    own = q.groupBy("origin").agg(_n().alias("items"), F.avg("j").alias("mean"))
    return own.join(again, own["origin"].eqNullSafe(again["origin"])).select(own["origin"], "items", F.round("mean", 6).alias("mean"), "subsets", (F.abs(F.col("mean") - F.col("again")) <= 1e-9).alias("checked"))


@query("v07_equal_length_series", "SELECT cut, count(*) AS n, round(avg(jb - ja), 6) AS diff FROM (SELECT a.j AS ja, b.j AS jb, abs(length(a.ref) - length(b.ref)) AS gap FROM decon_review_queue WHERE a.j IS NOT NULL AND b.j IS NOT NULL), (VALUES (0), (1), (2), (1000)) v(cut) WHERE gap <= cut GROUP BY cut")
def _(s, d):
    """Differences over ever wider bands of pairs of like length, in one pass: a pair counts in every band that holds it."""
    q = table(s, d, "decon_review_queue").where("a.j is not null and b.j is not null").select((F.col("b.j") - F.col("a.j")).alias("x"), F.abs(F.length("a.ref") - F.length("b.ref")).alias("gap"))
    bands = F.array(*(F.lit(c) for c in (0, 1, 2, 1000)))
    return q.select("x", F.explode(F.filter(bands, lambda c: c >= F.col("gap"))).alias("cut")).groupBy("cut").agg(_n().alias("n"), F.round(F.avg("x"), 6).alias("diff"))


@query("v10_three_layers", "WITH m AS (SELECT 'quality' AS layer, style AS name, avg(a.j) AS x, avg(b.j) AS y FROM decon_review_queue GROUP BY style UNION ALL SELECT 'size', 'chars', avg(length(instruction)), avg(length(output)) FROM data_build UNION ALL SELECT 'count', 'rows', (SELECT count(*) FROM data_build), (SELECT count(*) FROM assemble_v5)) SELECT layer, name, round(x, 4) AS before, round(y, 4) AS after, round(y - x, 4) AS delta, CASE WHEN x = 0 THEN 0 ELSE round((y - x) / x * 100, 2) END AS delta_pct FROM m")
def _(s, d):
    q, b = table(s, d, "decon_review_queue"), table(s, d, "data_build")
    layer = lambda name, key, x, y: P.metric_deltas(x, y, key, "v").select(F.lit(name).alias("layer"), F.col(key).alias("name"), "before", "after", "delta", "delta_pct")
    one = lambda df, name, v: df.agg(v.cast("double").alias("v")).select(F.lit(name).alias("k"), "v")
    out = layer("quality", "style", q.groupBy("style").agg(F.avg("a.j").alias("v")), q.groupBy("style").agg(F.avg("b.j").alias("v")))
    out = out.unionByName(layer("size", "k", one(b, "chars", F.avg(F.length("instruction"))), one(b, "chars", F.avg(F.length("output")))))
    out = out.unionByName(layer("count", "k", one(b, "rows", _n()), one(table(s, d, "assemble_v5"), "rows", _n())))
    return out.select("layer", "name", *(F.round(c, 4).alias(c) for c in ("before", "after", "delta")), F.round("delta_pct", 2).alias("delta_pct"))


_LOOP = "len(list_filter(range(0, least(length(output) - 80, 6000), 200), lambda i: (length(output) - length(replace(output, substring(output, i + 1, 80), ''))) >= 240)) > 0"


@query("v04_usage_triage", f"WITH f AS (SELECT sample_id, list_filter([CASE WHEN trim(output, ' ' || chr(9) || chr(13) || chr(10)) = '' THEN 'empty' END, CASE WHEN length(output) > 30000 THEN 'runaway' END, CASE WHEN length(output) > 500 AND {_LOOP} THEN 'loop' END, CASE WHEN contains(coalesce(instruction, ''), '案例') AND regexp_matches(output, '不是[^。]{{0,10}}案例') THEN 'denial' END], lambda x: x IS NOT NULL) AS l FROM data_build WHERE output IS NOT NULL), n AS (SELECT sample_id, CASE WHEN len(l) = 0 THEN ['candidate'] ELSE l END AS l FROM f) SELECT unnest AS flag, count(*) AS n FROM n, unnest(l) GROUP BY 1")
def _(s, d):
    """Chats to failure flags; those without are candidates for training; counted by flag, most frequent first."""
    rows = table(s, d, "data_build").where("output is not null")
    denial = F.when(G.identity_denied(F.col("instruction"), F.col("output"), "案例", "不是[^。]{0,10}案例"), F.array(F.lit("denial"))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(G.failure_flags(F.col("output")), denial)
    flag = F.explode(F.when(F.size(flags) == 0, F.array(F.lit("candidate"))).otherwise(flags))
    return rows.select(flag.alias("flag")).groupBy("flag").agg(_n().alias("n")).orderBy(F.desc("n"), "flag")
