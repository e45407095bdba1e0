"""Sources that vary, corpus writing, quotas, stages and checks of a build (S, K, O, D, R, V) as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import building as B
from ..operators import dedup as D
from ..operators.chunking import write_ready
from ..shared import cut, shared_dir
from ..sources import io
from .q_dedup import REF, norm_a_sql
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


def _folder(s) -> str:
    return f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}"


def _arrays(df, at, part, *columns):
    """Files that are one JSON array of records each, a few hundred records a file."""
    rows = df.groupBy(part.alias("part"), (F.pmod(F.xxhash64(columns[0]), F.lit(40))).alias("p")).agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    rows.select("value", "part", "p").write.partitionBy("part", "p").text(at)


@query("s03_json_arrays", "SELECT coalesce(subset, 'none') AS subset, count(*) AS n, count(output) AS outputs FROM data_build GROUP BY 1")
def _(s, d):
    at = _folder(s)
    _arrays(table(s, d, "data_build"), at, F.coalesce("subset", F.lit("none")), "sample_id", "output")
    rows = s.read.schema("sample_id long, output string, part string").option("multiLine", True).json(at)
    return rows.groupBy(F.col("part").alias("subset")).agg(_n().alias("n"), F.count("output").alias("outputs"))


@query("s06_extracted_text", "SELECT file_type, count(*) AS n, count(*) FILTER (WHERE file_type IN ('txt', 'md', 'html')) AS extracted FROM corpus_builder GROUP BY 1")
def _(s, d):
    r = io.extracted(table(s, d, "corpus_builder").select("file_type", F.coalesce("text", F.lit("")).alias("text")), "file_type", "text", io.EXTRACTORS)
    return r.groupBy("file_type").agg(_n().alias("n"), F.count("extracted").alias("extracted"))


@query("s08_keyed_rows", "SELECT sample_id, md5(coalesce(output, '')) AS digest FROM data_build")
def _(s, d):
    at, rows = _folder(s), table(s, d, "data_build").select("sample_id", "output")
    odd = F.col("sample_id") % 2 == 1
    io.write_jsonl(rows.where(odd), f"{at}/rows.jsonl")
    io.write_csv(rows.where(~odd), f"{at}/rows.csv")
    both = io.read_keyed(s, f"{at}/rows.jsonl", "sample_id long, output string").unionByName(io.read_keyed(s, f"{at}/rows.csv", "sample_id long, output string"))
    return both.select("sample_id", F.md5(F.coalesce("output", F.lit(""))).alias("digest"))


@query("s11_event_log", "WITH e AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_id % 7 = 0 THEN 'm' || event_id % 5 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM events) SELECT event_id, model, event_type || '!' AS content, CASE WHEN event_id % 3 = 0 THEN 'search' ELSE '' END AS tools FROM e WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def _(s, d):
    """Lines of session logs as they are written: changes of model, messages of parts, tool calls, lines of other kinds and broken ones."""
    e = table(s, d, "events")
    part = lambda kind, text=None, name=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(name).cast("string").alias("name"))
    parts = F.array(part("text", F.col("event_type")), part("text", F.lit("!")))
    tools = F.when(F.col("event_id") % 3 == 0, F.array(part("toolCall", name="search"))).otherwise(F.slice(parts, 1, 0))
    message = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("user").alias("role"), F.concat(parts, tools).alias("content")).alias("message")))
    change = F.to_json(F.struct(F.lit("model_change").alias("type"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("modelId")))
    line = F.when(F.col("event_id") % 7 == 0, change).when(F.col("event_id") % 11 == 0, "{broken").otherwise(message)
    got = io.session_messages(e.select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")
    return got.select("event_id", "model", "content", F.array_join("tools", ",").alias("tools"))


@query("s12_latest_by_tag", "SELECT style AS tag, max(split) AS last FROM assemble_v5 WHERE split IS NOT NULL AND style IS NOT NULL GROUP BY style")
def _(s, d):
    """One result file for each style and split, named by both; the last of each style by name, read again."""
    at = _folder(s)
    rows = table(s, d, "assemble_v5").where("split is not null and style is not null").select("style", "split").distinct()
    for r in rows.orderBy("style", "split").collect():  # a few files
        B.write_text(s, f"{at}/eval_{r.style}_{r.split}.json", r.split)
    last = io.latest_files(s, at, "eval_*.json", "^eval_([^_]+)_")
    return last.select("tag", F.regexp_extract("path", r"_([^_/]+)\.json$", 1).alias("last"))


@query("s18_first_source", "SELECT origin, count(*) AS n FROM data_build GROUP BY origin")
def _(s, d):
    rows = B.first_source(s, [(f"{d}/no_such.parquet", s.read.parquet), (f"{d}/data_build.parquet", s.read.parquet)], lambda: s.createDataFrame([("built-in",)], "origin string"))
    return rows.groupBy("origin").agg(_n().alias("n"))


@query("s19_seeds_by_file", "SELECT subset, count(*) AS n FROM data_build WHERE origin = (SELECT min(origin) FROM data_build) AND subset IS NOT NULL GROUP BY subset")
def _(s, d):
    at, rows = _folder(s), table(s, d, "data_build")
    rows.where("subset is not null").select("sample_id", F.col("origin").alias("source"), "subset").write.partitionBy("subset").json(at)
    seed = rows.agg(F.min("origin")).first()[0]
    files = s.read.schema("sample_id long, source string").option("recursiveFileLookup", True).json(at).withColumn("subset", F.url_decode(F.regexp_extract(F.input_file_name(), "subset=([^/]+)/", 1)))
    return files.where(F.col("source") == seed).groupBy("subset").agg(_n().alias("n"))


@query("s20_result_documents", "SELECT entry_id, round(a.j, 6) AS score FROM decon_review_queue WHERE a.j IS NOT NULL")
def _(s, d):
    """Score files per tag: half of them bare lists, half with the rows under ``records``."""
    at = _folder(s)
    rows = table(s, d, "decon_review_queue").where("a.j is not null").select("entry_id", F.col("a.j").alias("score"))
    doc = rows.groupBy(F.pmod(F.xxhash64("entry_id"), F.lit(40)).alias("p")).agg(F.collect_list(F.struct("entry_id", "score")).alias("records"))
    doc.select(F.when(F.col("p") % 2 == 0, F.to_json("records")).otherwise(F.to_json(F.struct("records"))).alias("value"), F.concat(F.lit("tag"), "p").alias("tag")).write.partitionBy("tag").text(at)
    return io.read_records(s, at, "entry_id long, score double").select("entry_id", F.round("score", 6).alias("score"))


@query("s21_preferred_answers", "SELECT sample_id, length(output) AS n FROM data_build WHERE output IS NOT NULL AND NOT starts_with(ltrim(output), '{')")
def _(s, d):
    rows = table(s, d, "data_build").where("output is not null and not startswith(ltrim(output), '{')")
    answer = F.when(F.col("sample_id") % 2 == 0, F.to_json(F.struct(F.col("output").alias("text")))).otherwise(F.col("output"))
    original = rows.select("sample_id", answer.alias("response"))
    repaired = original.limit(99)  # too few rows: the cache isn't complete
    return B.preferred_source(repaired, original, 100).select("sample_id", F.length(B.response_text(F.col("response"))).alias("n"))


@query("k02_corpus_written", "SELECT count(DISTINCT text) AS kept, count(text) - count(DISTINCT text) AS dropped, count(*) - count(text) AS failed, 0 AS first, count(DISTINCT text) - 1 AS last FROM corpus_builder")
def _(s, d):
    rows = table(s, d, "corpus_builder").select("id", "text")
    once = rows.where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("id").alias("source"), F.min("text").alias("text"))
    done = cut(write_ready(once, "text", ["source"]))
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    stats = done.agg(_n().alias("kept"), F.min(number).cast("int").alias("first"), F.max(number).alias("last"))
    return stats.join(rows.agg((F.count("text") - F.lit(0)).alias("texts"), F.count_if(F.col("text").isNull()).alias("failed"))).select("kept", (F.col("texts") - F.col("kept")).alias("dropped"), "failed", "first", "last")  # one row each


@query("k05_report", "SELECT 'by_subset' AS stage, subset, count(*) AS n FROM data_build GROUP BY subset UNION ALL SELECT 'by_origin', origin, count(*) FROM data_build GROUP BY origin")
def _(s, d):
    at, rows = f"{_folder(s)}.json", table(s, d, "data_build")
    count = lambda c: rows.groupBy(F.col(c).alias("k")).agg(_n().alias("n"))
    B.write_text(s, at, B.report_json({"by_subset": count("subset"), "by_origin": count("origin")}))
    doc = s.read.schema("stages array<struct<stage:string,rows:array<struct<k:string,n:bigint>>>>").option("multiLine", True).json(at)
    return doc.select(F.explode("stages").alias("x")).select("x.stage", F.explode("x.rows").alias("r")).select("stage", F.col("r.k").alias("subset"), "r.n")


@query("k06_manifest", "SELECT CAST(count(*) + 4 AS BIGINT) AS lines, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT origin, count(*) AS n FROM data_build GROUP BY origin)")
def _(s, d):
    """A manifest of one table, written and read again: its lines, and the sum of its counts."""
    at = f"{_folder(s)}.md"
    B.write_text(s, at, io.manifest({"Rows by origin": table(s, d, "data_build").groupBy("origin").agg(_n().alias("n"))}))
    lines = s.read.text(at)
    return lines.agg(_n().alias("lines"), F.coalesce(F.sum(F.regexp_extract("value", r"\| (\d+) \|$", 1).try_cast("long")), F.lit(0)).alias("rows"))


@query("k07_digests", "SELECT count(*) AS files, true AS same FROM (SELECT DISTINCT coalesce(subset, 'none') FROM data_build)")
def _(s, d):
    """Digests of written files: the same content gives the same digest, and every file has one."""
    rows = table(s, d, "data_build").select(F.coalesce("subset", F.lit("none")).alias("subset"), F.col("sample_id").cast("string").alias("value"))
    a, b = _folder(s), _folder(s)
    for at in (a, b):
        rows.repartition("subset").sortWithinPartitions("subset", "value").write.partitionBy("subset").text(at)
    name = F.regexp_extract("path", "(subset=[^/]+)/", 1)
    one, two = (io.file_digests(s, f"{at}/*/*.txt").select(name.alias("k"), F.col("sha256").alias(c)) for at, c in ((a, "x"), (b, "y")))
    return one.join(two, "k", "full").agg(_n().alias("files"), F.bool_and(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same"))


@query("k08_appended", "SELECT origin, count(*) AS n FROM data_build GROUP BY origin")
def _(s, d):
    at, rows = _folder(s), table(s, d, "data_build").select("sample_id", "origin")
    for k in (0, 1, 2):
        io.write_jsonl(rows.where(F.col("sample_id") % 3 == k), at, mode="append")
    return io.read_jsonl(s, at, "sample_id long, origin string").groupBy("origin").agg(_n().alias("n"))


@query("o05_until_limit", "WITH r AS (SELECT sample_id, coalesce(sum(1 + sample_id % 3) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM data_build) SELECT sample_id FROM r WHERE before < 500")
def _(s, d):
    rows = table(s, d, "data_build").select("sample_id", (1 + F.col("sample_id") % 3).alias("size"))
    return B.until_limit(rows, "sample_id", "size", 500).select("sample_id")


@query("d04_decontaminated", f"{REF} SELECT entry_id FROM decon_review_queue WHERE entry_id NOT IN (SELECT id FROM j WHERE j >= 0.5)")
def _(s, d):
    q = table(s, d, "decon_review_queue")
    hits = D.max_similarity(q, table(s, d, "gold_items"), "entry_id", "instruction", "id", "question").where("j >= 0.5").select(F.col("id").alias("entry_id"))
    return q.select("entry_id").join(hits, "entry_id", "left_anti")


@query("d07_accepted")
def _(s, d):
    """In order of id, a row is accepted unless it is near a held-out item or a row accepted before."""
    q = table(s, d, "decon_review_queue").select(F.col("entry_id").alias("id"), "instruction")
    far = cut(q.join(D.max_similarity(q, table(s, d, "gold_items"), "id", "instruction", "id", "question").where("j < 0.5").select("id"), "id", "left_semi"))
    return D.greedy_keep(far, D.near_pairs(far, "id", "instruction", 0.5)).where("kept").select("id")


_RANKED = "row_number() OVER (PARTITION BY subset ORDER BY {o}, sample_id) AS r"
_CAP = 200


@query("d22_rebalanced", f"WITH x AS (SELECT sample_id, subset, {_RANKED.format(o='length(coalesce(output, chr(0)[1:0])) DESC')}, row_number() OVER (PARTITION BY subset ORDER BY md5('42|' || sample_id), sample_id) AS h FROM data_build) SELECT sample_id, subset FROM x WHERE subset IS NULL OR (subset = 'safety_refusal' AND h <= {_CAP}) OR (subset = 'contradiction_analysis' AND r <= {_CAP}) OR subset NOT IN ('safety_refusal', 'contradiction_analysis')")
def _(s, d):
    rows = table(s, d, "data_build").select("sample_id", "subset", "output")
    r = B.rebalanced(rows, "subset", {"safety_refusal": _CAP, "contradiction_analysis": _CAP}, {"safety_refusal": "random"}, "output", "sample_id")
    return r.select("sample_id", "subset")


_TERMS = ["矛盾", "分割", "抽取", "资源", "理想", "参数", "反馈", "方案"]


@query("d21_term_coverage", "WITH t AS (SELECT subset, unnest([" + ", ".join(f"'{t}'" for t in _TERMS) + "]) AS t FROM (SELECT DISTINCT subset FROM data_build)), have AS (SELECT t.subset, count(*) AS terms FROM t WHERE EXISTS (SELECT 1 FROM data_build b WHERE b.subset IS NOT DISTINCT FROM t.subset AND contains(coalesce(output, ''), t)) GROUP BY t.subset), n AS (SELECT subset, least(count(*), 60) AS kept FROM data_build GROUP BY subset) SELECT n.subset, n.kept, coalesce(have.terms, 0) AS terms FROM n LEFT JOIN have ON have.subset IS NOT DISTINCT FROM n.subset")
def _(s, d):
    """What the greedy choice keeps: rows and covered terms of each subset; all terms that occur are covered."""
    rows = table(s, d, "data_build").select("sample_id", "subset", "output")
    terms = F.array_compact(F.array(*(F.when(F.contains(F.coalesce("output", F.lit("")), F.lit(t)), t) for t in _TERMS)))
    kept = B.term_coverage(rows, "subset", terms, "sample_id", 60).select("sample_id")
    back = rows.join(kept, "sample_id").select("subset", "sample_id", F.explode_outer(terms).alias("t"))
    return back.groupBy("subset").agg(F.count_distinct("sample_id").alias("kept"), F.count_distinct("t").alias("terms"))


@query("d20_rebalanced", "SELECT subset, CASE WHEN subset = 'contradiction_analysis' THEN least(count(*), 90) WHEN subset = 'principle_recommendation' THEN least(count(*), 70) ELSE count(*) END AS kept FROM data_build GROUP BY subset")
def _(s, d):
    """Two subsets cut to a cap, by term coverage and over lengths; the rows left of each subset."""
    rows = table(s, d, "data_build").select("sample_id", "subset", "output")
    terms = F.array_compact(F.array(*(F.when(F.contains(F.coalesce("output", F.lit("")), F.lit(t)), t) for t in _TERMS)))
    kept = B.coverage_and_lengths(rows, "subset", terms, "output", "sample_id", {"contradiction_analysis": 90, "principle_recommendation": 70})
    return kept.groupBy("subset").agg(_n().alias("kept"))


@query("d25_quota_order", "WITH q AS (SELECT origin, least(count(*), 40) AS q FROM data_build WHERE origin IS NOT NULL GROUP BY origin), e AS (SELECT origin, unnest(range(1, q + 1)) AS left_over FROM q) SELECT origin, row_number() OVER (ORDER BY left_over DESC, origin DESC) AS place FROM e")
def _(s, d):
    q = table(s, d, "data_build").where("origin is not null").groupBy("origin").agg(F.least(_n(), F.lit(40)).alias("q"))
    return B.quota_order(q, "origin", "q")


@query("d26_checked_build", f"SELECT 'has_text' AS \"check\", count(*) FILTER (WHERE trim(coalesce(instruction, '')) = '') AS violations FROM assemble_v5 UNION ALL SELECT 'known_split', count(*) FILTER (WHERE split IS NOT NULL AND split NOT IN ('train', 'validation', 'test')) FROM assemble_v5 UNION ALL SELECT 'record_id_unique', count(record_id) - count(DISTINCT record_id) FROM assemble_v5 UNION ALL SELECT 'groups_apart', count(*) FROM (SELECT lower(trim(group_id)) FROM assemble_v5 WHERE group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'prefix_apart', count(*) FROM (SELECT {norm_a_sql('instruction')}[1:12] AS k FROM assemble_v5 WHERE instruction IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def _(s, d):
    rules = {"has_text": F.trim(F.coalesce("instruction", F.lit(""))) != "", "known_split": F.col("split").isNull() | F.col("split").isin("train", "validation", "test")}
    apart = {"groups_apart": (F.lower(F.trim("group_id")), "split"), "prefix_apart": (F.substring(T.norm_a(F.col("instruction")), 1, 12), "split")}
    return B.checks(table(s, d, "assemble_v5"), "record_id", rules, ["record_id"], apart)


@query("r02_stages", "SELECT subset, count(*) AS n, 2 AS ran FROM data_build WHERE output IS NOT NULL GROUP BY subset")
def _(s, d):
    """Two stages, run twice: the second time both are read from their tables."""
    at, runs = _folder(s), 0
    for _ in range(2):
        stages = B.Stages(s, at)
        kept = stages.run("kept", lambda: table(s, d, "data_build").where("output is not null").select("sample_id", "subset"))
        counts = stages.run("counts", lambda: kept.groupBy("subset").agg(_n().alias("n")))
        runs += len(stages.ran)
    return counts.withColumn("ran", F.lit(runs))


@query("r08_completed", "SELECT count(*) AS rows, count(DISTINCT sample_id) AS ids, CAST(0 AS BIGINT) AS made_twice FROM data_build")
def _(s, d):
    """Generation that resumes: a first run makes a third, a second one the rest, a third nothing."""
    at, work = _folder(s), table(s, d, "data_build").select("sample_id", "instruction")
    for run, part in enumerate((work.where("sample_id % 3 = 0"), work, work)):
        done = B.completed(s, part, "sample_id", at, lambda w, run=run: w.select("sample_id", F.md5(F.coalesce("instruction", F.lit(""))).alias("answer"), F.lit(run).alias("run")))
    return done.agg(_n().alias("rows"), F.count_distinct("sample_id").alias("ids"), F.count_if(F.col("run") == 2).alias("made_twice"))


@query("v08_sampled_batches", "WITH h AS (SELECT id, category, text, row_number() OVER (ORDER BY md5('11|' || id), id) AS r FROM corpus_builder), b AS (SELECT (r - 1) // 25 AS batch, category, length(trim(coalesce(text, ''))) >= 100 AS ok FROM h WHERE r <= 400) SELECT category, count(*) FILTER (WHERE ok) AS valid, count(*) AS n, count(DISTINCT batch) AS batches FROM b GROUP BY category")
def _(s, d):
    rows = D.hash_sample(table(s, d, "corpus_builder").select("id", "category", "text"), F.col("id"), "11", 400)
    r = F.row_number().over(Window.orderBy(D.hash_order("11", F.col("id")), "id"))  # 400 rows
    b = rows.select(F.floor((r - 1) / 25).alias("batch"), "category", (F.length(F.trim(F.coalesce("text", F.lit("")))) >= 100).alias("ok"))
    return b.groupBy("category").agg(F.count_if("ok").alias("valid"), _n().alias("n"), F.count_distinct("batch").alias("batches"))
