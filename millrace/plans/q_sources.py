"""Sources, sinks, incremental processing and workflow helpers (S, K, R, V) as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..shared import shared_dir
from ..sources import io
from ..streaming import incremental as R
from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


def _folder(s) -> str:
    return f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}"


@query("s01_k01_json_lines", "SELECT sample_id, md5(coalesce(output, '')) AS digest FROM data_build")
def _(s, d):
    at = _folder(s)
    io.write_jsonl(table(s, d, "data_build").select("sample_id", "output"), at)
    return io.read_jsonl(s, at, "sample_id long, output string").select("sample_id", F.md5(F.coalesce("output", F.lit(""))).alias("digest"))


@query("s02_bad_lines", "SELECT sample_id, md5(coalesce(output, '')) AS digest FROM data_build WHERE sample_id % 5 NOT IN (0, 1)")
def _(s, d):
    """A fifth of the lines are cut in their middle, a fifth blank: both are skipped."""
    at, rows = _folder(s), table(s, d, "data_build")
    line = F.to_json(F.struct("sample_id", "output"))
    broken = F.when(F.col("sample_id") % 5 == 0, F.substr(line, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(line) / 2)).cast("int"))).when(F.col("sample_id") % 5 == 1, "").otherwise(line)
    rows.select(broken.alias("value")).write.text(at)
    return io.read_jsonl(s, at, "sample_id long, output string", bad_lines="skip").select("sample_id", F.md5(F.coalesce("output", F.lit(""))).alias("digest"))


@query("k03_k04_partitioned", "SELECT coalesce(split, '') AS split, count(*) AS n FROM assemble_v5 GROUP BY 1")
def _(s, d):
    at = _folder(s)
    io.write_jsonl(table(s, d, "assemble_v5").select("record_id", F.coalesce("split", F.lit("none")).alias("split")), at, by=["split"])
    back = s.read.schema("record_id long, split string").json(at)
    return back.groupBy(F.when(F.col("split") == "none", "").otherwise(F.col("split")).alias("split")).agg(_n().alias("n"))


@query("s04_nested_samples", "SELECT subset, count(*) AS n FROM gold_items GROUP BY subset")
def _(s, d):
    at = _folder(s)
    table(s, d, "gold_items").groupBy("ref_set").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "subset")).alias("samples"))).alias("value")).select("value", "ref_set").write.partitionBy("ref_set").text(at)  # one object a file
    return io.read_wrapped(s, at, "id:string,subset:string").groupBy("subset").agg(_n().alias("n"))


@query("s07_csv", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def _(s, d):
    """Whole texts, with their quotes, line ends and commas, through the writer and the reader of CSV."""
    at = _folder(s)
    io.write_csv(table(s, d, "documents").select("text", "doc_id", "lang"), at)
    return io.read_csv(s, at, "text string, doc_id long, lang string").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("s05_k07_files", "SELECT coalesce(subset, 'none') AS category, count(*) > 0 AS found FROM data_build GROUP BY 1")
def _(s, d):
    """Files below a folder by their extension, without those of a folder to skip; the category is the first folder."""
    at = _folder(s)
    rows = table(s, d, "data_build").select(F.coalesce("subset", F.lit("none")).alias("subset"), F.col("sample_id").cast("string").alias("value"))
    rows.write.partitionBy("subset").text(f"{at}/in")
    rows.write.partitionBy("subset").text(f"{at}/in/skipped")
    files = io.list_files(s, f"{at}/in", "*.txt", skip=("/skipped/",))
    return files.groupBy(F.url_decode(F.regexp_extract("category", "subset=(.*)", 1)).alias("category")).agg((_n() > 0).alias("found"))


@query("s10_chat_normaliser", "SELECT sample_id, CASE WHEN trim(coalesce(instruction, '')) = '' THEN 0 ELSE 1 END + CASE WHEN trim(coalesce(output, '')) = '' THEN 0 ELSE 1 END AS messages, length(CASE WHEN trim(coalesce(output, '')) <> '' THEN output WHEN trim(coalesce(instruction, '')) <> '' THEN instruction END) AS last FROM data_build")
def _(s, d):
    """Chat dumps of both shapes, lists and maps of history; system messages and blank ones go."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    user, answer = msg("user", F.col("instruction")), msg("assistant", F.col("output"))
    by_list = F.to_json(F.struct(F.array(msg("system", F.lit("s")), user, answer).alias("messages")))
    by_map = F.to_json(F.struct(F.struct(F.create_map(F.lit("m1"), user, F.lit("m2"), answer).alias("messages")).alias("history")))
    raw = F.when(F.col("sample_id") % 2 == 0, by_list).otherwise(by_map)
    m = table(s, d, "data_build").select("sample_id", io.normalized_chat(raw).alias("m"))
    return m.select("sample_id", F.size("m").alias("messages"), F.length(F.try_element_at("m", F.lit(-1))["content"]).alias("last"))


@query("s12_latest_file", "SELECT source_path, max(id) AS id FROM corpus_builder GROUP BY source_path")
def _(s, d):
    return io.latest(table(s, d, "corpus_builder"), ["source_path"], F.col("id"), "id")


@query("s13_log_fields", "SELECT sample_id, nullif(regexp_extract(output, '第([0-9]+)轮', 1), '') AS round FROM data_build WHERE output IS NOT NULL")
def _(s, d):
    x = table(s, d, "data_build").where("output is not null").select("sample_id", "output")
    return io.log_fields(x, "output", {"round": "第([0-9]+)轮"}).select("sample_id", "round")


@query("s14_metrics", "SELECT CAST(user_id AS VARCHAR) AS labels, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id")
def _(s, d):
    lines = table(s, d, "events").groupBy("user_id").agg(F.concat(F.lit("app:hits{"), F.col("user_id").cast("string"), F.lit("} "), _n().cast("string")).alias("line")).select("line")
    return io.metric_value(lines, "line", "app:hits")


@query("s16_front_matter", "SELECT id, trim(coalesce(category, '')) AS category, trim(coalesce(file_type, '')) AS file_type FROM corpus_builder")
def _(s, d):
    text = F.concat(F.lit("---\nkind: "), F.coalesce("category", F.lit("")), F.lit("\ntype:   "), F.coalesce("file_type", F.lit("")), F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    m = table(s, d, "corpus_builder").select("id", C.front_matter(text).alias("m"))
    return m.select("id", F.col("m")["kind"].alias("category"), F.col("m")["type"].alias("file_type"))


@query("s17_literal_lists", "SELECT record_id, CASE WHEN record_id % 10 = 0 OR contains(coalesce(subset, ''), chr(39)) THEN 0 ELSE 2 END AS n FROM assemble_v5")
def _(s, d):
    """List cells as a program prints them; a tenth of them broken, which gives no items."""
    text = F.concat(F.lit("['"), F.coalesce("subset", F.lit("")), F.lit("', '"), F.coalesce("style", F.lit("")), F.when(F.col("record_id") % 10 == 0, F.lit("")).otherwise(F.lit("']")))
    return table(s, d, "assemble_v5").select("record_id", F.size(C.literal_list(text)).alias("n"))


@query("p08_delimited_pairs", "SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN sample_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM data_build")
def _(s, d):
    """No, one or two pairs in each text, whose texts are the row's own."""
    q, a = (F.concat(F.lit("x"), F.regexp_replace(F.coalesce(c, F.lit("")), "[【】]", "")) for c in ("instruction", "output"))
    pair = lambda i: F.concat(F.lit(f"【问题{i}】"), q, F.lit(f"【回答{i}】"), a)
    text = F.concat(F.when(F.col("sample_id") % 3 != 0, pair(1)).otherwise(""), F.when(F.col("sample_id") % 2 == 0, pair(2)).otherwise(""))
    return table(s, d, "data_build").select("sample_id", F.size(C.delimited_pairs(text)).alias("n"))


@query("r01_remaining", "SELECT subset, count(*) AS n FROM data_build WHERE sample_id NOT IN (SELECT record_id FROM assemble_v5 WHERE record_id IS NOT NULL AND style = 'long') GROUP BY subset")
def _(s, d):
    done = table(s, d, "assemble_v5").where("style = 'long'").select(F.col("record_id").alias("sample_id"))
    return R.remaining(table(s, d, "data_build"), done, "sample_id").groupBy("subset").agg(_n().alias("n"))


@query("r03_latest_snapshot", "SELECT source_path, page_num, arg_max(id, (extracted_at, id)) AS id FROM corpus_builder WHERE page_num IS NOT NULL GROUP BY source_path, page_num")
def _(s, d):
    rows = table(s, d, "corpus_builder").where("page_num is not null").select("source_path", "page_num", "id", F.struct("extracted_at", "id").alias("v"))
    return R.latest_snapshot(rows, ["source_path", "page_num"], "v").select("source_path", "page_num", "id")


@query("r07_best_so_far", "SELECT entry_id, min(a.j) OVER (PARTITION BY origin ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM decon_review_queue WHERE a.j IS NOT NULL")
def _(s, d):
    q = table(s, d, "decon_review_queue").where("a.j is not null").select("entry_id", "origin", F.col("a.j").alias("j"))
    return R.best_so_far(q, ["origin"], "entry_id", "j").select("entry_id", "best")


@query("r_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return R.windowed_counts(table(s, d, "events"), "ts", "event_type", "1 hour", "10 minutes")


@query("r_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(s, d):
    return R.sessions(table(s, d, "events"), "ts", "user_id", "30 minutes")


@query("r_stream_harvest", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    at = _folder(s)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(s, d, "events").schema)
    table(s, d, "events").write.parquet(f"{at}/in")
    R.harvest(s, f"{at}/in", schema, f"{at}/out", f"{at}/state", "parquet")
    R.harvest(s, f"{at}/in", schema, f"{at}/out", f"{at}/state", "parquet")  # nothing new, nothing twice
    return s.read.schema(schema).parquet(f"{at}/out").groupBy("event_type").agg(_n().alias("n"))


@query("v06_sweep_product", "SELECT a.subset AS x, b.style AS y FROM (SELECT DISTINCT subset FROM gold_items WHERE subset IS NOT NULL) a CROSS JOIN (SELECT DISTINCT style FROM assemble_v5) b")
def _(s, d):
    x = table(s, d, "gold_items").where("subset is not null").select(F.col("subset").alias("x")).distinct()
    y = table(s, d, "assemble_v5").select(F.col("style").alias("y")).distinct()
    return x.crossJoin(y)  # two lists of settings, a handful of rows


@query("v03_cost_estimate", "SELECT origin, count(*) AS n, CAST(ceil(count(*) / 25) AS BIGINT) AS requests, round(ceil(count(*) / 25) / 3.0, 2) AS minutes FROM data_build GROUP BY origin")
def _(s, d):
    requests = F.ceil(_n() / 25)
    return table(s, d, "data_build").groupBy("origin").agg(_n().alias("n"), requests.alias("requests"), F.round(requests / 3.0, 2).alias("minutes"))
