"""Readers and writers of the formats the pipeline meets. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import running_last


#: How CSV writes null, so that it differs from the empty text.
NULL = "\\N"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, bad_lines: str = "fail") -> DataFrame:
    """JSON lines; blank lines are skipped. ``bad_lines``: fail, skip, or keep (with ``_corrupt_record``)."""
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_lines]
    if bad_lines == "keep":
        schema = f"{schema if isinstance(schema, str) else schema.toDDL()}, _corrupt_record string"
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: str, name: str = "subset") -> DataFrame:
    """Whole-file arrays of records, the file's stem in a column."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn(name, F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_wrapped(spark: SparkSession, path: str, item: str, field: str = "samples") -> DataFrame:
    """Records below a field of whole-file JSON objects."""
    return spark.read.schema(f"{field} array<struct<{item}>>").option("multiLine", True).json(path).select(F.explode(field).alias("_r")).select("_r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks, cells of any length and perhaps a byte order mark."""
    names = schema.split(",")[0].split()[0]
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("nullValue", NULL).option("enforceSchema", True).csv(path)
    return df.withColumn(names, F.regexp_replace(names, "^﻿", "")) if dict(df.dtypes)[names] == "string" else df


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows in JSON lines or CSV, by the path's suffix."""
    return read_csv(spark, path, schema) if path.endswith(".csv") else read_jsonl(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that ``read_csv`` reads back as it was: every cell quoted, quotes doubled, null as ``\\N``."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", NULL).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_records(spark: SparkSession, path: str, item: str, field: str = "records") -> DataFrame:
    """Rows of result documents: whole files that are a list of rows or an object with the list under ``field``; one schema reads both."""
    names = [c.split()[0] for c in item.split(",")]
    rows = spark.read.schema(f"{item}, {field} array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in item.split(','))}>>").option("multiLine", True).json(path)
    return rows.select(F.explode(F.when(F.col(field).isNotNull(), F.col(field)).otherwise(F.array(F.struct(*names)))).alias("_r")).select("_r.*")


def _plain_markup(x: Column) -> Column:
    """Text of a page of markup: without scripts, styles and tags; the five named entities resolved."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"[ \t]+", " "))


#: How each type of file becomes text; more are added by name. Types that aren't here come out null.
EXTRACTORS = {"txt": lambda x: x, "md": lambda x: x, "html": _plain_markup}


def extracted(df: DataFrame, kind: str, content: str, extractors: dict) -> DataFrame:
    """Adds ``extracted``: the text by the extractor of the row's type; null marks a file that failed."""
    out = F.lit(None).cast("string")
    for name, f in extractors.items():
        out = F.when(F.col(kind) == name, f(F.col(content))).otherwise(out)
    return df.withColumn("extracted", out)


def session_messages(df: DataFrame, session: str, order: str, line: str) -> DataFrame:
    """(``session``, ``order``, ``role``, ``content``, ``tools``, ``model``) of the messages in session logs of JSON lines.

    A change of model holds for the lines after it in its session. The parts of a message's
    content that are text are joined, the names of its tool calls collected; broken lines, other
    roles and messages without text or tool calls are skipped.
    """
    part = "struct<type:string,text:string,name:string>"
    d = F.from_json(line, f"type string, modelId string, message struct<role:string,content:array<{part}>>")
    flat = F.get_json_object(line, "$.message.content")
    rows = df.select(session, order, d.alias("d"), F.when(~F.startswith(flat, F.lit("[")), flat).alias("plain"))
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("model", F.last(F.when(F.col("d.type") == "model_change", F.col("d.modelId")), ignorenulls=True).over(w))
    parts = F.col("d.message.content")
    text = F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), ""), F.col("plain"), F.lit(""))
    tools = F.coalesce(F.transform(F.filter(parts, lambda p: p["type"] == "toolCall"), lambda p: F.coalesce(p["name"], F.lit("?"))), F.array().cast("array<string>"))
    rows = rows.where("d.type = 'message' and d.message.role in ('user', 'assistant')").select(session, order, F.col("d.message.role").alias("role"), text.alias("content"), tools.alias("tools"), "model")
    return rows.where("trim(content) <> '' or size(tools) > 0")


def list_files(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = ()) -> DataFrame:
    """(``path``, ``length``, ``category``) of files below a folder; the category is the first folder or ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    inner = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace("file://", "").replace(".", r"\."), "")
    out = files.withColumn("category", F.when(F.size(F.split(inner, "/")) > 2, F.split(inner, "/")[1]).otherwise("root"))
    for s in skip:
        out = out.where(~F.contains("path", F.lit(s)))
    return out


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``length``, ``sha256``) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def latest(df: DataFrame, by: list[str], order: Column, *columns: str) -> DataFrame:
    """The row of the greatest order of each group."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*by, "_r.*")


def latest_files(spark: SparkSession, root: str, pattern: str, tag: str) -> DataFrame:
    """(``tag``, ``path``): the last file by name of each tag, the first group of the pattern ``tag`` in the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.regexp_extract(name, tag, 1).alias("tag"), name.alias("name"), "path").groupBy("tag").agg(F.max_by("path", "name").alias("path"))


def log_fields(lines: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """One column for each pattern's first group, null where a line lacks it."""
    return lines.select("*", *(F.nullif(F.regexp_extract(column, p, 1), F.lit("")).alias(k) for k, p in patterns.items()))


def metric_value(lines: DataFrame, column: str, name: str) -> DataFrame:
    """Values of a metric in the text exposition format: ``name{labels} value``."""
    m = rf"^{name}(?:\{{([^}}]*)\}})?\s+([-+0-9.eE]+)\s*$"
    return lines.where(F.col(column).rlike(m)).select(F.regexp_extract(column, m, 1).alias("labels"), F.regexp_extract(column, m, 2).cast("double").alias("value"))


def normalized_chat(raw: Column) -> Column:
    """Messages (role, content) of a chat dump given as JSON: a list, or a map of history; users' and assistants' with content."""
    item = "struct<role:string,content:string>"
    by_list = F.from_json(raw, f"struct<messages:array<{item}>>")["messages"]
    by_map = F.map_values(F.from_json(raw, f"struct<history:struct<messages:map<string,{item}>>>")["history"]["messages"])
    return F.filter(F.coalesce(by_list, by_map, F.array().cast(f"array<{item}>")), lambda m: m["role"].isin("user", "assistant") & (F.trim(m["content"]) != ""))


def carried_forward(df: DataFrame, value: str, by: list[str], order: str, out: str) -> DataFrame:
    """The last non-null value so far, within each group."""
    return running_last(df, value, by, order, out)


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """JSON lines, a folder for each value of ``by``; ``append`` adds to what is there."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def manifest(report: dict[str, DataFrame]) -> str:
    """Markdown tables of small report frames."""
    out = []
    for name, df in report.items():
        rows = df.collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
