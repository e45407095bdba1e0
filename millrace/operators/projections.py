"""Row-wise rewrites that give more, fewer or other columns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unwrapped(x: pd.Series) -> pd.Series:
    """The text inside nested objects under answer, output, response or result, given as JSON or a Python literal; other text as it is."""

    def one(s: str | None, depth: int = 5) -> str | None:
        if s is None or depth == 0 or not s.lstrip().startswith("{"):
            return s
        for parse in (json.loads, ast.literal_eval):
            try:
                v = parse(s)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            if isinstance(v, dict):
                for k in ("answer", "output", "response", "result"):
                    if k in v:
                        return one(v[k] if isinstance(v[k], str) else json.dumps(v[k], ensure_ascii=False), depth - 1)
        return s

    return x.map(one)


def parsed_records(x: Column, item: str) -> Column:
    """Records of a response that is a JSON array, an object around one (under any of ``items``, ``data``, ``samples``), or JSON lines."""
    kind = f"array<struct<{item}>>"
    array = F.from_json(F.nullif(F.regexp_extract(x, r"(?s)(\[.*\])", 1), F.lit("")), kind)
    wrapped = F.coalesce(*(F.from_json(x, f"struct<{k}:{kind}>")[k] for k in ("items", "data", "samples")))
    lines = F.transform(F.filter(F.split(x, "\n"), lambda s: F.trim(s).startswith("{")), lambda s: F.from_json(s, f"struct<{item}>"))
    return F.coalesce(wrapped, array, F.when(F.size(lines) > 0, lines), F.array().cast(kind))


def without_bad_calls(x: Column) -> Column:
    """Tool calls (JSON array of id, name, arguments) without those whose arguments aren't valid JSON."""
    calls = F.from_json(x, "array<struct<id:string,name:string,arguments:string>>")
    return F.to_json(F.filter(calls, lambda c: F.try_parse_json(c["arguments"]).isNotNull()))


def valid_chat(x: Column, tags: tuple[str, ...] = ("<|im_start|>system", "<|im_start|>user", "<|im_start|>assistant", "<|im_end|>")) -> Column:
    out = F.lit(True)
    for t in tags:
        out = out & F.contains(x, F.lit(t))
    return F.coalesce(out, F.lit(False))


def variants(df: DataFrame, column: str, openings: list[str], copies: int) -> DataFrame:
    """Every row and ``copies`` more whose text opens in turn with one of the openings; adds ``variant``."""
    each = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    opening = F.element_at(F.array(*(F.lit(o) for o in openings)), (F.col("variant") - 1) % len(openings) + 1)
    return each.withColumn(column, F.when(F.col("variant") == 0, F.col(column)).otherwise(F.concat(opening, F.col(column))))


def metric_deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta, delta_pct) of metrics of either side; a missing side counts 0, and so does a change from 0."""
    j = before.select(key, F.col(value).alias("b")).join(after.select(key, F.col(value).alias("a")), key, "full_outer").select(key, F.coalesce("b", F.lit(0.0)).alias("before"), F.coalesce("a", F.lit(0.0)).alias("after"))
    d = F.col("after") - F.col("before")
    return j.select(key, "before", "after", d.alias("delta"), F.when(F.col("before") == 0, 0.0).otherwise(d / F.col("before") * 100).alias("delta_pct"))


def preferred(*columns: str) -> Column:
    """The first metric that is there."""
    return F.coalesce(*columns)


def nested_number(x: Column, depth: int = 3) -> Column:
    """The number of a JSON scalar, or of objects with ``after`` or, without it, ``value``, nested up to ``depth``; null for any other."""
    out, at = x.try_cast("double"), x
    for _ in range(depth):
        at = F.coalesce(F.get_json_object(at, "$.after"), F.get_json_object(at, "$.value"))
        out = F.coalesce(out, at.try_cast("double"))
    return out


def candidate_view(order: Column, verdict: Column, candidate: str = "B") -> Column:
    """A position verdict as the candidate's win, loss or tie: in order AB the candidate stands at B."""
    at = F.when(order == "AB", candidate).otherwise("A" if candidate == "B" else "B")
    return F.when(verdict == "tie", "tie").when(verdict == at, "win").otherwise("loss")


def tag_of(name: Column) -> Column:
    """The tag in ``eval_v4_<tag>_<date>_<time>.json``; empty if the name is another."""
    return F.regexp_extract(name, r"^eval_v\d+_(.+)_\d{8}_\d{6}\.json$", 1)


def assistant_chars(x: Column) -> Column:
    """Length of the assistant's part of a chat text."""
    return F.length(F.regexp_replace(F.substring_index(x, "<|im_start|>assistant\n", -1), r"<\|im_end\|>\s*$", ""))


def appended_examples(df: DataFrame, key: str, column: str, examples: DataFrame) -> DataFrame:
    """The text with its key's example below, where there is one."""
    e = examples.select(F.col("key").alias(key), F.col("example").alias("_e"))
    return df.join(e, key, "left").withColumn(column, F.when(F.col("_e").isNull(), F.col(column)).otherwise(F.concat(F.col(column), F.lit("\n"), F.col("_e")))).drop("_e")


def diverse(df: DataFrame, column: str, order: str, ratios: DataFrame, least_1: float = 0.30, least_2: float = 0.15, prefix: int = 30) -> DataFrame:
    """The table itself if its Distinct-1 and -2 (one row: ``d1``, ``d2``) are high enough, else the first row of each 30-character opening."""
    w = Window.partitionBy(F.substring(column, 1, prefix)).orderBy(order)
    low = F.broadcast(ratios.select(((F.col("d1") < least_1) | (F.col("d2") < least_2)).alias("_low")))
    return df.withColumn("_k", F.row_number().over(w)).join(low).where(~F.col("_low") | (F.col("_k") == 1)).drop("_k", "_low")
