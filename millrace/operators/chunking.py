"""Corpus chunks of pages, and the parsers of semi-structured text."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..shared import cut


def pack_segments(segments: list[tuple[str, int | None, str | None]], target: int, most: int, least: int, size) -> list[tuple[str, int | None, str | None]]:
    """Segments joined in order until the target size would be exceeded.

    A chunk carries the page and heading of its first segment. Segments longer than
    ``most`` are cut into parts, none dropped; a rest below ``least`` joins the chunk
    before it.
    """
    parts = []
    for text, page, heading in segments:
        text = text.strip()
        while text:
            end = len(text)
            if size(text) > most:
                end = max(1, int(len(text) * most / size(text)))
                mark = max(text.rfind(c, end // 2, end) for c in "。！？.!?\n；;，, ")
                end = mark + 1 if mark > 0 else end
            parts.append((text[:end], page, heading))
            text = text[end:].strip()
    out: list[list] = []
    for text, page, heading in parts:
        if out and size(out[-1][0]) + size(text) <= target:
            out[-1][0] += "\n" + text
        else:
            out.append([text, page, heading])
    if len(out) > 1 and len(out[-1][0]) < least:
        out[-2][0] += "\n" + out.pop()[0]
    return [tuple(x) for x in out]


def chunk_pages(df: DataFrame, doc: str, page: str, heading: str, text: str, target: int = 512, most: int = 1024, least: int = 20) -> DataFrame:
    """(doc, ``chunk``, page, heading, ``chunk_text``, ``tokens``): pages of each document in order, cut at blank lines and packed."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"{doc} {kinds[doc]}, chunk int, page_num int, heading string, chunk_text string, tokens int"
    size = lambda s: len(T._TOKEN.findall(s.lower()))

    def one(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_o", "_t"], na_position="last")
        segments = []
        for p, h, t in zip(pdf["_p"], pdf["_h"], pdf["_t"]):
            for s in re.split(r"\n\s*\n", t or ""):
                if s.strip():
                    segments.append((s, None if pd.isna(p) else int(p), h))
        chunks = pack_segments(segments, target, most, least, size)
        return pd.DataFrame([(names[0], i, p, h, t, size(t)) for i, (t, p, h) in enumerate(chunks)], columns=[doc, "chunk", "page_num", "heading", "chunk_text", "tokens"]).astype({"page_num": "Int32"})

    rows = df.select(doc, F.col(page).alias("_p"), F.coalesce(page, F.lit(2**31 - 1)).alias("_o"), F.col(heading).alias("_h"), F.col(text).alias("_t"))
    return rows.groupBy(doc).applyInPandas(one, schema)


def write_ready(chunks: DataFrame, text: str, order: list[str], prefix: str = "") -> DataFrame:
    """Distinct chunks, first kept, with running ids in the given order.

    Ids come from counts of range partitions, so the rows aren't sorted by one task.
    """
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    first = chunks.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*chunks.columns), F.struct(*order)).alias("r")).select("r.*")
    ranged = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # a written table: the ranges are sampled, and both uses below must see the same ones
    local = cut(ranged.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(counts), "_p").withColumn("id", F.concat(F.lit(prefix), F.lpad((F.col("_i") + F.col("_before")).cast("string"), 8, "0"))).drop("_p", "_i", "_before")


_FENCE, _TABLE, _RULE = re.compile(r"^\s*```"), re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$")


def blocks(text: str | None) -> list[tuple[str, str]]:
    """Typed blocks of Markdown: heading, image, table, list, quote, rule, code, para."""
    out: list[tuple[str, list[str]]] = []
    code = None
    for line in (text or "").split("\n"):
        if code is not None:
            if _FENCE.match(line):
                out.append(("code", code))
                code = None
            else:
                code.append(line)
            continue
        if _FENCE.match(line):
            code = []
            continue
        if not line.strip():
            out.append(("", []))
            continue
        kind = "heading" if re.match(r"#{1,6}\s", line) else "image" if re.match(r"!\[[^\]]*\]\([^)]*\)\s*$", line) else "table" if _TABLE.match(line) else "rule" if _RULE.match(line) else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "quote" if line.lstrip().startswith(">") else "para"
        if out and out[-1][0] == kind and kind in ("table", "list", "quote", "para"):
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    if code is not None:
        out.append(("code", code))
    return [(k, "\n".join(v)) for k, v in out if k]


def markdown_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ``block``, ``kind``, ``body``) of every block of every text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, k, b) for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for n, (k, b) in enumerate(blocks(t))]
            yield pd.DataFrame(rows, columns=[id_col, "block", "kind", "body"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, block int, kind string, body string")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_rows(x: pd.Series) -> pd.Series:
    """Cells of a pipe table, header first, without the ruling line."""

    def one(s: str | None) -> list[list[str]]:
        rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in (s or "").split("\n") if _TABLE.match(line)]
        return [r for r in rows if not all(re.fullmatch(r":?-{2,}:?", c) for c in r)]

    return x.map(one)


def front_matter(x: Column) -> Column:
    """The ``key: value`` lines between two ``---`` lines at the start, as a map; null without them."""
    body = F.regexp_extract(x, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return F.when(body != "", F.transform_values(F.str_to_map(body, F.lit("\r?\n"), F.lit(r":\s*")), lambda k, v: F.trim(v)))


@F.pandas_udf(ArrayType(StringType()))
def literal_list(x: pd.Series) -> pd.Series:
    """Items of a list written as a Python literal; empty if it isn't one."""

    def one(s: str | None) -> list[str]:
        try:
            v = ast.literal_eval(s) if s else []
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        return [str(i) for i in v] if isinstance(v, (list, tuple)) else []

    return x.map(one)


def delimited_pairs(x: Column) -> Column:
    """Array of (n, question, answer) from ``【问题n】...【回答n】...`` blocks."""
    q = r"(?s)【问题(\d+)】(.*?)【回答\1】(.*?)(?=【问题|\z)"
    return F.arrays_zip(F.regexp_extract_all(x, F.lit(q), F.lit(1)).alias("n"), F.transform(F.regexp_extract_all(x, F.lit(q), F.lit(2)), lambda s: F.btrim(s, F.lit(" \t\r\n"))).alias("question"), F.transform(F.regexp_extract_all(x, F.lit(q), F.lit(3)), lambda s: F.btrim(s, F.lit(" \t\r\n"))).alias("answer"))
