"""Ranks and running values within groups of any size: range partitions and sums of the partitions before, never a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``_g`` (the group, null being one) and ``_p`` (its range partition); written, as ranges are sampled and must not change."""
    g = F.to_json(F.struct(*(F.col(c) for c in by))) if by else F.lit("")
    return cut(df.withColumn("_g", g).repartitionByRange("_g", *order).withColumn("_p", F.spark_partition_id()))


def _before(parts: DataFrame, value: Column, out: str) -> DataFrame:
    return parts.select("_g", "_p", value.over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias(out))


def prefix_sums(df: DataFrame, by: list[str], order: list[Column], value: Column | None = None, out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` (1 for each row if not given) over the rows before this one in its group.

    The order must have no ties. Nulls of ``by`` are one group.
    """
    t = _ranged(df.withColumn("_v", F.lit(1) if value is None else value), by, order)
    local = F.coalesce(F.sum("_v").over(Window.partitionBy("_g", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = _before(t.groupBy("_g", "_p").agg(F.sum("_v").alias("_s")), F.sum("_s"), "_b")
    return t.withColumn(out, local).join(sums, ["_g", "_p"]).withColumn(out, F.col(out) + F.coalesce("_b", F.lit(0))).drop("_g", "_p", "_v", "_b")


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str = "k") -> DataFrame:
    """Adds ``out``: the row's number in its group, from 1."""
    return prefix_sums(df, by, order, None, out).withColumn(out, F.col(out) + 1)


def first_rows(df: DataFrame, by: list[Column], order: list[Column], most: int | Column, parts: int = 64) -> DataFrame:
    """The first ``most`` rows of each group: first of each of ``parts`` hash parts, then of what they leave."""
    keep = F.lit(most) if isinstance(most, int) else most
    names = [f"_b{i}" for i in range(len(by))]
    rows = df.select("*", *(c.alias(n) for c, n in zip(by, names)), keep.alias("_most"), F.pmod(F.xxhash64(*df.columns), F.lit(parts)).alias("_part"))
    for keys in ([*names, "_part"], names):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r <= _most")
    return rows.select(*df.columns)


def average_ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean, from the counts of the distinct values; values must not be null."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = prefix_sums(counts, by, [F.col(value)], F.col("_c"), "_before").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(value).alias("_value"), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))
    on = df[value] == ranks["_value"]
    for i, c in enumerate(by):
        on = on & df[c].eqNullSafe(ranks[f"_k{i}"])
    return df.join(ranks, on).select(*(df[c] for c in df.columns), out)


def running_last(df: DataFrame, value: str, by: list[str], order: str, out: str) -> DataFrame:
    """Adds ``out``: the last non-null value so far in the group, this row's included."""
    t = _ranged(df, by, [F.col(order)])
    local = F.last(value, ignorenulls=True).over(Window.partitionBy("_g", "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = t.groupBy("_g", "_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_e"))
    before = _before(ends, F.last("_e", ignorenulls=True), "_b")
    return t.withColumn(out, local).join(before, ["_g", "_p"]).withColumn(out, F.coalesce(out, "_b")).drop("_g", "_p", "_b")


def running_min(df: DataFrame, value: str, by: list[str], order: str, out: str, previous: str) -> DataFrame:
    """Adds ``out`` (least value so far) and ``previous`` (least value before this row; null for the first)."""
    t = _ranged(df, by, [F.col(order)])
    w = Window.partitionBy("_g", "_p").orderBy(order)
    before = _before(t.groupBy("_g", "_p").agg(F.min(value).alias("_e")), F.min("_e"), "_b")
    t = t.withColumn(previous, F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))).join(before, ["_g", "_p"])
    return t.withColumn(previous, F.least(previous, "_b")).withColumn(out, F.least(previous, value)).drop("_g", "_p", "_b")
