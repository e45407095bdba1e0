"""Incremental processing: done-sets, snapshots, progress, and streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running_min


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the output so far."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def latest_snapshot(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key over repeated harvests: the one of the latest version; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*keys, "_r.*")


def best_so_far(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds ``best`` (running minimum) and ``new_best`` (whether this row sets it)."""
    best = running_min(df, value, by, order, "best", "_before")
    return best.withColumn("new_best", F.col("_before").isNull() | (F.col(value) < F.col("_before"))).drop("_before")


def harvest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, fmt: str = "json") -> None:
    """Append new files of a folder to a Parquet table, each file once, and stop when all are read."""
    q = spark.readStream.schema(schema).format(fmt).load(source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts of tumbling windows by key with a watermark, for a stream or a batch (an extension)."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Sessions of a key that end after a gap (an extension)."""
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def terminal_state(status: DataFrame, by: str, order: str, message: str) -> DataFrame:
    """The last state of each run: COMPLETED, CRASH or ALIVE."""
    last = status.groupBy(by).agg(F.max_by(message, order).alias("m"))
    return last.select(by, F.when(F.col("m").rlike("(?i)complet|finish|done"), "COMPLETED").when(F.col("m").rlike("(?i)error|traceback|killed|crash"), "CRASH").otherwise("ALIVE").alias("state"))
