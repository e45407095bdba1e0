"""Steps of a build: writing a corpus and its report, quotas, stages that resume, and checking a build afresh."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut
from .ranking import first_rows, numbered


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark knows."""
    fs, at = _path(spark, path)
    return fs.exists(at)


class Stages:
    """Stages of a build in one folder: each writes its table and then a mark; a marked stage is read, not run again.

    A stage that broke off has no mark: what it left is overwritten by the next run.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.ran = spark, folder.rstrip("/"), []

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        table, mark = f"{self.folder}/{name}", f"{self.folder}/{name}.done"
        if not exists(self.spark, mark):
            make().write.mode("overwrite").parquet(table)
            fs, at = _path(self.spark, mark)
            fs.create(at, True).close()
            self.ran.append(name)
        return self.spark.read.parquet(table)


def completed(spark: SparkSession, work: DataFrame, key: str, folder: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds what ``make`` gives for the rows of ``work`` that the folder lacks, and returns all of it.

    Every call appends one committed table, so a call that broke off leaves nothing and
    the next one makes only what is still missing, by key.
    """
    if exists(spark, folder):
        work = work.join(spark.read.parquet(folder).select(key), key, "left_anti")
    make(work).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def first_source(spark: SparkSession, readers: list[tuple[str, Callable[[str], DataFrame]]], otherwise: Callable[[], DataFrame]) -> DataFrame:
    """The first source whose path exists, read by its own reader; else the built-in rows."""
    for path, read in readers:
        if exists(spark, path):
            return read(path)
    return otherwise()


def preferred_source(first: DataFrame, second: DataFrame, least: int = 100) -> DataFrame:
    """The first table if it has at least ``least`` rows, else the second."""
    return first if first.limit(least).count() >= least else second


def response_text(x: Column) -> Column:
    """An answer stored as text or as a JSON object with ``text``."""
    return F.coalesce(F.get_json_object(x, "$.text"), x)


def until_limit(df: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """Rows in order until their sizes reach the limit, the row that crosses it included; every size is at least 1.

    Only the first ``limit`` rows can count, so no more are put in order.
    """
    head = df.orderBy(order).limit(limit)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return head.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") < limit).drop("_before")


def quota_order(quotas: DataFrame, name: str, quota: str) -> DataFrame:
    """(``name``, ``place``): which of several quotas is served next: the one with most left, the greater name on ties."""
    each = quotas.where(F.col(quota) > 0).select(name, F.explode(F.sequence(F.lit(1), F.col(quota))).alias("left"))
    return each.select(name, F.row_number().over(Window.orderBy(F.desc("left"), F.desc(name))).alias("place"))


def rebalanced(df: DataFrame, group: str, caps: dict[str, int], strategies: dict[str, str], text: str, key: str, seed: str = "42") -> DataFrame:
    """At most ``caps`` rows of each group: all of those below their cap, and of those without one.

    ``strategies`` names how a group above its cap is cut: ``longest_first`` (the default)
    or ``random`` (hash order). Ranks are made in 64 parts of a group and cut there first,
    so no task orders a whole group.
    """
    cap = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))[F.col(group)]
    chance = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    random = F.coalesce(F.create_map(*(x for k, v in {**dict.fromkeys(caps, "longest_first"), **strategies}.items() for x in (F.lit(k), F.lit(v == "random"))))[F.col(group)], F.lit(False))
    rows = df.withColumn("_cap", cap).withColumn("_o", F.when(random, F.lit(0)).otherwise(-F.coalesce(F.length(text), F.lit(0)))).withColumn("_h", chance)
    order = [F.col("_o"), F.when(random, F.col("_h")), F.col(key)]
    part = rows.where("_cap is not null").withColumn("_p", F.pmod(F.xxhash64(key), F.lit(64)))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy(*order))).where("_r <= _cap")
    kept = part.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r <= _cap")
    return rows.where("_cap is null").select(*df.columns).unionByName(kept.select(*df.columns))


def term_coverage(df: DataFrame, group: str, terms: Column, key: str, quota: int, seed: str = "42") -> DataFrame:
    """Rows of each group chosen by greedy coverage of a bounded term table, up to ``quota``, then in hash order.

    As long as some row brings terms not yet covered, the one that brings most is taken, the
    first in hash order on ties; afterwards all rows bring nothing and the hash order
    decides. Only the first row of each set of terms can be taken for what it brings, and the
    number of sets is bounded by the term table (read to the driver: at most 2^terms for each group).
    """
    rows = df.select(F.col(group).alias("g"), F.array_sort(terms).alias("t"), F.col(key).alias("k"), F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))).alias("h"))
    first = rows.groupBy("g", "t").agg(F.min(F.struct("h", "k")).alias("m")).select("g", "t", "m.*").collect()
    chosen = []
    for g in sorted({r.g for r in first}, key=lambda x: (x is None, x)):
        pool, covered = [r for r in first if r.g == g], set()
        while pool and len([c for c in chosen if c[0] == g]) < quota:
            best = min(pool, key=lambda r: (-len(set(r.t) - covered), r.h, r.k))
            if not set(best.t) - covered:
                break
            covered |= set(best.t)
            pool.remove(best)
            chosen.append((g, best.k))
    spark = df.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    taken = spark.createDataFrame(chosen, f"`_g` {kind[group]}, `_k` {kind[key]}")
    marked = rows.select("g", "k", "h").join(F.broadcast(taken), F.col("g").eqNullSafe(F.col("_g")) & (F.col("k") == F.col("_k")), "left").select("g", "k", "h", F.col("_k").isNull().cast("int").alias("later"))
    order = [F.col("later"), F.col("h"), F.col("k")]
    part = marked.withColumn("p", F.pmod(F.xxhash64("k"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("g", "p").orderBy(*order))).where(F.col("r") <= quota)
    kept = part.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("r") <= quota)
    return kept.select(F.col("g").alias(group), F.col("k").alias(key))


def coverage_and_lengths(df: DataFrame, group: str, terms: Column, text: str, key: str, caps: dict[str, int], share: float = 0.6, buckets: int = 3, seed: str = "42") -> DataFrame:
    """Groups above their cap cut to it: ``share`` of the places by term coverage, the rest at random over lengths; other groups stay whole.

    What coverage leaves is put into ``buckets`` of equal numbers by length; each gives its
    share of the places in hash order, and what rounding leaves open goes to the next rows in
    hash order. Null groups have no cap.
    """
    cap = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))[F.col("g")]
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.coalesce(F.length(text), F.lit(0)).alias("n"), F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))).alias("h"), terms.alias("t")).withColumn("cap", cap)
    size = rows.where("cap is not null").groupBy("g").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > cap).select("g", "all")
    over = cut(rows.join(F.broadcast(size), "g"))
    chosen = None
    for g, c in sorted(caps.items()):  # a term table and a cap for each of a few named groups
        one = term_coverage(over.where(F.col("g") == g), "g", F.col("t"), "k", int(c * share), seed)
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = cut(chosen)
    pool = numbered(over.join(chosen, ["g", "k"], "left_anti").select("g", "k", "n", "h", "cap"), ["g"], [F.col("n"), F.col("k")], "r")
    left = pool.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    pool = cut(pool.join(F.broadcast(left), "g").withColumn("b", F.least(F.lit(buckets - 1), F.floor((F.col("r") * buckets - 1) / F.col("m")))))
    spare = F.col("cap") - F.floor(F.col("cap") * share)
    part = pool.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"), F.first(F.least(F.col("m"), F.lit(2**62))).alias("m"), F.first(spare).alias("spare"))
    part = part.select("g", "b", F.least(F.col("c"), F.bround(F.col("spare") * F.col("c") / F.col("m")).cast("long")).alias("want"), "spare")
    w = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("g", "b", F.greatest(F.lit(0), F.least("want", F.col("spare") - F.coalesce(F.sum("want").over(w), F.lit(0)))).alias("want"))  # a row for each bucket
    joined = pool.join(F.broadcast(part), ["g", "b"])
    picked = cut(first_rows(joined.select("g", "b", "k", "h", "want"), [F.col("g"), F.col("b")], [F.col("h"), F.col("k")], F.col("want")).select("g", "k"))
    open_ = left.join(part.groupBy("g").agg(F.sum("want").alias("got")), "g").select("g", "got")
    rest = pool.join(picked, ["g", "k"], "left_anti").join(F.broadcast(open_), "g").withColumn("want", spare - F.col("got"))
    more = first_rows(rest.select("g", "k", "h", "want"), [F.col("g")], [F.col("h"), F.col("k")], F.col("want")).select("g", "k")
    kept = chosen.unionByName(picked).unionByName(more)
    whole = df.join(F.broadcast(size.select(F.col("g").alias(group))), group, "left_anti")
    return whole.unionByName(df.join(kept.select(F.col("k").alias(key)), key, "left_semi").select(*df.columns))


def report_json(stages: dict[str, DataFrame]) -> str:
    """Nested JSON of small frames, stage by stage, in order."""
    import json

    return json.dumps({"stages": [{"stage": name, "rows": [r.asDict(recursive=True) for r in df.collect()]} for name, df in stages.items()]}, ensure_ascii=False, default=str)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, first under another name, so that a reader never sees half of it."""
    fs, at = _path(spark, path)
    _, new = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def checks(df: DataFrame, key: str, rules: dict[str, Column], unique: list[str], apart: dict[str, tuple[Column, str]]) -> DataFrame:
    """(``check``, ``violations``) of a finished table, computed anew from its rows.

    ``rules`` must hold on each row, ``unique`` names columns without repeats, ``apart`` gives
    values that must not stand on two sides (value, side column).
    """
    by_row = df.agg(*(F.count_if(~F.coalesce(v, F.lit(False))).alias(k) for k, v in rules.items()))
    out = by_row.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in rules)), F.array(*(F.col(k) for k in rules)))).alias("check", "violations"))
    for c in unique:
        twice = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("violations"))
        out = out.unionByName(twice.select(F.lit(f"{c}_unique").alias("check"), "violations"))
    for name, (value, side) in apart.items():
        sides = df.select(value.alias("v"), side).where(f"v is not null and {side} is not null").groupBy("v").agg(F.min(side).alias("a"), F.max(side).alias("b"))
        out = out.unionByName(sides.agg(F.count_if(F.col("a") != F.col("b")).alias("violations")).select(F.lit(name).alias("check"), "violations"))
    return out
