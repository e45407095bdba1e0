"""The queries of the nine training-data problems, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from . import cross_split, encoding, group_splits, leakage, near_dup, oracles, packing, pair_defects, splitting, subjects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("p6_found", oracles.P6)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, sf_dir, "assemble_v5"))


@query("p6_groups", oracles.P6_GROUPS)
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "assemble_v5"))


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.token_ids(table(spark, sf_dir, "documents"))


@query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("p4_found", oracles.P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.cross_split_pairs(table(spark, sf_dir, "assemble_v5"))


@query("p4_report", oracles.P4_REPORT)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assemble_v5")
    return cross_split.overlap_report(rows, cross_split.counterparts(rows), cross_split.coverage(rows))


@query("p1_found", oracles.P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "corpus_builder")).where("piece = 0").select("id")


@query("p1_pieces")
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "corpus_builder"))


@query("p1_whole", oracles.P1_WHOLE)
def p1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized text put together again from its pieces, and whether they keep the limit, the overlap and the row's fields."""
    rows = table(spark, sf_dir, "corpus_builder")
    pieces = cut(p1_pieces(spark, sf_dir))
    fields = pieces.groupBy("id").agg(F.min("heading").alias("heading"), F.max("page_num").alias("page_num"))
    same = rows.select("id", F.col("heading").alias("h"), F.col("page_num").alias("n")).join(fields, "id").select("id", (F.col("h").eqNullSafe(F.col("heading")) & F.col("n").eqNullSafe(F.col("page_num"))).alias("fields_kept"))
    return splitting.rejoined(pieces).join(same, "id").select("id", "chars", "digest", "broken", (F.col("longest") <= splitting.LIMIT).alias("within_limit"), "fields_kept")


@query("p3_found", oracles.P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.related_pairs(table(spark, sf_dir, "assemble_v5"))


@query("p3_groups", oracles.P3_GROUPS)
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of p3_found as membership: each related group id with the least id of its component."""
    return group_splits.related_groups(table(spark, sf_dir, "assemble_v5"))


@query("p3_splits")
def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.assign_splits(table(spark, sf_dir, "assemble_v5"))


@query("p3_balance")
def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assemble_v5")
    return group_splits.split_balance(group_splits.assign_splits(rows), rows)


@query("p3_apart", oracles.P3_APART)
def p3_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splits of p3_splits keep: every row once, no group and no case file in two splits, shares within a point."""
    rows = table(spark, sf_dir, "assemble_v5")
    of = cut(p3_splits(spark, sf_dir))
    joined = cut(rows.select("record_id", group_splits.clean_group(F.col("group_id")).alias("g"), group_splits.case_marks(F.col("instruction")).alias("marks")).join(of, "record_id"))
    apart = lambda d, k: d.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.count(F.lit(1)).alias(k))
    share = dict(group_splits.SHARES)
    near = [F.abs(F.count_if(F.col("split") == k) / F.count(F.lit(1)) - v) <= 0.01 for k, v in share.items()]
    total = of.agg(F.count(F.lit(1)).alias("rows"), (near[0] & near[1] & near[2]).alias("near_shares"))
    groups, marks = apart(joined, "g"), apart(joined.select("split", F.explode("marks").alias("m")), "m")
    return total.join(groups).join(marks).select("rows", "near_shares", F.col("g").alias("groups_apart"), F.col("m").alias("marks_apart"))  # one row each


@query("p8_kept", oracles.P8_KEPT)
def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers of p8_containers keep: every document of tokens once and whole, none above capacity, few containers."""
    lies = cut(p8_containers(spark, sf_dir))
    cap = 2048
    by_doc = lies.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("first").alias("places"))
    docs = by_doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") != F.ceil(F.col("n") / cap)) | (F.col("places") != F.col("pieces"))).alias("cut_needlessly"), F.sum("n").alias("tokens"))
    full = lies.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > cap).alias("overfull"), F.count(F.lit(1)).alias("containers"))
    # a container of room left over at the end, and a fiftieth more than the tokens would fill
    return docs.join(full).select("documents", "cut_needlessly", "overfull", (F.col("containers") <= F.ceil(F.col("tokens") / cap) * 1.02 + 1).alias("few"))


@query("p5_found", oracles.P5)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.rows_of(spark, sf_dir).select("table_name", "row_id", "item_id")


@query("p5_leaks", oracles.P5_LEAKS)
def p5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.rows_of(spark, sf_dir).select("table_name", "row_id", "item_id", *(F.round(c, 6).alias(c) for c in ("question_share", "answer_share")))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.pair_defects(table(spark, sf_dir, "data_build"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, sf_dir, n) for n in ("documents", "subject_areas", "subject_labels")))


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p9_found(spark, sf_dir), table(spark, sf_dir, "documents"))
