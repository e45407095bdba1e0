"""Problem 3: splits that keep related records together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..shared import cut

#: The wanted shares, first to last.
SHARES = (("train", 0.85), ("validation", 0.10), ("test", 0.05))
#: Full-width letters and digits and their plain forms (fixed values).
_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
#: What may stand between letters and digits or among the digits, any number of it: white
#: space, signs of punctuation, symbols and invisible signs, by Unicode category.
_SEPARATOR = r"[\s\p{Z}\p{P}\p{S}\p{Cf}]*+"
#: Two Latin letters, no Latin letter before them, and exactly eight digits.
MARK = rf"(?<!\p{{IsLatin}})[a-z]{{2}}{_SEPARATOR}[0-9](?:{_SEPARATOR}[0-9]){{7}}(?![0-9])"
#: Units of one task of the parallel part, and the share of all rows above which a unit is placed first.
BUCKET, LARGE = 20_000, 1e-3


def case_marks(text: Column) -> Column:
    """Distinct case-file marks of a text: two letters and eight digits, plain and lower case."""
    plain = F.lower(F.translate(text, _WIDE, _PLAIN))
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(MARK), F.lit(0)), lambda m: F.regexp_replace(m, "[^a-z0-9]", "")))


def clean_group(group: Column) -> Column:
    """A group id without outer white space, in lower case; null if nothing is left."""
    g = F.lower(F.regexp_replace(group, r"(?U)^\s+|\s+$", ""))
    return F.when(g != "", g)


def _edges(rows: DataFrame) -> DataFrame:
    """(entity, mark) of the marks that several entities name; the bipartite graph without its leaves."""
    pairs = cut(rows.select("entity", F.explode("marks").alias("mark")).where("entity is not null").distinct())  # used twice
    shared = pairs.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    return pairs.join(shared, "mark")


def related_groups(df: DataFrame, group_col: str = "group_id", text_col: str = "instruction") -> DataFrame:
    """(``group_id``, ``component``) of every group id that is related to another one.

    Ids are compared trimmed and in lower case. Rows without an id relate nothing; an
    id that shares no mark with another has no row; an empty table gives none.
    """
    rows = df.select(clean_group(df[group_col]).alias("g"), case_marks(df[text_col]).alias("marks")).where("g is not null and size(marks) > 0")
    edges = _edges(rows.select(F.concat(F.lit("g:"), "g").alias("entity"), "marks"))
    label = components(edges.select(F.col("entity").alias("x"), F.concat(F.lit("m:"), "mark").alias("y")))
    return label.where("node like 'g:%'").select(F.expr("substring(node, 3)").alias("group_id"), F.expr("substring(label, 3)").alias("component"))


def related_pairs(df: DataFrame, group_col: str = "group_id", text_col: str = "instruction") -> DataFrame:
    """(``group_id_a`` < ``group_id_b``): all pairs of ids of one component."""
    c = cut(related_groups(df, group_col, text_col))
    return c.select(F.col("group_id").alias("group_id_a"), "component").join(c.select(F.col("group_id").alias("group_id_b"), "component"), "component").where("group_id_a < group_id_b").select("group_id_a", "group_id_b")


def _place(size: dict, room: dict, names: list[str]) -> str:
    """The split that lacks most of what a unit brings; room changes by it."""
    best = max(names, key=lambda s: sum(n * room[s].get(k, 0.0) for k, n in size.items()))
    for k, n in size.items():
        room[best][k] = room[best].get(k, 0.0) - n
    return best


def assign_splits(df: DataFrame, id_col: str = "record_id", group_col: str = "group_id", text_col: str = "instruction", label_col: str = "subset", shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """(``record_id``, ``unit``, ``split``): every row's split, near the shares in all and within each label.

    A unit is a set of related rows: those of one group id and of all groups and rows
    linked to it through named case files. Units above a thousandth of all rows (at
    most a thousand of them) are placed one by one, largest first, each into the
    split that lacks most of its labels. The others are placed so in parallel, in
    hashed buckets, against the bucket's part of what is left. Rows without a group
    and a shared mark are units of their own; a null label is a label; rows of one
    id get one row each; labels must be few (they are held on the driver).
    """
    rows = df.select(df[id_col].alias("id"), clean_group(df[group_col]).alias("g"), case_marks(df[text_col]).alias("marks"), F.coalesce(df[label_col].cast("string"), F.lit("\0")).alias("label"))
    own = F.coalesce(F.concat(F.lit("g:"), "g"), F.concat(F.lit("r:"), F.col("id").cast("string"), F.lit(":"), F.xxhash64("marks").cast("string")))
    rows = cut(rows.select("id", own.alias("entity"), F.coalesce("marks", F.array().cast("array<string>")).alias("marks"), "label"))
    edges = _edges(rows)
    unit_of = components(edges.select(F.col("entity").alias("x"), F.concat(F.lit("m:"), "mark").alias("y"))).select(F.col("node").alias("entity"), F.col("label").alias("unit"))
    rows = cut(rows.select("id", "entity", "label").join(unit_of, "entity", "left").select("id", F.coalesce("unit", "entity").alias("unit"), "label"))
    sizes = rows.groupBy("unit", "label").count()
    units = cut(sizes.groupBy("unit").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", F.col("count").cast("double")))).alias("size")))
    names = [s for s, _ in shares]
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    count, all_rows = units.count(), sum(totals.values())
    room = {s: {k: p * n for k, n in totals.items()} for s, p in shares}
    edge = max(1.0, all_rows * LARGE)
    head = sorted(units.where(F.col("n") > edge).select("unit", "size", "n").collect(), key=lambda r: (-r.n, r.unit))  # fewer than 1 / LARGE rows
    placed = [(r.unit, _place(dict(r.size), room, names)) for r in head]
    left = {s: {k: max(0.0, v) for k, v in room[s].items()} for s in names}
    whole = {k: sum(left[s][k] for s in names) or 1.0 for k in totals}
    part = {s: {k: left[s][k] / whole[k] for k in totals} for s in names}

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "unit"], ascending=[False, True])
        maps = [dict(m) for m in pdf["size"]]
        total: dict = {}
        for m in maps:
            for k, n in m.items():
                total[k] = total.get(k, 0.0) + n
        own = {s: {k: part[s][k] * n for k, n in total.items()} for s in names}
        return pd.DataFrame({"unit": pdf["unit"].values, "split": [_place(m, own, names) for m in maps]})

    tail = units.where(F.col("n") <= edge).withColumn("b", F.pmod(F.xxhash64("unit"), F.lit(-(-count // BUCKET) or 1)))
    split = tail.select("b", "unit", "n", "size").groupBy("b").applyInPandas(lambda pdf: bucket(pdf), "unit string, split string")
    if placed:
        split = split.unionByName(df.sparkSession.createDataFrame(placed, "unit string, split string"))
    return rows.join(split, "unit").select(F.col("id").alias("record_id"), "unit", "split")


def split_balance(assigned: DataFrame, df: DataFrame, id_col: str = "record_id", label_col: str = "subset") -> DataFrame:
    """Rows and share of each split within each label and in all (label ``*``)."""
    rows = assigned.join(df.select(df[id_col].alias("record_id"), df[label_col].alias("label")), "record_id")
    n = rows.select("split", F.explode(F.array(F.coalesce("label", F.lit("(null)")), F.lit("*"))).alias("label")).groupBy("label", "split").count()
    return n.join(n.groupBy("label").agg(F.sum("count").alias("total")), "label").select("label", "split", F.col("count").alias("rows"), (F.col("count") / F.col("total")).alias("share"))
