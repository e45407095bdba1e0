"""Connected components by iterative minimum-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def _state(e: DataFrame) -> tuple:
    """A fingerprint of the edge set, from one aggregation."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, label): the least node of each connected component, for every node of an edge.

    Each round links the larger neighbours of every node to the least node around it,
    then the smaller ones (large star, small star), so labels travel along shortcuts
    and a chain of k nodes takes about log k rounds. A node of very many neighbours is
    only aggregated by a minimum, with partial sums before the shuffle, never
    gathered. Each round's edges are a table in the shared folder. Null ends, loops and
    repeated edges don't count.
    """
    e = cut(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(f"{x} is not null and {y} is not null and u <> v").distinct())
    before = _state(e)
    while before[0]:
        least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        large = e.join(least, e.v == F.col("c"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), instead=e)
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
