"""Query shapes over the star schema: what the engine's joins and aggregations do on relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table


def _n():
    """Rows of a group; made when a query runs, as columns need a session."""
    return F.count(F.lit(1))


_REV = "CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))"


def _revenue():
    return F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))


@query("h01_line_summary", f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS quantity, round(sum({_REV}), 2) AS revenue FROM lineitem GROUP BY ALL")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_n().alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"), F.round(F.sum(_revenue()), 2).alias("revenue"))


@query("h02_revenue_by_nation", f"SELECT n_name, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def _(s, d):
    l, o = table(s, d, "lineitem"), table(s, d, "orders")
    c, n = table(s, d, "customer"), table(s, d, "nation")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@query("h03_customers_without_orders", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY 1")
def _(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_nationkey").agg(_n().alias("n"))


@query("h04_top_orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey")


@query("h05_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(_n().alias("n"))
