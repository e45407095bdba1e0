"""Typed scores of answers against expected keywords, and what judges say of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in(text: Column, word: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(word))


def expected_principles(text: Column, aliases: list[str], ending: str = "原理", general: str = "发明") -> Column:
    """Names that end in ``ending`` (2 to 12 letters before it), first mentions in order.

    General names (with ``general`` in them) don't count; a name that holds a known alias
    becomes the longest such alias.
    """
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[一-鿿A-Za-z]{{2,12}}{ending}"), F.lit(0))
    known = sorted(aliases, key=lambda a: (-len(a), a))
    name = lambda r: F.coalesce(*(F.when(F.contains(r, F.lit(a)), F.lit(a)) for a in known), r)
    return F.array_distinct(F.transform(F.filter(raw, lambda r: ~F.contains(r, F.lit(general))), name))


def matched(text: Column, words: Column, aliases: Column | None = None) -> Column:
    """How many of the words stand in a text, letter case aside; a word also by any of its aliases (a map to arrays)."""
    if aliases is None:
        return F.size(F.filter(words, lambda w: _in(text, w)))
    return F.size(F.filter(words, lambda w: _in(text, w) | F.coalesce(F.exists(aliases[w], lambda a: _in(text, a)), F.lit(False))))


def coverage(text: Column, words: Column, aliases: Column | None = None, none: float | None = None) -> Column:
    """The share of the words that stand in a text; ``none`` without words."""
    return F.when(F.size(words) > 0, matched(text, words, aliases) / F.size(words)).otherwise(F.lit(none))


def typed_score(kind: Column, text: Column, words: Column, usual: Column, steps: Column, step_aliases: Column | None = None) -> Column:
    """Struct (metric, score, correct) by an item's kind.

    principle, contradiction, concept and probe are scored by their own words and have no
    score without any; generation falls back on the usual words; ariz is scored by its
    steps and their aliases. Only a principle can be ``correct``: all its words stand there.
    """
    own = coverage(text, words)
    score = (
        F.when(kind.isin("principle", "contradiction", "concept", "probe"), own)
        .when(kind == "generation", coverage(text, F.when(F.size(words) > 0, words).otherwise(usual), none=0.0))
        .when(kind == "ariz", coverage(text, steps, step_aliases, 0.0))
    )
    return F.struct(F.when(score.isNotNull(), F.concat(kind, F.lit("_coverage"))).alias("metric"), score.alias("score"), F.when((kind == "principle") & own.isNotNull(), (own == 1).cast("int")).alias("correct"))


def judged_coverage(flags: Column, keys: Column, reason: Column) -> Column:
    """The share of the keys a judge marked 1, missing ones counting 0; null if it failed or there are no keys."""
    hit = F.size(F.filter(keys, lambda k: F.coalesce(flags[k] == 1, F.lit(False))))
    return F.when(~F.coalesce(reason == "JUDGE_FAILED", F.lit(False)) & (F.size(keys) > 0), hit / F.size(keys))


def dual_means(df: DataFrame, text: Column, words: Column, aliases: Column, by: list[str]) -> DataFrame:
    """Mean share of keywords met without and with aliases, over rows that have keywords."""
    rows = df.select(*by, coverage(text, words).alias("pre"), coverage(text, words, aliases).alias("post"))
    return rows.where("pre is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("pre").alias("pre"), F.avg("post").alias("post"))


def identification(df: DataFrame, chosen: Column, text: Column, expected: Column, aliases: Column) -> DataFrame:
    """One row (total, correct, accuracy) over the rows that ask for a name: it counts by itself or by any of its aliases."""
    ok = _in(text, expected) | F.coalesce(F.exists(aliases[expected], lambda a: _in(text, a)), F.lit(False))
    r = df.where(chosen).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"))
    return r.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def step_completeness(df: DataFrame, text: Column, steps: Column, aliases: Column, by: list[str]) -> DataFrame:
    """Mean share of the steps an answer names, and the mean number of them."""
    n = matched(text, steps, aliases)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.avg(n / F.size(steps)).alias("completeness"), F.avg(n).alias("matched_steps"))


def judge_lineage(df: DataFrame, judge: str, known: DataFrame, pinned: str, chain: list[str]) -> DataFrame:
    """Adds ``family`` (``unknown`` if not registered) and ``standing``: pinned, in the fallback chain, or outside."""
    at = F.when(F.col(judge) == pinned, "pinned").when(F.col(judge).isin(chain), "chain").otherwise("outside")
    return df.join(F.broadcast(known.select(F.col("model").alias(judge), "family")), judge, "left").withColumn("family", F.coalesce("family", F.lit("unknown"))).withColumn("standing", at)


def weighted_interval(df: DataFrame, stratum: str, key: str, a: str, b: str, weights: dict[str, float], rounds: int = 10_000, seed: int = 42, block: int = 20_000) -> DataFrame:
    """One row (n, diff, low, high): the weighted mean over the strata of b - a, and its bootstrap interval.

    Every stratum is resampled on its own and the means are weighted. A stratum is cut
    into blocks of pairs by a hash of the key; a block draws Poisson weights, and only
    its sums of every round are added up, so no task holds a stratum. Pairs with a null don't count; strata without a
    weight or without pairs take no part.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(stratum).isin(list(weights))).select(F.col(stratum).alias("s"), F.col(key).alias("k"), (F.col(b) - F.col(a)).cast("double").alias("d"))
    blocks = rows.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / block).alias("p"))
    rows = rows.join(F.broadcast(blocks), "s").withColumn("p", F.pmod(F.xxhash64("k"), F.col("p")).cast("int"))
    names = {s: i for i, s in enumerate(sorted(weights))}

    def draw(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["k", "d"])["d"].to_numpy()
        rng = np.random.default_rng([seed, names[group[0]], group[1]])
        total, drawn = np.zeros(rounds), np.zeros(rounds)
        for at in range(0, len(d), 500):
            w = rng.poisson(1.0, (rounds, len(d[at : at + 500])))
            total += w @ d[at : at + 500]
            drawn += w.sum(axis=1)
        return pd.DataFrame({"s": group[0], "r": np.arange(rounds), "total": total, "drawn": drawn})

    sums = rows.groupBy("s", "p").applyInPandas(draw, "s string, r int, total double, drawn double").groupBy("s", "r").agg((F.sum("total") / F.greatest(F.sum("drawn"), F.lit(1.0))).alias("m"))
    weight = F.create_map(*(x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))))
    ends = sums.groupBy("r").agg(F.sum(weight[F.col("s")] * F.col("m")).alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    point = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(weight[F.col("s")] * F.col("m")), F.lit(0.0)).alias("diff"))
    return point.join(ends).select("n", "diff", "low", "high")  # one row each
