"""Scores of answers: keywords and aliases, set measures, n-gram measures, verdicts and agreement."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..functions import stats as S
from ..functions import text as T


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Struct (hits, misses, rate): keywords that stand in the text, letter case aside; rate is null without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.filter(keywords, lambda k: F.contains(low, F.lower(k)))
    miss = F.filter(keywords, lambda k: ~F.contains(low, F.lower(k)))
    return F.struct(hit.alias("hits"), miss.alias("misses"), F.when(F.size(keywords) > 0, F.size(hit) / F.size(keywords)).alias("rate"))


def alias_hits(text: Column, keywords: Column, aliases: Column) -> Column:
    """Struct (rate, used): as above, a keyword also counting by the first of its aliases (a map to arrays) that stands in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = lambda k: F.concat(F.array(k), F.coalesce(F.try_element_at(aliases, k), F.array().cast("array<string>")))
    first = F.transform(keywords, lambda k: F.get(F.filter(own(k), lambda a: F.contains(low, F.lower(a))), F.lit(0)))
    n = F.size(F.filter(first, lambda a: a.isNotNull()))
    return F.struct(F.when(F.size(keywords) > 0, n / F.size(keywords)).alias("rate"), first.alias("used"))


def miss_queue(df: DataFrame, rubric: str, rate: str, least: float = 0.5) -> DataFrame:
    """Rows that the rubric passes and the keywords don't."""
    return df.where((F.col(rubric) >= least) & (F.col(rate) < least))


def set_f1(pred: Column, ref: Column) -> Column:
    """F1 of two sets: null if the reference is empty, 0 if the prediction is."""
    both = F.size(F.array_intersect(F.array_distinct(pred), F.array_distinct(ref)))
    p, r = F.size(F.array_distinct(pred)), F.size(F.array_distinct(ref))
    return F.when(r == 0, None).when(both == 0, 0.0).otherwise(2.0 * both / (p + r))


def numbered_entities(text: Column, word: str, low: int = 1, high: int = 40) -> Column:
    """Distinct numbers in [low, high] that follow a word, ascending."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{word}\s*([0-9]{{1,3}})"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= low) & (x <= high))))


def tagged_terms(text: Column, table: dict[str, list[str]]) -> Column:
    """Names of a term table any of whose synonyms stands in the text, in the order of the table."""
    return F.array_compact(F.array(*(F.when(_any(text, words), F.lit(name)) for name, words in table.items())))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def length_bucket(x: Column, edges: tuple[int, ...] = (200, 600, 1200)) -> Column:
    n, out = F.length(F.coalesce(x, F.lit(""))), None
    for e in edges:
        out = F.when(n < e, f"<{e}") if out is None else out.when(n < e, f"<{e}")
    return out.otherwise(f">={edges[-1]}")


def _ngrams(t: list[str], n: int) -> Counter:
    return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))


@F.pandas_udf(ArrayType(DoubleType()))
def rouge(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """F1 of ROUGE-1, ROUGE-2 and ROUGE-L over tokens; zeros if either is empty."""

    def f1(c: float, p: int, r: int) -> float:
        return 2 * c / (p + r) if p + r and c else 0.0

    def one(a: str | None, b: str | None) -> list[float]:
        x, y = T._TOKEN.findall((a or "").lower()), T._TOKEN.findall((b or "").lower())
        out = [f1(sum((_ngrams(x, n) & _ngrams(y, n)).values()), max(0, len(x) - n + 1), max(0, len(y) - n + 1)) for n in (1, 2)]
        row = [0] * (len(y) + 1)
        for s in x:
            last = 0
            for j, t in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if s == t else max(row[j], row[j - 1])
        return [*out, f1(row[-1], len(x), len(y))]

    return pd.Series([one(a, b) for a, b in zip(pred, ref)])


@F.pandas_udf(ArrayType(LongType()))
def bleu_counts(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """Matches and totals of 1- to 4-grams, and both lengths: the addends of corpus BLEU."""

    def one(a: str | None, b: str | None) -> list[int]:
        x, y = T._TOKEN.findall((a or "").lower()), T._TOKEN.findall((b or "").lower())
        out = []
        for n in range(1, 5):
            out += [sum((_ngrams(x, n) & _ngrams(y, n)).values()), max(0, len(x) - n + 1)]
        return [*out, len(x), len(y)]

    return pd.Series([one(a, b) for a, b in zip(pred, ref)])


def corpus_bleu(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """BLEU-4 of all rows of a group: counts are summed first, so partial sums meet before the shuffle."""
    c = df.select(*by, bleu_counts(F.col(pred), F.col(ref)).alias("c")).groupBy(*by).agg(*(F.sum(F.col("c")[i]).alias(f"_{i}") for i in range(10)))
    logs = sum((F.log(F.col(f"_{2 * n}") / F.col(f"_{2 * n + 1}")) for n in range(4)), F.lit(0.0)) / 4
    brevity = F.when(F.col("_8") >= F.col("_9"), 1.0).otherwise(F.exp(1 - F.col("_9") / F.col("_8")))
    ok = (F.col("_0") > 0) & (F.col("_2") > 0) & (F.col("_4") > 0) & (F.col("_6") > 0)
    return c.select(*by, F.when(ok, brevity * F.exp(logs)).otherwise(0.0).alias("bleu"))


def distinct_n(df: DataFrame, text: str, n: int, by: list[str]) -> DataFrame:
    """Distinct over all character n-grams of a group."""
    g = df.select(*by, F.explode(T.char_ngrams(F.col(text), n)).alias("g")).groupBy(*by, "g").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy(*by).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("total"), (F.count(F.lit(1)) / F.sum("c")).alias("ratio"))


def pass_rates(df: DataFrame, passed: Column, by: list[str]) -> DataFrame:
    """Rows, passes and the Wilson interval of each group; under 30 rows the note is ``descriptive``."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passes"))
    return g.withColumn("ci", S.wilson(F.col("passes"), F.col("n"))).select(*by, "n", "passes", "ci.p", "ci.low", "ci.high", F.when(F.col("n") < 30, "descriptive").otherwise("").alias("note"))


def composite(df: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    """Weighted sum of the metrics' means by group; null if any mean is null."""
    total = None
    for c, w in weights.items():
        part = F.avg(c) * F.lit(w)
        total = part if total is None else total + part
    return df.groupBy(*by).agg(total.alias("composite"))


def confusion(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: how often both, only the first, only the second, neither."""
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def double_order(df: DataFrame, item: str, order: str, verdict: str, void: float = 0.10) -> DataFrame:
    """Verdicts (A, B or tie) of each item in both orders, AB and BA, merged.

    One row: items, wins of the candidate (A in AB, B in BA), Wilson interval over
    the items (not over doubled counts, which would be too narrow), share of B
    verdicts, inconsistent items, and whether these void the comparison.
    """
    score = F.when(F.col(verdict) == "tie", 0.5).when((F.col(verdict) == "A") == (F.col(order) == "AB"), 1.0).otherwise(0.0)
    each = df.groupBy(item).agg(F.count_distinct(order).alias("_o"), F.avg(score).alias("_s"), F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum((F.col(verdict) == "B").cast("int")).alias("_b"), F.count(F.lit(1)).alias("_n")).where("_o = 2")
    g = each.agg(F.count(F.lit(1)).alias("items"), F.sum("_s").alias("wins"), F.count_if(F.col("_lo") != F.col("_hi")).alias("inconsistent"), (F.sum("_b") / F.sum("_n")).alias("b_rate"))
    return g.select("items", "wins", S.wilson(F.col("wins"), F.col("items")).alias("ci"), "b_rate", "inconsistent", (F.col("inconsistent") > void * F.col("items")).alias("void")).select("items", "wins", "ci.*", "b_rate", "inconsistent", "void")


def flip_rate(df: DataFrame, cell: list[str], verdict: str) -> DataFrame:
    """Of each cell of repeats: runs, distinct verdicts and 1 - the share of the most frequent."""
    c = df.groupBy(*cell, verdict).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*cell).agg(F.sum("_c").alias("runs"), F.count(F.lit(1)).alias("verdicts"), (1 - F.max("_c") / F.sum("_c")).alias("flip"))


def perplexity(loss: Column, tokens: Column) -> Column:
    """exp of the token-weighted mean loss."""
    return F.exp(F.sum(loss * tokens) / F.sum(tokens))


def letter_reward(answer: Column, truth: Column) -> Column:
    """1 if the first class letter A-H or Y after an answer mark, else the first standing alone, is the true one."""
    marked = F.regexp_extract(answer, r"(?i)(?:answer|class)\s*[:：is]*\s*\(?([A-HY])\b", 1)
    alone = F.regexp_extract(answer, r"(?<![A-Za-z])([A-HY])(?![A-Za-z])", 1)
    return (F.upper(F.when(marked != "", marked).otherwise(alone)) == truth).cast("double")


def yes_no_reward(answer: Column, truth: Column) -> Column:
    """1 if exactly one of yes and no stands in the answer and it is the true one."""
    low = F.lower(answer)
    yes, no = low.rlike(r"(?<![a-z])yes(?![a-z])"), low.rlike(r"(?<![a-z])no(?![a-z])")
    return ((yes != no) & (yes == (truth == "yes"))).cast("double")


def alert_level(x: Column, warn: float, critical: float) -> Column:
    return F.when(x >= critical, "CRIT").when(x >= warn, "WARN").otherwise("OK")


def verdict(severity: DataFrame, column: str = "severity") -> DataFrame:
    """The gravest of FAIL, FREEZE, SKIP; ``ship`` if none."""
    rank = F.max(F.when(F.col(column) == "FAIL", 3).when(F.col(column) == "FREEZE", 2).when(F.col(column) == "SKIP", 1).otherwise(0))
    return severity.agg(F.element_at(F.array(*(F.lit(v) for v in ("ship", "SKIP", "FREEZE", "FAIL"))), rank + 1).alias("verdict"))


def leaderboard(df: DataFrame, arm: str, item: str, score: str, judge: str, anchor: str, least: int = 100) -> DataFrame:
    """Mean score of each arm by judge over items scored for it, and its difference to the anchor arm; null under ``least`` items."""
    g = df.where(F.col(score).isNotNull()).groupBy(arm, judge).agg(F.count_distinct(item).alias("n"), F.avg(score).alias("_m")).withColumn("mean", F.when(F.col("n") >= least, F.col("_m")))
    base = g.where(F.col(arm) == anchor).select(F.col(judge), F.col("mean").alias("_base"))
    return g.join(base, judge, "left").select(arm, judge, "n", "mean", (F.col("mean") - F.col("_base")).alias("vs_anchor"))


def ranks_of_length(df: DataFrame, by: str, order: list[Column], buckets: int, out: str = "bucket") -> DataFrame:
    """Equal-frequency buckets: slice k holds ranks k m // L to (k + 1) m // L of a group of m rows."""
    w = Window.partitionBy(by)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_m", F.count(F.lit(1)).over(w))
    # the slice of rank r - 1 is the largest k with k m // L <= r - 1
    return r.withColumn(out, F.floor((F.col("_r") * buckets - 1) / F.col("_m")).cast("int")).drop("_r", "_m")
