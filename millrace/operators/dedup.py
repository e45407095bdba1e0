"""Deduplication, decontamination, grouping, splitting and sampling of the reference's own kinds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..shared import cut
from .ranking import numbered

#: Grams of reference items that one broadcast may hold; more are searched in blocks.
REFERENCE = 4_000_000
#: Rows of one gram or one class that a task pairs; more are cut into parts.
HOT = 20_000


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key. A minimum over (order, row) replaces a window sort, so a hot key is combined before the shuffle."""
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def keep_longest(df: DataFrame, key: Column, text: str, order: list[Column]) -> DataFrame:
    """The row with the longest text of each key, the first of ties."""
    return keep_first(df, key, [-F.coalesce(F.length(text), F.lit(0)), *order])


def exact_with_conflicts(df: DataFrame, key: Column, answer: Column, order: list[Column]) -> DataFrame:
    """One row of each key whose answers all agree; keys with different answers, and the empty key, go altogether."""
    g = df.withColumn("_a", answer).groupBy(key.alias("_key")).agg(F.count_distinct(F.coalesce("_a", F.lit(""))).alias("_n"), F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return g.where((F.col("_n") == 1) & (F.col("_key") != "")).select("_row.*")


def conflict_report(df: DataFrame, key: Column, answer: Column) -> DataFrame:
    """(key, rows, answers) of keys with more than one answer."""
    g = df.withColumn("_a", answer).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_a").alias("answers"))
    return g.where("answers > 1 and key <> ''")


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float, side: Column | None = None) -> DataFrame:
    """(``id_a`` < ``id_b``, ``j``): all pairs of different rows whose sets of token grams have Jaccard >= threshold.

    With ``side`` (0, 1 or null) only pairs of both sides are wanted, and rows of a null side take no part.

    Prefix join: grams are ordered by frequency; a pair shares one of each side's
    rarest n - ceil(t n) + 1 grams, at places from which the needed overlap is still
    in reach. Equal sets are joined as one class and come back by membership. Grams and
    classes of more than ``HOT`` rows are cut into parts by hash, and each pair of parts is
    a join key of its own.
    """
    one = F.lit(0) if side is None else side
    rows = cut(df.select(F.col(id_col).alias("id"), one.alias("side"), T.token_grams(F.col(text_col)).alias("g")).where("size(g) > 0 and side is not null").withColumn("cls", F.xxhash64("g")))
    classes = rows.groupBy("cls", "side").agg(F.first("g").alias("g")).withColumn("n", F.size("g"))
    posting = classes.select("cls", "side", "n", F.explode("g").alias("gram"))
    df_ = posting.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = posting.join(df_, "gram", "left").groupBy("cls", "side", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "gram"))).alias("p"))
    size = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    prefix = ranked.select("cls", "side", "n", F.posexplode(F.slice("p", F.lit(1), size.cast("int"))).alias("pos", "e")).where("e.df > 1")
    prefix = cut(_in_parts(prefix.select("cls", "side", "n", "pos", F.col("e.gram").alias("gram"), F.col("e.df").alias("df")), "cls", "df"))
    a, b = (prefix.select("gram", "lo", "hi", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "side", "n", "pos", "own"))) for s in "ab")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    apart = (F.col("lo") == F.col("hi")) | (F.col("own_a") != F.col("own_b"))
    met = F.col("cls_a") < F.col("cls_b") if side is None else (F.col("side_a") == 0) & (F.col("side_b") == 1) & (F.col("cls_a") != F.col("cls_b"))
    cand = a.join(b, ["gram", "lo", "hi"]).where(apart & met & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need)).select("cls_a", "cls_b").distinct()
    sets = classes.groupBy("cls").agg(F.first("g").alias("g"))
    full = cand.join(sets.select(F.col("cls").alias("cls_a"), F.col("g").alias("ga")), "cls_a").join(sets.select(F.col("cls").alias("cls_b"), F.col("g").alias("gb")), "cls_b")
    pairs = full.select("cls_a", "cls_b", T.jaccard(F.col("ga"), F.col("gb")).alias("j")).where(F.col("j") >= threshold)
    ids = rows.select("cls", "side", "id")
    x, y = (ids if side is None else ids.where(f"side = {k}") for k in (0, 1))
    between = pairs.join(x.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), "cls_a").join(y.select(F.col("cls").alias("cls_b"), F.col("id").alias("y")), "cls_b").select("x", "y", "j")
    copies = _in_parts(ids.join(ids.groupBy("cls").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "cls"), "id", "df")
    x, y = (copies if side is None else copies.where(f"side = {k}") for k in (0, 1))
    apart = (F.col("lo") == F.col("hi")) | (F.col("own_x") != F.col("own_y"))
    within = x.select("cls", "lo", "hi", F.col("id").alias("x"), F.col("own").alias("own_x")).join(y.select("cls", "lo", "hi", F.col("id").alias("y"), F.col("own").alias("own_y")), ["cls", "lo", "hi"]).where(apart)
    within = (within.where("x < y") if side is None else within).select("x", "y", F.lit(1.0).alias("j"))
    return between.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "j")


def _in_parts(df: DataFrame, key: str, count: str) -> DataFrame:
    """Adds ``own``, ``lo`` and ``hi``: rows of a group of ``count`` in parts by a hash of the key, once for each pair of parts that holds theirs."""
    parts = F.ceil(F.col(count) / HOT).cast("int")
    rows = df.withColumn("own", F.pmod(F.xxhash64(key), parts.cast("long")).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("lo", F.least("own", "_q")).withColumn("hi", F.greatest("own", "_q")).drop("_q", count)


def greedy_keep(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(``id``, ``kept``): in order of id, a row goes only if it matches an earlier row that was kept.

    Rounds settle all rows whose earlier matches are settled: one with a kept match
    goes, one whose matches all went stays. The number of rounds is the longest
    chain of earlier matches, a handful for near-copies.
    """
    state = cut(ids.select("id").join(pairs.select(F.col("id_b").alias("id")).distinct().withColumn("_m", F.lit(True)), "id", "left").select("id", F.when(F.col("_m").isNull(), F.lit(True)).alias("kept")))
    pairs = cut(pairs.select("id_a", "id_b"))
    while True:
        open_ = state.where("kept is null").select(F.col("id").alias("id_b"))
        if not open_.limit(1).count():
            return state
        earlier = pairs.join(open_, "id_b").join(state.select(F.col("id").alias("id_a"), F.col("kept").alias("k")), "id_a")
        settled = earlier.groupBy("id_b").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("hit"), F.bool_or(F.col("k").isNull()).alias("waits"))
        now = settled.select(F.col("id_b").alias("id"), F.when(F.col("hit"), False).when(~F.col("waits"), True).alias("new"))
        state = cut(state.join(now, "id", "left").select("id", F.coalesce("kept", "new").alias("kept")), instead=state)


class _References:
    """Inverted index of the gram sets of some reference texts, as plain arrays."""

    def __init__(self, names: list, sets: list[np.ndarray]):
        self.names, self.size = names, np.array([len(g) for g in sets], np.int64)
        gram = np.concatenate([np.zeros(0, np.int64), *sets])
        of = np.repeat(np.arange(len(sets)), self.size)
        by = np.argsort(gram, kind="stable")
        self.post = of[by]
        self.gram, self.first = np.unique(gram[by], return_index=True)
        self.first = np.append(self.first, len(gram))

    def nearest(self, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the largest Jaccard index and the first reference that has it; 0 and -1 if none shares a gram."""
        m = len(at) - 1
        j, ref = np.zeros(m), np.full(m, -1)
        if not len(self.gram) or not len(g):
            return j, ref
        row = np.repeat(np.arange(m), np.diff(at))
        place = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        hit = self.gram[place] == g
        row, place = row[hit], place[hit]
        many = self.first[place + 1] - self.first[place]
        x = np.repeat(row, many)
        y = self.post[np.repeat(self.first[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        key, common = np.unique(x * len(self.names) + y, return_counts=True)
        x, y = key // len(self.names), key % len(self.names)
        own = common / (np.diff(at)[x] + self.size[y] - common)
        by = np.lexsort((y, -own, x))
        by = by[np.concatenate([np.ones(min(1, len(by)), bool), x[by][1:] != x[by][:-1]])]
        j[x[by]], ref[x[by]] = own[by], y[by]
        return j, ref


def max_similarity(df: DataFrame, reference: DataFrame, id_col: str, text_col: str, ref_id: str, ref_text: str, grams: str = "token") -> DataFrame:
    """(``id``, ``j``, ``ref``): the largest Jaccard index against any reference text and the least id that has it.

    Each distinct text is compared once, against an inverted index of the reference's
    grams. References are broadcast in blocks of a bounded number of grams; a reference
    that alone exceeds it is a block of its own. Rows without grams, or that share none,
    have j = 0 and no ref.
    """
    f, sets = (T.token_grams, K.token_gram_sets) if grams == "token" else (T.char_grams, K.char_gram_sets)
    ready = (lambda t: t.lower()) if grams == "token" else T.bare
    ref = reference.where(F.col(ref_text).isNotNull()).select(F.col(ref_id).alias("r"), f(F.col(ref_text)).alias("g"))
    total = ref.agg(F.coalesce(F.sum(F.size("g")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // REFERENCE))
    texts = df.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    kind = reference.schema[ref_id].dataType.simpleString()
    best = None
    for b in range(blocks):
        part = (ref if blocks == 1 else ref.where(F.pmod(F.xxhash64("r"), F.lit(blocks)) == b)).orderBy("r").collect()  # about REFERENCE grams
        shared = df.sparkSession.sparkContext.broadcast(_References([r.r for r in part], [np.array(r.g, np.int64) for r in part]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 500):
                    own = pdf["text"].iloc[at : at + 500]
                    j, of = shared.value.nearest(*sets([ready(t) for t in own]))
                    yield pd.DataFrame({"text": own, "j": j, "ref": [None if k < 0 else shared.value.names[k] for k in of]})

        one = texts.mapInPandas(run, f"text string, j double, ref {kind}")
        best = one if best is None else best.unionByName(one)
    if blocks > 1:
        best = best.groupBy("text").agg(F.max("j").alias("j"), F.min_by("ref", F.struct(-F.col("j"), "ref")).alias("ref"))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(best, "text", "left").select("id", F.coalesce("j", F.lit(0.0)).alias("j"), "ref")


def decontamination(a: DataFrame, b: DataFrame, drop: float = 0.5, review: float = 0.4) -> DataFrame:
    """(``id``, ``ja``, ``jb``, ``status``) from similarities against two reference sets: ``drop``, ``review`` or ``keep``."""
    both = a.select("id", F.col("j").alias("ja")).join(b.select("id", F.col("j").alias("jb")), "id")
    hi, mid = (lambda t: (F.col("ja") >= t) | (F.col("jb") >= t)), review
    return both.withColumn("status", F.when(hi(drop), "drop").when(hi(mid), "review").otherwise("keep"))


def hash_order(seed: str, *key: Column) -> Column:
    """A repeatable shuffle: the MD5 of a seed and the key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in key)))


def _hash_ranks(df: DataFrame, key: Column, seed: str) -> DataFrame:
    """Adds ``_rank`` (from 1, in hash order) and ``_n`` (all rows).

    Ranks are made in 256 hash parts and shifted by the counts of the parts before,
    so no task orders all rows.
    """
    h = df.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    count = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = count.select("_b", (F.sum("_c").over(w) - F.col("_c")).alias("_before"))
    total = count.agg(F.sum("_c").alias("_n"))
    r = h.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(F.broadcast(before), "_b").join(F.broadcast(total))
    return r.withColumn("_rank", F.col("_r") + F.col("_before")).drop("_h", "_b", "_r", "_before")


def ratio_split(df: DataFrame, key: Column, seed: str, train: float, validation: float) -> DataFrame:
    """Adds ``split``: the first floor(train n) rows of a shuffle, then floor(validation n), the rest test."""
    r, rank = _hash_ranks(df, key, seed), F.col("_rank")
    at = F.floor(F.col("_n") * F.lit(train))
    split = F.when(rank <= at, "train").when(rank <= at + F.floor(F.col("_n") * F.lit(validation)), "validation").otherwise("test")
    return r.withColumn("split", split).drop("_rank", "_n")


def share_sample(df: DataFrame, key: Column, seed: str, ratio: float) -> DataFrame:
    """round(ratio n) rows in hash order."""
    return _hash_ranks(df, key, seed).where(F.col("_rank") <= F.floor(F.col("_n") * F.lit(ratio) + 0.5)).drop("_rank", "_n")


def stratified_sample(df: DataFrame, stratum: str, key: Column, seed: str, ratio: float, least: int = 0) -> DataFrame:
    """round(ratio n) rows of each stratum, at least ``least``, in hash order."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(df.withColumn("_h", hash_order(seed, key)), [stratum], [F.col("_h"), key], "_r")
    same = ranked[stratum].eqNullSafe(n[stratum])
    take = F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(ratio) + 0.5))
    return ranked.join(n, same).where(F.col("_r") <= take).select(*(ranked[c] for c in df.columns))


def hash_sample(df: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """The first n rows in hash order (a top-k, never a full sort)."""
    return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def majority(df: DataFrame, by: list[str], value: str, out: str = "majority", tie: str | None = None) -> DataFrame:
    """The most frequent value of each group; ties go to the least value, or to ``tie`` if given. Nulls don't vote."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    g = c.groupBy(*by).agg(F.max(F.struct(F.col("_n"))).alias("_m"), F.collect_list(F.struct("_n", F.col(value).alias("v"))).alias("_l"))
    best = F.array_sort(F.transform(F.filter("_l", lambda e: e["_n"] == F.col("_m")["_n"]), lambda e: e["v"]))
    pick = best[0] if tie is None else F.when(F.size(best) > 1, F.lit(tie)).otherwise(best[0])
    return g.select(*by, pick.alias(out))


def deficit_split(pdf: pd.DataFrame, shares: tuple[float, float], order: str, size: str) -> pd.DataFrame:
    """Groups in order, each to the side (train or validation) that lacks more, train on ties, test once neither lacks any.

    The sides' sizes are whole numbers, halves rounded to even ones.
    """
    total = int(pdf[size].sum())
    room = [round(shares[0] * total), round(shares[1] * total)]
    out = []
    for n in pdf.sort_values(order)[size]:
        if room[0] <= 0 and room[1] <= 0:
            out.append("test")
        elif room[0] >= room[1]:
            out.append("train")
            room[0] -= n
        else:
            out.append("validation")
            room[1] -= n
    return pdf.sort_values(order).assign(split=out)


def deficit_splits(df: DataFrame, key: str, stratum: str, size: str, seed: str, shares: tuple[float, float]) -> DataFrame:
    """Adds ``split``: the rule of ``deficit_split`` with one running deficit for each stratum, groups in hash order.

    While train lacks at least as much as all of validation, it takes every group; once
    both are surely full, test does. Hash parts that lie wholly there are settled by
    the sums of the parts before. The groups between, about a quarter of all, are sorted by Spark and read as a stream, one task a
    stratum, which holds the two deficits and nothing else. Strata must not be null.
    """
    h = df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 2)).withColumn("_h", F.unhex("_h"))
    w = Window.partitionBy(stratum)
    parts = h.groupBy(stratum, "_b").agg(F.sum(size).alias("_s"), F.max(size).alias("_m"))
    parts = parts.select(stratum, "_b", "_s", (F.sum("_s").over(w.orderBy("_b")) - F.col("_s")).alias("_before"), F.max("_m").over(w).alias("_m"), *(F.bround(F.sum("_s").over(w) * F.lit(p)).cast("long").alias(c) for p, c in zip(shares, ("_t", "_v"))))
    side = F.when(F.col("_before") + F.col("_s") <= F.col("_t") - F.col("_v"), "train").when(F.col("_before") >= F.col("_t") + F.col("_v") + F.col("_m"), "test")
    h = h.join(F.broadcast(parts.select(stratum, "_b", (F.col("_t") - F.col("_before")).alias("_t"), "_v", side.alias("split"))), [stratum, "_b"])

    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, train, validation = None, 0, 0
        for pdf in batches:
            out = []
            for s, n, t, v in zip(pdf[stratum].tolist(), pdf[size].tolist(), pdf["_t"].tolist(), pdf["_v"].tolist()):
                if s != now:
                    now, train, validation = s, t, v
                if train <= 0 and validation <= 0:
                    out.append("test")
                elif train >= validation:
                    out.append("train")
                    train -= n
                else:
                    out.append("validation")
                    validation -= n
            yield pdf[names].assign(split=out)

    schema = f"{df.schema.toDDL()}, split string"
    between = h.where("split is null").repartition(stratum).sortWithinPartitions(stratum, "_h", key)
    return h.where("split is not null").select(*names, "split").unionByName(between.mapInPandas(run, schema))


def coverage_sample(pdf: pd.DataFrame, terms: str, order: str, quota: int) -> pd.DataFrame:
    """Greedy choice by term coverage: new terms first, then the sum of 1 / (1 + document frequency), then the place.

    One stratum of bounded size (its cap) at a time; ``terms`` holds lists.
    """
    rows = [(set(t), o) for t, o in zip(pdf[terms], pdf[order])]
    df: dict[str, int] = {}
    for t, _ in rows:
        for x in t:
            df[x] = df.get(x, 0) + 1
    seen: set[str] = set()
    left, chosen = set(range(len(rows))), []
    while left and len(chosen) < quota:
        best = min(left, key=lambda i: (-len(rows[i][0] - seen), -sum(1 / (1 + df[x]) for x in rows[i][0]), rows[i][1]))
        left.discard(best)
        chosen.append(best)
        seen |= rows[best][0]
    return pdf.iloc[chosen]
