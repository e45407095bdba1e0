"""Problem 4: the same or nearly the same text in training and evaluation splits, by a suffix array."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from . import kernels as K
from . import setjoin as J

SUFFIX = "part int, gram long, h long, l long, x long, y long, n int, pos int, side tinyint, block long"
#: Parities of a set that travel with its suffixes.
BINS = 224


def _scaled(values: np.ndarray, up: bool) -> np.ndarray:
    """Sizes on a logarithmic scale of one byte, rounded to the safe side: up with code c for 2^(c/16), down with c for 2^((c - 1)/16)."""
    q = 16 * np.log2(np.maximum(1, values))
    return np.clip(np.ceil(q + 1e-9) if up else np.floor(q + 1e-9) + 1, 1, 255).astype(np.uint8)


class _Rare:
    """The suffixes of a batch that can be the first that a pair shares, by what is known so far.

    A text that is similar enough to another shares one of its rarest grams with it
    (as many as may be missing, and one more). One suffix is kept of each such gram,
    if the sketch of the other side has the gram at all, of texts that the other side
    may cover far enough.
    """

    def __init__(self, texts: list, side: np.ndarray, level: np.ndarray, sides: np.ndarray, bits: int, t: tuple[int, int]):
        g, row = K.suffixes([K.fold(x) for x in texts])
        slot = (K.mix(g) >> np.uint64(64 - bits)).astype(np.int64)
        key = (row.astype(np.uint64) << np.uint64(52)) | (level[slot].astype(np.uint64) << np.uint64(44)) | g
        by = np.argsort(key)
        key = key[by]
        by = by[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
        self.g, self.row, self.slot = g[by], row[by], slot[by]
        self.n = np.bincount(self.row, minlength=len(texts))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.pos = np.arange(len(by)) - np.repeat(self.at[:-1], self.n)
        size = self.n[self.row]
        self.side = side[self.row].astype(np.int64)
        there = (sides[self.slot] >> (1 - self.side)) & 1 > 0
        most = np.bincount(self.row[there], minlength=len(texts))  # grams the other side can cover
        self.keep = (self.pos < size - J.least(t, size) + 1) & there & (most >= J.least(t, self.n))[self.row]
        #: the largest partner that can still be similar if this is the first gram they share
        self.largest = (t[0] + t[1]) * (size - self.pos) // t[0] - size
        self.size = size


def _reach(src: DataFrame, order: J.Order, t: tuple[int, int]) -> np.ndarray:
    """For each side and counter, the smallest text with such a suffix and the largest partner one of them allows."""
    shared, bits = order.shared, order.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, sides, _ = shared.value.unpacked()
        found = np.zeros((4, 1 << bits), np.uint8)
        for _, side, texts in J._batches(batches):
            r = _Rare(texts, side, level, sides, bits, t)
            for s in (0, 1):
                own = np.flatnonzero(r.keep & (r.side == s))
                np.maximum.at(found[s], r.slot[own], 255 - _scaled(r.size[own], False) + 1)
                np.maximum.at(found[2 + s], r.slot[own], _scaled(r.largest[own], True))
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for s in range(4):
            for c in range(0, 1 << bits, J.CHUNK):
                part = found[s, c : c + J.CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int8()), pa.array([c // J.CHUNK], pa.int64()), pa.array([task % 32], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["side", "h", "slot", "blob"])

    return J.merge_chunks(src.select("rid", "side", "text").mapInArrow(run, "side tinyint, h long, slot int, blob binary"), bits, 4, np.uint8, np.maximum, order.tasks)


def _suffixes(src: DataFrame, order: J.Order, reach: np.ndarray, t: tuple[int, int], parts: int) -> DataFrame:
    """The suffixes worth sending: those that some suffix of the other side, by its text's size, can go with.

    Suffixes go to partitions by their first three tokens, so a partition owns whole
    intervals of the suffix array of all texts.
    """
    shared, bits, most_in_task, bound = order.shared, order.bits, order.hot, src.sparkSession.sparkContext.broadcast(J.Sent(reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, sides, _ = shared.value.unpacked()
        reached = bound.value.unpacked()[0]
        seen: set[tuple[int, int, int]] = set()
        for _, side, texts in J._batches(batches):
            r = _Rare(texts, side, level, sides, bits, t)
            high, low, third, fourth = K.set_ids(r.g.astype(np.int64), r.at, BINS)
            new = np.zeros(len(r.n), bool)
            for i, c in enumerate(zip(high.tolist(), low.tolist(), side.tolist())):
                if r.n[i] and c not in seen:  # a class met twice in a task is sent once
                    seen.add(c)
                    new[i] = True
            if len(seen) > 1_000_000:
                seen.clear()
            least, most = reached[1 - r.side, r.slot].astype(np.float64), reached[3 - r.side, r.slot].astype(np.float64)
            keep = r.keep & new[r.row] & (least > 0)
            keep &= (r.largest * (1 + 1e-6) >= 2.0 ** ((255 - least) / 16)) & ((most == 255) | (2.0 ** (most / 16) * (1 + 1e-6) >= r.size))
            keep = np.flatnonzero(keep)
            row, pos, block = r.row[keep], r.pos[keep], np.zeros(len(keep), np.int64)
            part = (K.mix(r.g[keep] ^ K._M3) % np.uint64(parts)).astype(np.int64)
            count = 2.0 ** (level[r.slot[keep]] / 6)
            hot = np.flatnonzero(count > most_in_task)
            if len(hot):
                index, blk = J.blocks(low[row[hot]], count[hot], most_in_task)
                cold = np.flatnonzero(count <= most_in_task)
                take = np.concatenate([cold, hot[index]])
                part = np.concatenate([part[cold], (part[hot[index]] + (K.mix(blk.astype(np.uint64)) >> np.uint64(40)).astype(np.int64)) % parts])
                keep, row, pos, block = keep[take], row[take], pos[take], np.concatenate([block[cold], blk])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(r.g[keep].astype(np.int64)), pa.array(high[row]), pa.array(low[row]), pa.array(third[row]), pa.array(fourth[row]), pa.array(r.n[row].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(side[row].astype(np.int8)), pa.array(block)], ["part", "gram", "h", "l", "x", "y", "n", "pos", "side", "block"])

    return src.select("rid", "side", "text").mapInArrow(run, SUFFIX)


def _shared_spans(suffixes: DataFrame, t: tuple[int, int], parts: int) -> DataFrame:
    """Cross-split pairs of texts and how many grams their shared spans cover, as far as they meet here.

    A partition sorts its suffixes; those that start alike are neighbours, and each
    interval of such neighbours pairs the suffixes of one side with those of the other,
    if the needed overlap is still in reach there. The spans that begin behind are
    counted for the pairs found, in ``setjoin.summed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        gram, h, l, third, fourth, n, pos, side, block = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for k in range(1, 10))
        del held
        by = np.lexsort((l, side, K.mix(gram.astype(np.uint64) ^ K.mix(block.astype(np.uint64)))))
        gram, h, l, third, fourth, n, pos, side, block = (c[by] for c in (gram, h, l, third, fourth, n, pos, side, block))
        same = (gram[1:] == gram[:-1]) & (block[1:] == block[:-1])
        once = np.concatenate([[True], ~(same & (side[1:] == side[:-1]) & (l[1:] == l[:-1]) & (h[1:] == h[:-1]))])  # a class that several tasks sent
        gram, h, l, third, fourth, n, pos, side, block = (c[once] for c in (gram, h, l, third, fourth, n, pos, side, block))
        edge = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1]), [True]]))
        part, cross = J.own_part(l, block), J.crosses(block)
        interval = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        evals, trains = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        first = np.searchsorted(interval[trains], interval[evals], side="left")
        many = np.searchsorted(interval[trains], interval[evals], side="right") - first
        pairs, at = J.Pairs(), 0
        done = np.cumsum(many)
        while at < len(evals):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 2_000_000, side="right")))
            m = many[at:end]
            x = np.repeat(evals[at:end], m)
            y = trains[np.repeat(first[at:end] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            at = end
            ok = ((h[x] != h[y]) | (l[x] != l[y])) & (~cross[x] | (part[x] != part[y])) & J.reachable(t, n[x], n[y], pos[x], pos[y])
            x, y = x[ok], y[ok]
            ok = K.differing_bits(h[x], l[x], h[y], l[y]) + sum(np.bitwise_count((c[x] ^ c[y]).view(np.uint64)) for c in (third, fourth)) <= J.may_differ(t, n[x], n[y])
            x, y = x[ok], y[ok]
            if len(x):
                pairs.add(h[x], l[x], h[y], l[y], np.ones(len(x), np.int64))
        yield from pairs.batches()

    return suffixes.repartitionById(parts, "part").mapInArrow(run, J.PAIRS)


def side_of(split: F.Column) -> F.Column:
    """0 for training rows, 1 for evaluation rows, null (taking no part) for any other."""
    name = F.lower(F.trim(split))
    return F.when(name == "train", 0).when(name.isin("validation", "test"), 1)


def class_pairs(df: DataFrame, id_col: str, text_col: str, split_col: str, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class and side of each row, and the pairs of different classes at or above the threshold that lie on both sides."""
    src = J.source(df, id_col, text_col, side_of(df[split_col]))
    bits = J.sketch_bits(df.count())
    seen = cut(J.profile(src, bits, BINS), "kind")
    members = seen.where("kind = 0").select("h", "l", "rid", "side")
    order = J.Order(df.sparkSession, seen.where("kind = 1"), bits, src.rdd.getNumPartitions())
    parts = order.parts(df.sparkSession, 1.2 - threshold[0] / threshold[1])
    reach = _reach(src, order, threshold)
    spans = _shared_spans(_suffixes(src, order, reach, threshold, parts), threshold, parts)
    pairs = cut(spans.groupBy("ah", "al", "bh", "bl").agg(F.sum("w").alias("w")))
    return members, cut(J.summed(src, members, pairs, order, threshold, BINS))


def counterparts(df: DataFrame, id_col: str = "record_id", text_col: str = "instruction", split_col: str = "split", threshold: tuple[int, int] = (1, 2)) -> DataFrame:
    """(``id``, ``n``): of each evaluation row that has any, the number of similar training rows.

    Counted by class, so copies are never expanded into pairs.
    """
    members, pairs = class_pairs(df, id_col, text_col, split_col, threshold)
    size = cut(members.groupBy("h", "l").agg(F.count_if(F.col("side") == 0).alias("train"), F.count_if(F.col("side") == 1).alias("evals")))
    both = pairs.select("ah", "al", "bh", "bl").unionByName(pairs.select(F.col("bh").alias("ah"), F.col("bl").alias("al"), F.col("ah").alias("bh"), F.col("al").alias("bl")))
    near = both.join(size.where("train > 0").select(F.col("h").alias("bh"), F.col("l").alias("bl"), "train"), ["bh", "bl"]).select(F.col("ah").alias("h"), F.col("al").alias("l"), "train")
    n = near.unionByName(size.select("h", "l", "train")).groupBy("h", "l").agg(F.sum("train").alias("n")).where("n > 0")
    return members.where("side = 1").join(n, ["h", "l"]).select(F.col("rid").alias("id"), "n")


def cross_split_pairs(df: DataFrame, id_col: str = "record_id", text_col: str = "instruction", split_col: str = "split", threshold: tuple[int, int] = (1, 2)) -> DataFrame:
    """(``record_id_a`` < ``record_id_b``): one row in train, one in validation or test, similar at or above the threshold.

    Pairs come from the suffix array of all texts, partitioned by the first three
    tokens: neighbours of different sides start a shared span. What the shared spans
    of a pair cover is summed, and the sum decides. Kept are the suffixes that can be
    the first a similar pair shares; spans behind them are counted for the pairs found.
    Rows of null, empty or short text (under three tokens) or of no split are in no
    pair; copies are; ids may be of any type that has an order; an empty table gives no
    rows; only the three named columns are read.
    """
    members, found = class_pairs(df, id_col, text_col, split_col, threshold)
    side = lambda k: members.select(F.col("h").alias(f"{k}h"), F.col("l").alias(f"{k}l"), F.col("rid").alias(f"r{k}"), F.col("side").alias(f"s{k}"))
    between = found.select("ah", "al", "bh", "bl").join(side("a"), ["ah", "al"]).join(side("b"), ["bh", "bl"]).where("sa <> sb").select("ra", "rb")
    within = J.copies(members, F.col("side") == 0, F.col("side") == 1)
    both = between.unionByName(within)
    return both.select(F.least("ra", "rb").alias("record_id_a"), F.greatest("ra", "rb").alias("record_id_b"))


def coverage(df: DataFrame, id_col: str = "record_id", text_col: str = "instruction", split_col: str = "split") -> DataFrame:
    """(``id``, ``grams``, ``covered``): the distinct grams of each evaluation row, and how many of them stand in any training row.

    The whole suffix array: every distinct start of the evaluation texts and every one
    that a training task holds go to a partition by their first three tokens and are
    sorted; an evaluation suffix beside a training one that starts alike is covered.
    Rows of null, empty or short text (under three tokens) have no row here.
    """
    src = J.source(df, id_col, text_col, side_of(df[split_col]))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), src.rdd.getNumPartitions() * 4)
    kind = src.schema["rid"].dataType.simpleString()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, _, texts in J._batches(batches):
            g, at = J._grams(texts)
            n = np.diff(at)
            high, low, *_ = K.set_ids(g, at)
            keep = n > 0
            yield pa.RecordBatch.from_arrays([rid.filter(pa.array(keep)), pa.array(high[keep]), pa.array(low[keep]), pa.array(n[keep].astype(np.int32))], ["id", "h", "l", "n"])

    members = cut(src.where("side = 1").select("rid", "side", "text").mapInArrow(classes, f"id {kind}, h long, l long, n int"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << 20, np.uint64)  # training starts this task sent last, one a slot: fewer repeats
        for _, side, texts in J._batches(batches):
            g, at = J._grams(texts)
            n = np.diff(at)
            high, low, *_ = K.set_ids(g, at)
            row = np.repeat(np.arange(len(n)), n)
            u = g.astype(np.uint64)
            mine = np.flatnonzero(side[row] == 1)
            train = np.unique(u[side[row] == 0])
            slot = (K.mix(train) >> np.uint64(44)).astype(np.int64)
            train, slot = train[met[slot] != train + np.uint64(1)], slot[met[slot] != train + np.uint64(1)]
            met[slot] = train + np.uint64(1)
            gram = np.concatenate([train, u[mine]])
            of = lambda x: pa.concat_arrays([pa.nulls(len(train), pa.int64()), pa.array(x[row[mine]])])
            part = (K.mix(gram ^ K._M3) % np.uint64(parts)).astype(np.int32)
            by = np.lexsort((gram, part))  # sorted suffixes compress better
            yield pa.RecordBatch.from_arrays([pa.array(part[by]), pa.array(gram[by].astype(np.int64)), of(high).take(pa.array(by)), of(low).take(pa.array(by))], ["part", "gram", "h", "l"])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, refs, trained = [], [], []
        for b in batches:  # training starts are merged as they come
            g = b.column(1).to_numpy(zero_copy_only=False)
            ours = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            trained.append(np.unique(g[~ours]))
            if len(trained) > 64:
                trained = [np.unique(np.concatenate(trained))]
            grams.append(g[ours])
            refs.append(np.stack([b.column(k).drop_null().to_numpy(zero_copy_only=False) for k in (2, 3)], axis=1))
        if not grams:
            return
        train, gram, ref = np.unique(np.concatenate(trained)), np.concatenate(grams), np.concatenate(refs)
        at = np.minimum(np.searchsorted(train, gram), max(0, len(train) - 1))
        hit = train[at] == gram if len(train) else np.zeros(len(gram), bool)
        # a class is sent by each of its rows; a gram of it counts once
        by = np.lexsort((gram[hit], ref[hit][:, 1], ref[hit][:, 0]))
        ref, gram = ref[hit][by], gram[hit][by]
        new = np.concatenate([np.ones(min(1, len(by)), bool), (ref[1:] != ref[:-1]).any(axis=1) | (gram[1:] != gram[:-1])])
        ref = ref[new]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(ref)), bool), (ref[1:] != ref[:-1]).any(axis=1)]))
        count = np.diff(np.append(start, len(ref)))
        yield pa.RecordBatch.from_arrays([pa.array(ref[start, 0]), pa.array(ref[start, 1]), pa.array(count.astype(np.int32))], ["h", "l", "c"])

    sums = src.select("rid", "side", "text").mapInArrow(suffixes, "part int, gram long, h long, l long").repartitionById(parts, "part").mapInArrow(covered, "h long, l long, c int").groupBy("h", "l").agg(F.sum("c").alias("c"))
    return members.join(sums, ["h", "l"], "left").select("id", F.col("n").cast("long").alias("grams"), F.coalesce("c", F.lit(0)).alias("covered"))


def overlap_report(df: DataFrame, hits: DataFrame, covered: DataFrame | None = None, id_col: str = "record_id", split_col: str = "split", by: tuple[str, ...] = ("subset", "origin")) -> DataFrame:
    """Evaluation rows with a counterpart in train, their pairs, and the grams that train covers, per split and ``by`` column.

    Every group of evaluation rows has a row, of zeros if nothing overlaps. ``hits`` is what
    ``counterparts`` gives; ``covered`` is what ``coverage`` gives; without it those two columns are missing.
    """
    rows = df.where(side_of(df[split_col]) == 1).select(F.col(id_col).alias("_id"), F.col(split_col).alias("split"), *by)
    rows = rows.join(hits.select(F.col("id").alias("_id"), F.col("n").alias("_n")), "_id", "left")
    more = []
    if covered is not None:
        rows = rows.join(covered.select(F.col("id").alias("_id"), "grams", "covered"), "_id", "left")
        more = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("grams", "covered")]
    return rows.groupBy("split", *by).agg(F.count(F.lit(1)).alias("rows"), F.count("_n").alias("overlapping"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pairs"), *more)
