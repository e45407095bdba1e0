"""Problem 6: groups of records that differ by small edits, by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..shared import cut
from . import kernels as K
from . import setjoin as J


def _postings(src: DataFrame, order: J.Order, t: tuple[int, int], parts: int) -> DataFrame:
    """Each class's grams from which a needed overlap may start, cut along the global order into fragments.

    A fragment is a contiguous range of the order; every level of frequency is cut
    into as many as its share of all grams, and fragments go round the partitions.
    """
    shared, bits, most = order.shared, order.bits, order.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, _, mass = shared.value.unpacked()
        cuts = np.maximum(1, np.ceil(16 * parts * mass / max(1.0, mass.sum()))).astype(np.int64)
        first = np.cumsum(cuts) - cuts
        seen: set[tuple[int, int]] = set()
        for _, _, texts in J._batches(batches):
            g, at = J._grams(texts)
            n = np.diff(at)
            high, low, *_ = K.set_ids(g, at)
            key, _ = J.ordered(g, at, level, bits)
            new = np.zeros(len(n), bool)
            for i, c in enumerate(zip(high.tolist(), low.tolist())):
                if n[i] and c not in seen:  # a class met twice in a task is sent once
                    seen.add(c)
                    new[i] = True
            if len(seen) > 1_000_000:
                seen.clear()
            pos = np.arange(len(key)) - np.repeat(at[:-1], n)
            keep = np.flatnonzero((pos < np.repeat(n - J.least(t, n) + 1, n)) & np.repeat(new, n))
            row = np.repeat(np.arange(len(n)), n)[keep]
            lev, key, pos = key[keep] >> 44, key[keep], pos[keep]
            part = (first[lev] + ((key & ((1 << 44) - 1)) * cuts[lev] >> 44)) % parts
            block = np.zeros(len(row), np.int64)
            count = 2.0 ** (lev / 6)
            hot = np.flatnonzero(count > most)
            if len(hot):
                index, blk = J.blocks(low[row[hot]], count[hot], most)
                cold = np.flatnonzero(count <= most)
                take = np.concatenate([cold, hot[index]])
                part = np.concatenate([part[cold], (part[hot[index]] + (K.mix(blk.astype(np.uint64)) >> np.uint64(40)).astype(np.int64)) % parts])
                key, row, pos, block = key[take], row[take], pos[take], np.concatenate([block[cold], blk])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), pa.array(high[row]), pa.array(low[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(block)], ["part", "gram", "h", "l", "n", "pos", "block"])

    return src.select("rid", "side", "text").mapInArrow(run, "part int, gram long, h long, l long, n int, pos int, block long")


def _partial_overlaps(postings: DataFrame, t: tuple[int, int], parts: int) -> DataFrame:
    """Pairs of classes of each fragment, and how many of its grams they share.

    A pair counts at a gram only if, given both sizes and both places in the order,
    the needed overlap can still be reached from there on; a pair at or above t has
    such a gram, namely its first common one. The grams behind are counted for the
    pairs found, in ``setjoin.summed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        gram, h, l, n, pos, block = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for k in range(1, 7))
        del held
        by = np.lexsort((l, K.mix(gram.astype(np.uint64) ^ K.mix(block.astype(np.uint64)))))
        gram, h, l, n, pos, block = gram[by], h[by], l[by], n[by], pos[by], block[by]
        # a class that several tasks sent counts once
        once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1]) | (l[1:] != l[:-1]) | (h[1:] != h[:-1])])
        gram, h, l, n, pos, block = (c[once] for c in (gram, h, l, n, pos, block))
        same = (gram[1:] == gram[:-1]) & (block[1:] == block[:-1])
        edge = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        end = np.repeat(edge[1:], np.diff(edge))
        part, cross = J.own_part(l, block), J.crosses(block)
        at, step, pairs = np.arange(len(gram)), 1, J.Pairs()
        while len(at):
            at = at[at + step < end[at]]
            x, y = at, at + step
            ok = ((h[x] != h[y]) | (l[x] != l[y])) & (~cross[x] | (part[x] != part[y])) & J.reachable(t, n[x], n[y], pos[x], pos[y])
            x, y = x[ok], y[ok]
            ok = K.differing_bits(h[x], l[x], h[y], l[y]) <= J.may_differ(t, n[x], n[y])
            x, y = x[ok], y[ok]
            if len(x):
                pairs.add(h[x], l[x], h[y], l[y], np.ones(len(x), np.int64))
            step += 1
        yield from pairs.batches()

    return postings.repartitionById(parts, "part").mapInArrow(run, J.PAIRS)


def class_pairs(df: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class of each row, and the pairs of classes at or above the threshold."""
    src = J.source(df, id_col, text_col)
    bits = J.sketch_bits(df.count())
    seen = cut(J.profile(src, bits), "kind")
    members = seen.where("kind = 0").select("h", "l", "rid", "n")
    order = J.Order(df.sparkSession, seen.where("kind = 1"), bits, src.rdd.getNumPartitions())
    parts = order.parts(df.sparkSession, 1.2 - threshold[0] / threshold[1])
    partial = _partial_overlaps(_postings(src, order, threshold, parts), threshold, parts)
    pairs = cut(partial.groupBy("ah", "al", "bh", "bl").agg(F.sum("w").alias("w")))
    return members, cut(J.summed(src, members, pairs, order, threshold))


def near_duplicate_pairs(df: DataFrame, id_col: str = "record_id", text_col: str = "instruction", threshold: tuple[int, int] = (7, 10)) -> DataFrame:
    """All pairs of rows (``record_id_a`` < ``record_id_b``) whose similarity is at least the threshold.

    Similarity is the Jaccard index of the sets of three consecutive tokens. The
    global n-gram order, rarest first, is cut into fragments; each fragment counts
    the overlap of the pairs that meet in it. Grams behind the reach of a pair can't
    bring a new pair; their overlap is counted for the pairs found. The partial
    overlaps are summed per pair, and the sum decides.

    Null, empty and short texts (under three tokens) are in no pair; copies are in
    pairs of similarity 1; ids of any type that has an order; a repeated id pairs with
    itself in no row; an empty table gives an empty result; other columns are not read.
    """
    members, pairs = class_pairs(df, id_col, text_col, threshold)
    between = pairs.select("ah", "al", "bh", "bl").join(members.select(F.col("h").alias("ah"), F.col("l").alias("al"), F.col("rid").alias("ra")), ["ah", "al"]).join(members.select(F.col("h").alias("bh"), F.col("l").alias("bl"), F.col("rid").alias("rb")), ["bh", "bl"]).select("ra", "rb")
    within = J.copies(members, F.lit(True), F.lit(True)).where("ra < rb")
    both = between.unionByName(within)
    return both.where("ra <> rb").select(F.least("ra", "rb").alias("record_id_a"), F.greatest("ra", "rb").alias("record_id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str = "record_id", text_col: str = "instruction", threshold: tuple[int, int] = (7, 10)) -> DataFrame:
    """One row for each row of at least three tokens: ``record_id``, ``group_id`` (least id of its group), ``links``, ``copies``.

    ``links`` counts the other classes its class is similar to, ``copies`` the rows
    of its own class, itself included. Groups are connected components.
    """
    members, pairs = class_pairs(df, id_col, text_col, threshold)
    node = members.groupBy("h", "l").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies"))
    node = cut(node)
    links = cut(pairs.join(node.select(F.col("h").alias("ah"), F.col("l").alias("al"), F.col("node").alias("x")), ["ah", "al"]).join(node.select(F.col("h").alias("bh"), F.col("l").alias("bl"), F.col("node").alias("y")), ["bh", "bl"]).select("x", "y"))
    label = components(links).select("node", F.col("label").alias("group_id"))
    degree = links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    of = node.join(degree, "node", "left").join(label, "node", "left").select("h", "l", F.coalesce("group_id", "node").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "copies")
    return members.join(of, ["h", "l"]).select(F.col("rid").alias("record_id"), "group_id", "links", "copies")
