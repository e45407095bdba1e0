"""What the two similarity joins share: the global n-gram order, postings, the exact check.

A table of texts becomes sets of three-token grams. Rows of equal sets form one
*class*; all joining is between classes, and rows come back by membership, so
copies cost nothing however many there are.

The global order is by document frequency, read from a counting sketch over all
rows. Any total order gives right results; the sketch decides how selective the
order is, never what is found. Its size is bounded (at most 2**24 counters of one
byte each), and so is what a task sends of it: one byte a counter, on a logarithmic
scale. A gram counts as hot only far above the average counter, so that a sketch
full of rare grams makes none of them look hot.

The overlap of a pair is a sum of two counts that have no gram in common. A pair
meets at a shared gram only if the overlap it needs can still be reached from there
on, by the places of the gram in both sets; those grams are counted where they meet.
All other shared grams are counted from the sets of the pairs found
(``summed``). The sum decides. Grams are 44-bit hashes: two texts of a hundred grams
get a false overlap with a chance of 6e-10, two of 1e5 grams with 6e-4.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from . import kernels as K

#: Rows handled at once: 12 bits of row, 8 of level and 44 of gram fill a sort key.
ROWS = 4096
#: Counters of the sketch a chunk row holds.
CHUNK = 1 << 16
#: Postings of one gram that one task pairs; beyond it the gram is split in blocks.
HOT = 20_000
#: Bytes of a gram in a stored set.
BLOB = 6



def sketch_bits(rows: int) -> int:
    """Counters follow the data up to the bound of 2**24."""
    return int(min(24, max(16, np.ceil(np.log2(max(1, rows) * 32)))))


def level_of(counts: np.ndarray) -> np.ndarray:
    """Frequency on a logarithmic scale in one byte; 0 only for 0."""
    out = np.zeros(len(counts), np.uint8)
    some = counts > 0
    out[some] = np.minimum(255, 1 + np.floor(6 * np.log2(counts[some].astype(np.float64)))).astype(np.uint8)
    return out


#: The count a level stands for.
COUNT_OF = np.concatenate([[0], np.ceil(2.0 ** (np.arange(255) / 6) - 1e-9)]).astype(np.uint64)


def add_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return level_of(COUNT_OF[a] + COUNT_OF[b])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_pylist()


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return K.gram_sets([K.fold(t) for t in texts])


def source(df: DataFrame, id_col: str, text_col: str, side: Column | None = None) -> DataFrame:
    """(rid, side, text, key); rows of a null side or id take no part. Ids may be of any type; ``key`` is their hash."""
    side = F.lit(0) if side is None else side
    rows = df.select(df[id_col].alias("rid"), side.cast("tinyint").alias("side"), df[text_col].cast("string").alias("text"))
    return rows.where("rid is not null and side is not null and text is not null").withColumn("key", F.xxhash64("rid"))


def profile(src: DataFrame, bits: int, bins: int = 96) -> DataFrame:
    """One pass: rows of kind 0 give each row's class, rows of kind 1 chunks of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros((2, 1 << bits), np.uint32), pa.null()
        names = ["kind", "h", "l", "rid", "side", "n", "slot", "blob"]
        for rid, side, texts in _batches(batches):
            g, at = _grams(texts)
            n = np.diff(at)
            per_row, kind = np.repeat(side, n), rid.type
            h = (K.mix(g.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            for s in (0, 1):
                own = h[per_row == s]
                if len(own):
                    np.add.at(counts[s], own, 1)
            keep = n > 0
            m = int(keep.sum())
            high, low, *_ = K.set_ids(g, at, bins)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(high[keep]), pa.array(low[keep]), rid.filter(pa.array(keep)), pa.array(side[keep].astype(np.int8)), pa.array(n[keep].astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for s in (0, 1):
            for c in range(0, 1 << bits, CHUNK):
                part = counts[s, c : c + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([c // CHUNK], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.array([s], pa.int8()), pa.nulls(1, pa.int32()), pa.array([task % 32], pa.int32()), pa.array([zlib.compress(level_of(part).tobytes(), 1)])], names)

    return src.select("rid", "side", "text").mapInArrow(run, f"kind tinyint, h long, l long, rid {src.schema['rid'].dataType.simpleString()}, side tinyint, n int, slot int, blob binary")


def _merged(table: pa.Table, kind: type, merge) -> pa.Table:
    wide = np.zeros(CHUNK, np.uint8 if merge is np.maximum else np.uint64)
    for blob in table.column("blob").to_pylist():
        part = np.frombuffer(zlib.decompress(blob), kind)
        if merge is add_levels:  # counts are added exactly and rounded once
            wide[: len(part)] += COUNT_OF[part]
        else:
            wide[: len(part)] = merge(wide[: len(part)], part)
    total = level_of(wide) if merge is add_levels else np.minimum(wide, np.iinfo(kind).max).astype(kind)
    first = table.slice(0, 1)
    return pa.table({"side": first.column("side"), "h": first.column("h"), "slot": first.column("slot"), "blob": pa.array([zlib.compress(total.tobytes(), 1)])})


def merge_chunks(chunks: DataFrame, bits: int, sides: int, kind: type, merge, tasks: int) -> np.ndarray:
    """The merged sketch on the driver, ``sides`` arrays of 2**bits.

    ``tasks`` made the chunks; where they are many, they are merged in two levels, so
    that no task reads all of them.
    """
    schema = "side tinyint, h long, slot int, blob binary"
    one = lambda table: _merged(table, kind, merge)
    part = chunks.select("side", "h", "slot", "blob")
    if tasks > 64:
        part = part.groupBy("side", "h", "slot").applyInArrow(one, schema)
    out = np.zeros((sides, max(CHUNK, 1 << bits)), kind)
    for r in part.groupBy("side", "h").applyInArrow(one, schema).collect():
        data = np.frombuffer(zlib.decompress(r.blob), kind)
        out[r.side, r.h * CHUNK : r.h * CHUNK + len(data)] = data
    return out[:, : 1 << bits]


class Sent:
    """Arrays to broadcast: compressed on the way and on disk, unpacked once in each worker."""

    def __init__(self, *arrays: np.ndarray):
        self.blobs, self.arrays = [(zlib.compress(a.tobytes(), 1), a.dtype.str, a.shape) for a in arrays], None

    def __getstate__(self) -> dict:
        return {"blobs": self.blobs, "arrays": None}

    def unpacked(self) -> list[np.ndarray]:
        if self.arrays is None:
            self.arrays = [np.frombuffer(zlib.decompress(b), kind).reshape(shape) for b, kind, shape in self.blobs]
        return self.arrays


class Order:
    """The global order on the driver: a level byte per counter and which sides have it."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, bits: int, tasks: int):
        counts = merge_chunks(chunks, bits, 2, np.uint8, add_levels, tasks)
        level, sides = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.uint8)
        mass, grams = np.zeros(256), 0
        for at in range(0, 1 << bits, CHUNK):  # piece by piece: the sketch may have 2**24 counters
            part = COUNT_OF[counts[:, at : at + CHUNK]]
            total = part.sum(axis=0)
            level[at : at + CHUNK] = own = level_of(total)
            sides[at : at + CHUNK] = (part[0] > 0).astype(np.uint8) | ((part[1] > 0).astype(np.uint8) << 1)
            mass += np.bincount(own, weights=total.astype(np.float64), minlength=256)
            grams += int(total.sum())
        self.bits, self.grams, self.tasks = bits, grams, tasks
        #: postings of one gram that one task pairs, well above what an average counter holds
        self.hot = max(HOT, 4 * grams >> bits)
        self.shared = spark.sparkContext.broadcast(Sent(level, sides, mass))

    def parts(self, spark: SparkSession, share: float) -> int:
        """Partitions for postings: about 300,000 in each, so that what a task holds doesn't follow the input."""
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(self.grams * share / 3e5) + 1)


def least(t: tuple[int, int], n: np.ndarray) -> np.ndarray:
    """ceil(t * n) in integers: the smallest partner of a set of n, and the least overlap with any."""
    return -(-t[0] * n // t[1])


def overlap_needed(t: tuple[int, int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of a and b grams whose Jaccard index is at least t."""
    return -(-t[0] * (a + b) // (t[0] + t[1]))


def ordered(g: np.ndarray, at: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order key of each gram, its counter), each row's grams in the global order."""
    n = np.diff(at)
    u = g.astype(np.uint64)
    slot = (K.mix(u) >> np.uint64(64 - bits)).astype(np.int64)
    key = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(52)) | (level[slot].astype(np.uint64) << np.uint64(44)) | u
    key.sort()
    u = key & np.uint64((1 << 44) - 1)
    return (key & np.uint64((1 << 52) - 1)).astype(np.int64), (K.mix(u) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(cls: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of posting, block) for postings of grams with more than ``most`` postings.

    The classes of such a gram fall in S parts by hash; a posting goes to the S
    blocks that hold its part, so each pair of parts meets in one block.
    """
    parts = np.minimum(-(-count // most), 4096).astype(np.int64)
    own = (K.mix(cls.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
    index = np.repeat(np.arange(len(cls)), parts)
    other = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = np.minimum(own[index], other), np.maximum(own[index], other)
    return index, (1 + low * 4096 + high) * 8192 + parts[index]


def own_part(cls: np.ndarray, block: np.ndarray) -> np.ndarray:
    parts = np.maximum(1, block % 8192).astype(np.uint64)
    return (K.mix(cls.astype(np.uint64)) % parts).astype(np.int64)


def crosses(block: np.ndarray) -> np.ndarray:
    """Blocks that hold two different parts."""
    pair = block // 8192 - 1
    return (block > 0) & (pair // 4096 != pair % 4096)


def may_differ(t: tuple[int, int], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """In how many grams two sets of these sizes may differ; parities that differ in more bits rule a pair out."""
    return na + nb - 2 * overlap_needed(t, na, nb)


class Pairs:
    """Distinct pairs of ids with summed weights, compressed as they come."""

    def __init__(self) -> None:
        self.rows, self.waiting, self.parts = [np.zeros(0, np.int64)] * 5, 0, []

    def add(self, ha, la, hb, lb, w) -> None:
        swap = (ha > hb) | ((ha == hb) & (la > lb))
        self.parts.append([np.where(swap, hb, ha), np.where(swap, lb, la), np.where(swap, ha, hb), np.where(swap, la, lb), w])
        self.waiting += len(ha)
        if self.waiting > 2_000_000:
            self.compress()

    def compress(self) -> None:
        if not self.parts:
            return
        cols = [np.concatenate([c, *(p[k] for p in self.parts)]) for k, c in enumerate(self.rows)]
        self.parts, self.waiting = [], 0
        u = [c.view(np.uint64) for c in cols[:4]]
        by = np.argsort(K.mix(u[0] ^ K.mix(u[1] ^ K.mix(u[2] ^ K.mix(u[3])))))
        cols = [c[by] for c in cols]
        differ = np.zeros(max(0, len(by) - 1), bool)
        for c in cols[:4]:
            differ |= c[1:] != c[:-1]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), differ]))
        self.rows = [c[new] for c in cols[:4]] + [np.add.reduceat(cols[4], new) if len(new) else cols[4]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.compress()
        for at in range(0, len(self.rows[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in self.rows], ["ah", "al", "bh", "bl", "w"])


PAIRS = "ah long, al long, bh long, bl long, w long"


def reachable(t: tuple[int, int], na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether two sets that share grams from these places in the order on can still reach their needed overlap."""
    return np.minimum(na - pa_, nb - pb) >= overlap_needed(t, na, nb)


def summed(src: DataFrame, members: DataFrame, pairs: DataFrame, order: Order, t: tuple[int, int], bins: int = 96) -> DataFrame:
    """(ah, al, bh, bl, na, nb, overlap) of the class pairs whose overlaps sum to a similarity of t or more.

    ``pairs`` brings in ``w`` the shared grams already counted: those at which the needed
    overlap was still in reach. The sets of the pairs, in the global order, give the
    count of all the others. Only classes that occur in a pair have their sets built
    again. A bitmap of those rows (1 MB, whatever the data) keeps the rest from being
    tokenised; the join decides, the bitmap only saves work.
    """
    spark, shared, order_bits = src.sparkSession, order.shared, order.bits
    in_pairs = pairs.select(F.explode(F.array(F.struct(F.col("ah").alias("h"), F.col("al").alias("l")), F.struct(F.col("bh").alias("h"), F.col("bl").alias("l")))).alias("c")).select("c.h", "c.l").distinct()
    reps = cut(members.join(in_pairs, ["h", "l"], "left_semi").groupBy("h", "l").agg(F.min("rid").alias("rid")))
    bits = 23

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.zeros(1 << bits, bool)
        for batch in batches:
            bit[(K.mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bit).tobytes(), 1)])], ["blob"])

    def join_bitmaps(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits >> 3, np.uint8)
        for blob in table.column("blob").to_pylist():
            total |= np.frombuffer(zlib.decompress(blob), np.uint8)
        return pa.table({"slot": table.slice(0, 1).column("slot"), "blob": pa.array([zlib.compress(total.tobytes(), 1)])})

    some = reps.select(F.xxhash64("rid").alias("key")).mapInArrow(bitmap, "blob binary").select((F.spark_partition_id() % 32).alias("slot"), "blob")
    rows = some.groupBy("slot").applyInArrow(join_bitmaps, "slot int, blob binary").collect()  # at most 32 rows
    total = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        total |= np.frombuffer(zlib.decompress(r.blob), np.uint8)
    wanted = spark.sparkContext.broadcast(total)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, level = np.unpackbits(wanted.value).astype(bool), shared.value.unpacked()[0]
        for batch in batches:
            key = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = bit[(K.mix(key.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)]
            batch = batch.filter(pa.array(keep))
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                g, off = _grams(part.column(2).to_pylist())
                high, low, *_ = K.set_ids(g, off, bins)
                g = ordered(g, off, level, order_bits)[0] & ((1 << 44) - 1)
                packed = g.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :BLOB].tobytes()
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((off * BLOB).astype(np.int64).tobytes()), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(high), pa.array(low), data.cast(pa.binary())], ["rid", "h", "l", "grams"])

    # a repeated id may hold other texts; the class tells them apart
    built = src.mapInArrow(blobs, f"rid {src.schema['rid'].dataType.simpleString()}, h long, l long, grams binary")
    sets = built.join(reps, ["rid", "h", "l"]).groupBy("h", "l").agg(F.first("grams").alias("grams"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m, wide, sizes = part.num_rows, [], []
                for name in ("ga", "gb"):
                    blob = part.column(part.schema.get_field_index(name)).to_pylist()
                    sizes.append(np.fromiter((len(x) // BLOB for x in blob), np.int64, m))
                    gram = np.zeros((int(sizes[-1].sum()), 8), np.uint8)
                    gram[:, :BLOB] = np.frombuffer(b"".join(blob), np.uint8).reshape(-1, BLOB)
                    wide.append(gram.view("<u8").ravel())
                na, nb = sizes
                need = overlap_needed(t, na, nb)
                keys = []
                for gram, n in zip(wide, sizes):
                    row = np.repeat(np.arange(m), n)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    behind = place > (n - need)[row]  # not counted where the pair met, whatever the other's place
                    keys.append(row.astype(np.uint64) << np.uint64(45) | gram << np.uint64(1) | behind.astype(np.uint64))
                key = np.concatenate(keys)
                key.sort()
                twice = (key[1:] >> np.uint64(1) == key[:-1] >> np.uint64(1)) & ((key[1:] | key[:-1]) & np.uint64(1) > 0)
                rest = np.bincount((key[1:][twice] >> np.uint64(45)).astype(np.int64), minlength=m)
                both = part.column(part.schema.get_field_index("w")).to_numpy(zero_copy_only=False).astype(np.int64) + rest
                ok = both * t[1] >= t[0] * (na + nb - both)
                yield pa.RecordBatch.from_arrays([*(part.column(k).filter(pa.array(ok)) for k in range(4)), *(pa.array(x[ok].astype(np.int32)) for x in (na, nb, both))], ["ah", "al", "bh", "bl", "na", "nb", "overlap"])

    full = pairs.select("ah", "al", "bh", "bl", "w").join(sets.toDF("ah", "al", "ga"), ["ah", "al"]).join(sets.toDF("bh", "bl", "gb"), ["bh", "bl"]).select("ah", "al", "bh", "bl", "w", "ga", "gb")
    return full.mapInArrow(count, "ah long, al long, bh long, bl long, na int, nb int, overlap int")


def copies(members: DataFrame, left: Column, right: Column, most: int | None = None) -> DataFrame:
    """(ra, rb): the pairs of rows of one class, one of ``left`` and one of ``right``.

    A class of many rows is cut into parts by a hash of the id, and each pair of
    parts is a key of its own, so that no task holds more than two parts.
    """
    most = most or HOT
    size = members.groupBy("h", "l").agg(F.count(F.lit(1)).alias("c"), F.count_if(left).alias("x"), F.count_if(right).alias("y")).where("c > 1 and x > 0 and y > 0").select("h", "l", F.ceil(F.col("c") / most).cast("int").alias("parts"))
    rows = members.join(size, ["h", "l"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts").cast("long")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = rows.where(left).select("h", "l", F.col("own").alias("p"), every.alias("q"), F.col("rid").alias("ra"))
    b = rows.where(right).select("h", "l", every.alias("p"), F.col("own").alias("q"), F.col("rid").alias("rb"))
    return a.join(b, ["h", "l", "p", "q"]).select("ra", "rb")
