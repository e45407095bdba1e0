"""Problem 9: the subject areas of documents, by term weighting, truncated SVD and refined seed centroids.

Two term spaces, one for Han bigrams and one for Latin words and word pairs, each
hashed to a fixed number of terms and weighted by tf-idf over all distinct texts,
so that copies count once; a term of many documents counts as far as the labels
show it to be some areas' own. Texts are tokenised once; every later pass reads their
term numbers. The leading right singular vectors of each space come from a block
power iteration: a pass over the documents multiplies a basis by A'A, partition by
partition, and only the term-by-rank product is summed, whose size doesn't depend on
the data, until the space they span settles. Documents
and their sentences are then vectors of that rank. Centroids start from labelled
documents (or an area's description where it has none), and are refined on the
documents clearly nearest to one. A sentence belongs to an area if its cosine to
that centroid is clear; a document treats the areas that hold enough of its
sentences, not those that one passing sentence touches.
"""

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

TERM_BITS, RANK, POWER, ROUNDS = 16, 64, 4, 4
#: The power iteration ends when a pass moves less than this share of the leading singular values, as many as
#: there are areas, out of the space (at most POWER passes); the others add detail.
SETTLED = 0.05
TERMS = 1 << TERM_BITS
#: Labelled documents read at most for the first centroids.
LABELS = 50_000
#: Terms in fewer than this share of the texts say nothing. Those in more than COMMON
#: times an area's even share are weighted by how unevenly the labelled areas use them.
RARE, COMMON = 0.001, 1.8
#: Labelled documents that an area's use of a term is smoothed by.
SMOOTH = 5
#: A document is clearly of one area, and a sentence of an area, from these cosines and leads on.
DOC_CLEAR, SENTENCE_CLEAR = (0.5, 0.25), (0.25, 0.1)
#: Shares an area needs of a document's area sentences and of all its sentences.
OF_AREAS, OF_ALL, PASSING = 0.25, 0.12, 3
ROWS = 1000
_BREAKS = "。！？!?；;\n\r|"  # sentence ends besides a full stop before a space

_breaks: np.ndarray | None = None


def _hash(x: np.ndarray) -> np.ndarray:
    """Term numbers; the last is kept for the number of documents."""
    return (K.mix(x) % np.uint64(TERMS - 1)).astype(np.int64)


def terms(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per script (row, sentence, term) of all Han bigrams, and of all Latin words and word pairs within sentences."""
    global _breaks
    if _breaks is None:
        table = np.zeros(0x110000, bool)
        table[[ord(c) for c in _BREAKS]] = True
        _breaks = table
    c, at = K.codes(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    stop = c == 46
    stop[:-1] &= (c[1:] == 32) | (c[1:] == 10) | (c[1:] == 0)
    new = _breaks[c] | stop
    new[at[:-1][at[:-1] < len(c)]] = True
    sentence = np.cumsum(new)
    han = (c >= 0x4E00) & (c <= 0x9FFF)
    i = np.flatnonzero(han[:-1] & han[1:])
    out = [(row[i], sentence[i], _hash(c[i].astype(np.uint64) << np.uint64(21) | c[i + 1].astype(np.uint64)))]
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xDF) & (c <= 0x24F))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return [*out, (none, none, none)]
    inside = np.flatnonzero(letter)
    offset = inside - start[np.cumsum(first[inside]) - 1]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(offset.max()), K._M3 | np.uint64(1))]))
    word = np.add.reduceat(K.mix(c[inside].astype(np.uint64)) * power[offset], np.flatnonzero(first[inside]))
    pair = sentence[start[:-1]] == sentence[start[1:]]
    where = np.concatenate([start, start[:-1][pair]])
    return [*out, (row[where], sentence[where], np.concatenate([_hash(word), _hash(word[:-1] * K._M1 + word[1:])[pair]]))]


class Weights:
    """tf-idf of terms that aren't too rare, from counts over all texts and by area over the labelled ones."""

    def __init__(self, df: np.ndarray, areas: int, by_area: np.ndarray | None = None):
        docs = df[:, -1].astype(float)
        self.idf = np.zeros(df.shape, np.float32)
        for s in range(len(df)):
            n = df[s].astype(float)
            use = n >= max(2, RARE * docs[s])
            use[-1] = False
            self.idf[s][use] = np.log((docs[s] + 1) / (n[use] + 1))
            wide = use & (n > max(2, COMMON / areas * docs[s]))
            if areas > 1:
                self.idf[s][wide] *= 0 if by_area is None else _uneven(by_area[s][:, wide], by_area[s][:, -1:], n[wide] / docs[s])
        self.used = [np.flatnonzero(x > 0) for x in self.idf]
        self.place = np.full(df.shape, -1, np.int64)
        for s, u in enumerate(self.used):
            self.place[s][u] = np.arange(len(u))

    def rows(self, s: int, group: np.ndarray, term: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, place of term, weight) with unit rows, ordered by group."""
        p = self.place[s][term]
        ok = p >= 0
        key, count = _counted(group[ok] * TERMS + p[ok])
        g, p = key // TERMS, key % TERMS
        w = ((1 + np.log(count)) * self.idf[s][self.used[s][p]]).astype(np.float32)
        norm = np.sqrt(np.bincount(g, weights=w * w, minlength=groups))
        return g, p, (w / np.maximum(norm[g], 1e-9)).astype(np.float32)


def _uneven(count: np.ndarray, docs: np.ndarray, share: np.ndarray) -> np.ndarray:
    """0 for terms that all areas use alike, 1 for those of few: from the entropy over the areas, each counting the same."""
    p = (count + SMOOTH * share) / (docs + SMOOTH)
    p /= p.sum(axis=0)
    return np.clip(4 * (0.9 + (p * np.log(p)).sum(axis=0) / np.log(len(p))), 0, 1)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[edge], np.diff(np.append(edge, len(key)))


def _times(group: np.ndarray, place: np.ndarray, weight: np.ndarray, basis: np.ndarray, groups: int) -> np.ndarray:
    """The sparse rows times the basis; rows come ordered by group."""
    out = np.zeros((groups, basis.shape[1]), np.float32)
    edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]]))
    for at in range(0, len(edge), 5000):
        part = edge[at : at + 5000]
        end = edge[at + 5000] if at + 5000 < len(edge) else len(group)
        s = slice(part[0], end)
        out[group[part]] = np.add.reduceat(basis[place[s]] * weight[s, None], part - part[0], axis=0)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, [K.fold(t) for t in part.column(1).to_pylist()]


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a row, of ``counts`` numbers each."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many of each row) of such a column."""
    blobs = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(blobs), kind), np.fromiter((len(b) // width for b in blobs), np.int64, len(blobs))


def numbered(rows: DataFrame) -> DataFrame:
    """(a, l0, t0, l1, t1) of (a, text): per script the terms of each text, sentence by sentence, and the sentences' lengths.

    Written to the shared folder: tokenised once, read by every pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            out = [part.column(0)]
            for row, sentence, term in terms(texts):
                by = np.argsort(sentence, kind="stable")
                row, sentence, term = row[by], sentence[by], term[by]
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), sentence[1:] != sentence[:-1]]))
                length = np.diff(np.append(new, len(row))).astype(np.uint32)
                out += [_binary(length, np.bincount(row[new], minlength=len(texts))), _binary(term.astype(np.uint16), np.bincount(row, minlength=len(texts)))]
            yield pa.RecordBatch.from_arrays(out, ["a", "l0", "t0", "l1", "t1"])

    return cut(rows.mapInArrow(run, f"a {rows.schema['a'].dataType.simpleString()}, l0 binary, t0 binary, l1 binary, t1 binary"))


def _spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
    """(a, number of texts, per script (row, sentence, owner of each sentence, term)) of numbered texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part, spaces = batch.slice(at, ROWS), []
            n = part.num_rows
            for s in (0, 1):
                length, sentences = _numbers(part.column(1 + 2 * s), np.uint32)
                term, count = _numbers(part.column(2 + 2 * s), np.uint16)
                spaces.append((np.repeat(np.arange(n), count), np.repeat(np.arange(len(length)), length.astype(np.int64)), np.repeat(np.arange(n), sentences), term.astype(np.int64)))
            yield part.column(0), n, spaces


def _frequencies(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, TERMS), np.uint32)
        for _, _, spaces in _spaces(batches):
            for s, (row, _, _, term) in enumerate(spaces):
                key, _ = _counted(row * TERMS + term)
                df[s] += np.bincount(key % TERMS, minlength=TERMS).astype(np.uint32)
                df[s, -1] += len(_counted(row)[0])
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for s in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int8()), pa.array([0], pa.int64()), pa.array([task % 32], pa.int32()), pa.array([zlib.compress(df[s].tobytes(), 1)])], ["side", "h", "slot", "blob"])

    return J.merge_chunks(texts.mapInArrow(run, "side tinyint, h long, slot int, blob binary"), TERM_BITS, 2, np.uint32, np.add, texts.rdd.getNumPartitions())


def _by_area(labelled: DataFrame, areas: int) -> np.ndarray:
    """Labelled texts of each term, ``a`` being their area: (script, area, term), the last term their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, areas, TERMS), np.uint32)
        for of, _, spaces in _spaces(batches):
            a = of.to_numpy(zero_copy_only=False).astype(np.int64)
            for s, (row, _, _, term) in enumerate(spaces):
                key, _ = _counted(row * TERMS + term)
                np.add.at(count[s], (a[key // TERMS], key % TERMS), 1)
                np.add.at(count[s], (a[_counted(row)[0]], TERMS - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(count.tobytes(), 1)], pa.binary())], ["blob"])

    total = np.zeros((2, areas, TERMS), np.int64)
    for r in labelled.coalesce(8).mapInArrow(run, "blob binary").collect():  # at most 8 rows
        total += np.frombuffer(zlib.decompress(r.blob), np.uint32).reshape(total.shape)
    return total


def _sum_blocks(table: pa.Table) -> pa.Table:
    total: np.ndarray | None = None
    for blob in table.column("blob").to_pylist():
        part = np.frombuffer(blob, np.float32).astype(np.float64)
        total = part if total is None else total + part
    first = table.slice(0, 1)
    return pa.table({"s": first.column("s"), "block": first.column("block"), "slot": first.column("slot"), "blob": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _bases(rows: DataFrame, weights, lead: int, by_area: np.ndarray | None) -> list[np.ndarray]:
    """The leading right singular vectors of both term spaces, by a block power iteration over all documents.

    It starts from the areas' own directions, as far as labels show them, and random ones.
    """
    spark, w = rows.sparkSession, weights.value
    rng = np.random.default_rng(7)
    start = [rng.standard_normal((max(len(u), RANK), RANK)) for u in w.used]
    if by_area is not None:
        for s, u in enumerate(w.used):
            own = _unit(by_area[s][: RANK // 2, u] / np.maximum(1, by_area[s][: RANK // 2, -1:]) * w.idf[s][u])
            start[s][: len(u), : len(own)] += 30 * np.sqrt(len(start[s])) * own.T
    bases = [np.linalg.qr(x)[0].astype(np.float32)[: len(u)] for x, u in zip(start, w.used)]
    block = 2048
    for _ in range(POWER):
        basis = spark.sparkContext.broadcast(bases)

        def run(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            own = weights.value
            total = [np.zeros(b.shape, np.float32) for b in basis.value]
            for _, n, spaces in _spaces(batches):
                for s, (row, _, _, term) in enumerate(spaces):
                    if not len(basis.value[s]):
                        continue
                    g, p, x = own.rows(s, row, term, n)
                    y = _times(g, p, x, basis.value[s], n)
                    by = np.argsort(p, kind="stable")
                    part = _times(p[by], g[by], x[by], y, len(total[s]))
                    total[s] += part
            task = TaskContext.get().partitionId() if TaskContext.get() else 0
            for s in (0, 1):
                for at in range(0, len(total[s]), block):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([at], pa.int32()), pa.array([task % 32], pa.int32()), pa.array([total[s][at : at + block].tobytes()], pa.binary())], ["s", "block", "slot", "blob"])

        schema = "s int, block int, slot int, blob binary"
        sums = rows.mapInArrow(run, schema).groupBy("s", "block", "slot").applyInArrow(_sum_blocks, schema).groupBy("s", "block").applyInArrow(_sum_blocks, schema)
        product = [np.zeros(b.shape) for b in bases]
        for r in sums.collect():  # terms x rank numbers, whatever the data
            part = np.frombuffer(r.blob, np.float32).reshape(-1, RANK)
            product[r.s][r.block : r.block + len(part)] = part
        # in a space that A'A maps onto itself, the leading values of the product are those of its part within the space
        values = [(np.linalg.svd(p, compute_uv=False)[:lead], np.linalg.eigvalsh(b.T @ p)[::-1][:lead]) for p, b in zip(product, bases) if len(p) >= RANK]
        settled = all((v - own <= SETTLED * v).all() for v, own in values)
        bases = [np.linalg.qr(p)[0].astype(np.float32) if len(p) >= RANK else p.astype(np.float32) for p in product]
        bases = [b if b.shape[1:] == (RANK,) else np.zeros((len(b), RANK), np.float32) for b in bases]
        if settled:
            break
    return bases


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _sums(vectors: DataFrame, pick, areas: int) -> np.ndarray:
    """Sum over all rows of the vectors that ``pick`` assigns to an area: (script, area, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, areas, RANK))
        for b in batches:
            if b.num_rows:
                s = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                e = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float16).reshape(-1, RANK).astype(np.float64)
                area = pick(s, e, b.column(2))
                ok = area >= 0
                np.add.at(total, (s[ok], area[ok]), e[ok])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("blob").to_pylist())
        return pa.table({"slot": table.slice(0, 1).column("slot"), "blob": pa.array([total.tobytes()], pa.binary())})

    part = vectors.mapInArrow(run, "blob binary").select((F.spark_partition_id() % 32).alias("slot"), "blob")
    total = np.zeros(2 * areas * RANK)
    for r in part.groupBy("slot").applyInArrow(add, "slot int, blob binary").collect():  # at most 32 rows
        total += np.frombuffer(r.blob, np.float64)
    return total.reshape(2, areas, RANK)


def _nearest(e: np.ndarray, centroids: np.ndarray, clear: tuple[float, float]) -> np.ndarray:
    """The area of each vector whose cosine and lead are clear; -1 for the others."""
    cosine = e @ centroids.T
    best = cosine.argmax(axis=1)
    top = cosine[np.arange(len(e)), best]
    cosine[np.arange(len(e)), best] = -1
    second = cosine.max(axis=1) if centroids.shape[0] > 1 else np.zeros(len(e))
    return np.where((top > clear[0]) & (top - second > clear[1]), best, -1)


def _decide(count: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """Which areas a document treats, from its sentences of each area and of all."""
    areas = count.sum(axis=1, keepdims=True)
    alone = (count == 1) & (areas == 1) & (sentences[:, None] <= PASSING)
    return alone | ((count >= 2) & (count >= OF_AREAS * areas) & (count >= OF_ALL * sentences[:, None]))


def subject_areas(df: DataFrame, areas: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``area``): one row for each area a document treats.

    ``areas`` has ``area``, ``name_zh``, ``description_zh`` and ``description_en`` (a small
    table, read to the driver); ``labels`` has ``doc_id`` and ``area`` and may be wrong,
    null, repeated or missing. Documents of null, empty or junk text, and those on no
    area, have no row; repeated documents are assigned each; an empty table gives no
    rows; other columns aren't read. Without labels a first pass, by the descriptions
    and the terms that aren't common, finds some.
    """
    if labels is None:
        labels = cut(_pass(df, areas, None, id_col, text_col))
    return _pass(df, areas, labels, id_col, text_col)


def _pass(df: DataFrame, areas: DataFrame, labels: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    known = areas.where("area is not null").orderBy("area").collect()
    names = list(dict.fromkeys(r.area for r in known))
    if not names:
        return rows.where("false").select("doc_id", F.lit("").alias("area"))
    rows = rows.where("text is not null").withColumn("key", F.unhex(F.md5("text")))
    texts = numbered(rows.groupBy("key").agg(F.first("text").alias("text")).select(F.col("key").alias("a"), "text"))
    labelled = None
    if labels is not None:
        number = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
        single = labels.select(F.col("doc_id"), number[F.col("area")].alias("a")).where("doc_id is not null and a is not null").groupBy("doc_id").agg(F.min("a").alias("a"), F.max("a").alias("b")).where("a = b").select("doc_id", "a")
        chosen = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)
        labelled = numbered(rows.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.mode("a", True).alias("a")).select("a", "text"))
    by_area = None if labelled is None else _by_area(labelled, len(names))
    weights = spark.sparkContext.broadcast(Weights(_frequencies(texts), len(names), by_area))
    shared = spark.sparkContext.broadcast(_bases(texts, weights, len(names), by_area))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, n, spaces in _spaces(batches):
            for s, (row, _, _, term) in enumerate(spaces):
                e = _unit(_times(*weights.value.rows(s, row, term, n), shared.value[s], n))
                keep = np.flatnonzero(np.abs(e).sum(axis=1) > 0)
                of = a.take(pa.array(keep)) if pa.types.is_integer(a.type) else pa.nulls(len(keep), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), s, np.int32)), pa.array([x.tobytes() for x in e[keep].astype(np.float16)], pa.binary()), of], ["s", "e", "a"])

    vectors = cut(texts.mapInArrow(embed, "s int, e binary, a int"))
    seeds = np.zeros((2, len(names), RANK))
    for r in known:
        said = [K.fold("。".join(x for x in (r.name_zh, r.description_zh, r.description_en) if x))]
        for s, (row, _, term) in enumerate(terms(said)):
            seeds[s, names.index(r.area)] += _times(*weights.value.rows(s, row, term, 1), shared.value[s], 1)[0]
    centroids = _unit(seeds)
    if labelled is not None:
        sums = _sums(labelled.mapInArrow(embed, "s int, e binary, a int"), lambda s, e, a: a.to_numpy(zero_copy_only=False).astype(np.int64), len(names))
        has = np.abs(sums).sum(axis=2) > 0
        centroids[has] = _unit(sums)[has]
    for _ in range(ROUNDS):

        def clear(s: np.ndarray, e: np.ndarray, _, at=centroids) -> np.ndarray:
            out = np.full(len(s), -1)
            for k in (0, 1):
                own = s == k
                out[own] = _nearest(e[own], at[k], DOC_CLEAR)
            return out

        sums = _sums(vectors, clear, len(names))
        has = np.abs(sums).sum(axis=2) > 0
        centroids = np.where(has[:, :, None], _unit(sums), centroids)
    final = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, spaces in _spaces(batches):
            count, sentences = np.zeros((n, len(names)), np.int64), np.zeros(n, np.int64)
            for s, (_, group, owner, term) in enumerate(spaces):
                if not len(owner):
                    continue
                sentences += np.bincount(owner, minlength=n)
                e = _unit(_times(*weights.value.rows(s, group, term, len(owner)), shared.value[s], len(owner)))
                near = _nearest(e, final.value[s], SENTENCE_CLEAR)
                np.add.at(count, (owner[near >= 0], near[near >= 0]), 1)
            r, a = np.nonzero(_decide(count, sentences))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(r)), pa.array([names[k] for k in a], pa.string())], ["key", "area"])

    return rows.select("doc_id", "key").join(texts.mapInArrow(assign, "key binary, area string"), "key").select("doc_id", "area")


def composition(found: DataFrame, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of each area and their share of all documents; ``(none)`` counts those on no area."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    by = found.groupBy("area").agg(F.count(F.lit(1)).alias("documents"))
    on = found.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    none = total.join(on).select(F.lit("(none)").alias("area"), (F.col("total") - F.col("n")).alias("documents"))
    return by.unionByName(none).join(total).select("area", "documents", (F.col("documents") / F.col("total")).alias("share"))
