"""Problem 1: cutting oversized texts into overlapping pieces at natural boundaries.

A text is worked on in ranges of fixed length with a halo on both sides. Every range
ends at a cut that its own characters decide (the best boundary near its end); the
next range finds the same cut in its left halo. Between these cuts pieces are filled
one after the other. Ranges thus never wait for each other; each gives a table of its
cuts, the tables are stitched by prefix sums, and pieces are emitted by offset.

Texts of a table lie in one row, hence one task: its ranges are worked on there, one
after the other, in time proportional to the text and without a shuffle. Files are
read by byte ranges, in as many tasks as there are ranges, and never as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from ..shared import cut

LIMIT, OVERLAP = 2048, 128
#: Characters of a text in one range; bytes of a file in one range.
RANGE, FILE_RANGE = 1 << 18, 4 << 20
#: Padding that doesn't count towards the size: space, tab, CR, LF and U+3000 (fixed values).
PADDING = " \t\r\n　"
_SENTENCE, _CLAUSE, _CLOSERS = "。！？!?；;…", "，,、：:", "”’」』）)】]》\"'"

_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """What a character is: 1 clause mark or space, 2 sentence mark, 3 line end, 4 closer, 5 full stop, 6 joins the one before."""
    global _kinds
    if _kinds is None:
        table = np.zeros(0x110000, np.uint8)
        for chars, kind in ((_CLAUSE + " \t　", 1), (_SENTENCE, 2), ("\n\r  \f", 3), (_CLOSERS, 4), (".", 5)):
            for c in chars:
                table[ord(c)] = kind
        for c in (*range(0x300, 0x370), *range(0xFE00, 0xFE10), *range(0x1F3FB, 0x1F400), *range(0xE0100, 0xE01F0), 0x200D):
            table[c] = 6
        _kinds = table
    return _kinds


def boundaries(text: str) -> np.ndarray:
    """Strength of a cut before each character and at the end: 0 none, 1 clause, 2 sentence, 3 line, 4 paragraph; 255 never."""
    c, _ = K.codes([text])
    c = c[:-1]
    n = len(c)
    kind = _kind_table()[c]
    out = np.zeros(n + 1, np.uint8)
    if not n:
        return out
    after = np.where(kind <= 3, kind, 0)
    space = np.append((kind[1:] == 1) | (kind[1:] == 3), True)
    after[(kind == 5) & space] = 2
    out[1:] = after
    for _ in range(3):  # closing marks stay with their sentence
        move = np.flatnonzero((out[1:-1] == 2) & (kind[1:] == 4)) + 1
        if not len(move):
            break
        out[move + 1] = 2
        out[move] = 0
    line = np.flatnonzero(kind == 3)
    if len(line):  # in a run of line ends only its end is a place to cut, a paragraph's if lines are blank
        new = np.concatenate([[True], line[1:] != line[:-1] + 1])
        begin, end = line[new], line[np.append(np.flatnonzero(new)[1:] - 1, len(line) - 1)]
        broken = np.concatenate([[0], np.cumsum((kind == 3) & ~((c == 13) & np.append(c[1:] == 10, False)))])
        out[line[~np.isin(line, end)] + 1] = 255
        out[end + 1] = np.where(broken[end + 1] - broken[begin] > 1, 4, 3)
    joined = np.flatnonzero(kind == 6)
    out[joined] = 255
    zwj = np.flatnonzero(c == 0x200D) + 1
    out[zwj] = 255
    return out


def best_cut(strength: np.ndarray, low: int, high: int) -> int:
    """The place in (low, high] to cut at: the last of the strongest boundaries.

    Lines and paragraphs, then sentences, in the later half; else the last sentence
    of the first half; else a clause; else ``high``, moved back to where a character
    isn't torn from what joins it. The end of a text is always a boundary to the caller.
    """
    s = strength[low + 1 : high + 1]
    half = len(s) // 2
    for least, begin in ((3, half), (2, half), (2, 0), (1, 0)):
        at = np.flatnonzero((s[begin:] >= least) & (s[begin:] < 255))
        if len(at):
            return low + 1 + begin + int(at[-1])
    at = np.flatnonzero(s < 255)
    return low + 1 + int(at[-1]) if len(at) else high


class _Range:
    """The cuts of one range, in offsets of the chunk it comes in (range and halos)."""

    def __init__(self, text: str, begin: int, end: int, is_first: bool, is_last: bool, limit: int, overlap: int):
        self.strength = boundaries(text)
        fresh = limit - overlap
        self.start = 0 if is_first else best_cut(self.strength, max(0, begin - fresh), begin)
        self.stop = len(text) if is_last else best_cut(self.strength, max(0, end - fresh, self.start), end)
        self.cuts, at = [self.start], self.start
        while at < self.stop:
            first = is_first and at == 0
            room = limit if first else fresh
            at = self.stop if self.stop - at <= room else best_cut(self.strength, at + (overlap if first else 0), at + room)
            self.cuts.append(at)


def _cuts(chunk: str, offset: int, begin: int, end: int, is_first: bool, is_last: bool, limit: int, overlap: int) -> np.ndarray:
    """The table of a range: the offsets in the whole text at which its pieces end, after the one it starts from."""
    return offset + np.array(_Range(chunk, begin, end, is_first, is_last, limit, overlap).cuts, np.int64)


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces of a text: the tables of its ranges, stitched."""
    tables = []
    for r in range(max(1, -(-len(text) // range_chars))):
        begin, end = r * range_chars, min((r + 1) * range_chars, len(text))
        low, high = max(0, begin - limit), min(len(text), end + limit)
        tables.append(_cuts(text[low:high], low, begin - low, end - low, r == 0, end == len(text), limit, overlap))
    end = np.concatenate([t[1:] for t in tables])
    start = np.concatenate([t[:-1] for t in tables])
    return np.where(start > 0, start - overlap, 0), end


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ("heading", "page_num"), limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> DataFrame:
    """Pieces of every text of more than ``limit`` characters without its outer padding.

    Gives ``id``, the ``keep`` columns, ``piece`` (from 0), ``start`` and ``end`` (places in
    the text) and ``piece_text``. A piece has at most ``limit`` characters, begins with the
    last ``overlap`` characters of the piece before it, and ends at a boundary if its
    stretch has one; the pieces without their overlaps are the text, its padding
    included. Texts at or below the limit, null and empty ones have no row here. Rows
    that repeat, also under one id, are cut each on its own; null ids and null kept
    values stay null; other columns aren't read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    if range_chars < 2 * limit:
        raise ValueError("a range must hold two pieces")
    names = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(df[text_col].cast("string").alias("_text"), df[id_col].alias("_id"), *(df[c].alias(n) for c, n in zip(keep, names)))
    rows = rows.where(F.length(F.btrim("_text", F.lit(PADDING))) > limit)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"_id {fields['_id']}, {''.join(f'{n} {fields[n]}, ' for n in names)}piece int, start long, end long, piece_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py()
                start, end = pieces_of(text, limit, overlap, range_chars)
                for at in range(0, len(end), 4000):
                    a, b = start[at : at + 4000], end[at : at + 4000]
                    head = [batch.column(k).take(pa.array(np.full(len(a), i))) for k in range(1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(at, at + len(a), dtype=np.int32)), pa.array(a), pa.array(b), pa.array([text[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.string())], ["_id", *names, "piece", "start", "end", "piece_text"])

    return rows.mapInArrow(run, schema).select(F.col("_id").alias("id"), *(F.col(n).alias(c) for n, c in zip(names, keep)), "piece", "start", "end", "piece_text")


def rejoined(pieces: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(``id``, ``chars``, ``digest``, ``longest``, ``broken``) of each text put together again from its pieces.

    ``broken`` counts pieces that don't begin with the last ``overlap`` characters of the
    one before. Ids must be unique; a text's pieces meet in one group.
    """
    part = F.array_sort(F.collect_list(F.struct("piece", "piece_text")))
    whole = pieces.groupBy("id").agg(part.alias("p"), F.max(F.length("piece_text")).alias("longest"))
    fresh = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece_text"]).otherwise(F.substr(x["piece_text"], F.lit(overlap + 1)))), "")
    before = lambda x, i: F.right(F.col("p")[i - 1]["piece_text"], F.lit(overlap)) if overlap else F.lit("")
    bad = F.size(F.filter(F.transform("p", lambda x, i: (i > 0) & ~F.startswith(x["piece_text"], before(x, i))), lambda b: b))
    return whole.select("id", F.length(fresh).cast("long").alias("chars"), F.md5(fresh).alias("digest"), F.col("longest").cast("long"), bad.cast("long").alias("broken"))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = FILE_RANGE) -> DataFrame:
    """Pieces of whole UTF-8 text files, read by byte ranges: ``path``, ``piece``, ``start``, ``end``, ``piece_text``.

    A task reads its range and two halos of ``4 * limit`` bytes by offset and no more,
    whatever the file's size; ``start`` and ``end`` count characters of the file. Sizes
    come from Spark's own listing, ranges through Arrow's file systems, so the paths may
    be of any that both know. Malformed bytes become U+FFFD; an empty file has no piece.
    """
    halo = 4 * limit
    sizes = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    ranges = sizes.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {range_bytes})")).alias("r")).repartition("path", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                r, size = row["r"], row["size"]
                lo, hi = max(0, r * range_bytes - halo), min(size, (r + 1) * range_bytes + halo)
                fs, at = FileSystem.from_uri(row["path"].replace("file:/", "file:///", 1) if row["path"].startswith("file:/") and not row["path"].startswith("file:///") else row["path"])
                with fs.open_input_file(at) as f:
                    f.seek(lo)
                    data = f.read(hi - lo)
                # the first byte that begins a character; within malformed bytes, the place itself
                edge = lambda k: next((x for x in range(k, k + 4) if x >= len(data) or data[x] & 0xC0 != 0x80), k)
                a, b, e = edge(0) if lo else 0, edge(r * range_bytes - lo), edge(min(size, (r + 1) * range_bytes) - lo)
                left, own, right = (data[x:y].decode("utf-8", "replace") for x, y in ((a, b), (b, e), (e, len(data))))
                if hi < size:
                    right = right[:-1]  # may end within a character
                chunk = left + own + right
                cuts = _cuts(chunk, 0, len(left), len(left) + len(own), r == 0, hi == size and (r + 1) * range_bytes >= size, limit, overlap)
                start, end = np.where(cuts[:-1] > 0, np.maximum(0, cuts[:-1] - overlap), 0), cuts[1:]
                n = len(end)
                text = [chunk[x:y] for x, y in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * n, pa.string()), pa.array([r] * n, pa.int64()), pa.array([len(own)] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(start - len(left)), pa.array(end - len(left)), pa.array(text, pa.string())], ["path", "r", "own", "no", "start", "end", "piece_text"])

    pieces = cut(ranges.select("path", "size", "r").mapInArrow(run, "path string, r long, own long, no int, start long, end long, piece_text string"))
    sums = pieces.groupBy("path", "r").agg(F.max("own").alias("own"), (F.max("no") + 1).alias("n"))
    w = Window.partitionBy("path").orderBy("r")
    base = sums.select("path", "r", (F.sum("own").over(w) - F.col("own")).alias("chars"), (F.sum("n").over(w) - F.col("n")).alias("pieces"))
    return pieces.join(base, ["path", "r"]).select("path", (F.col("no") + F.col("pieces")).cast("int").alias("piece"), (F.col("start") + F.col("chars")).alias("start"), (F.col("end") + F.col("chars")).alias("end"), "piece_text")
