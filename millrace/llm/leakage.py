"""Problem 5: held-out items inside a training corpus, by block-max WAND over an index of the items."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

RUN, SHARE = 8, (2, 5)
#: Items of one index, and so of one broadcast; more items are searched in blocks.
ITEMS = 20_000
BLOCK = 32
K1, B = 1.2, 0.75

_kept: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters or numbers (categories L and N)."""
    global _kept
    if _kept is None:
        _kept = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    return _kept


def runs(texts: list[str], n: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n letters or numbers of folded texts, in text order."""
    c, at = K.codes(texts)
    keep = _letters()[c]
    row = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
    c = K.mix(c[keep].astype(np.uint64))
    if len(c) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(c) - n + 1
    h = c[:m].copy()
    for k in range(1, n):
        h = h * K._M3 + c[k : m + k]
    ok = row[:m] == row[n - 1 :]
    return h[ok], row[:m][ok]


class ItemIndex:
    """Inverted index of the runs of all questions, with BM25 impacts.

    A run's impact on an item is its BM25 weight over the least score that a text
    with the needed share of the item's runs can reach (the sum of its smallest
    weights). So one threshold, 1, fits all items, and what scores less can't
    hold enough of the item: retrieval loses nothing, and the count decides.
    Postings are by run, items ascending, in blocks with their largest impact.
    """

    def __init__(self, ids: list[str], questions: list[str | None], answers: list[str | None], share: tuple[int, int] = SHARE):
        self.ids, self.share = ids, share
        h, item = runs([K.fold(q) for q in questions])
        length = np.bincount(item, minlength=len(ids))
        by = np.lexsort((item, h))
        h, item = h[by], item[by]
        new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (item[1:] != item[:-1])])
        start = np.flatnonzero(new)
        tf = np.diff(np.append(start, len(h)))
        h, item = h[start], item[start]
        self.distinct = np.bincount(item, minlength=len(ids))
        self.terms, first, df = np.unique(h, return_index=True, return_counts=True)
        self.first = np.append(first, len(h))
        idf = np.log(1 + (len(ids) - df + 0.5) / (df + 0.5))
        mean = length[length > 0].mean() if (length > 0).any() else 1.0
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        need = -(-share[0] * self.distinct // share[1])
        order = np.lexsort((weight, item))
        place = np.arange(len(item)) - np.repeat(np.cumsum(self.distinct) - self.distinct, self.distinct)
        least = np.bincount(item[order], weights=np.where(place < np.repeat(need, self.distinct), weight[order], 0.0), minlength=len(ids))
        self.item, self.impact = item, weight / np.maximum(least[item], 1e-300) * (1 + 1e-9)
        self.best = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.terms >> np.uint64(42)).astype(np.int64)] = True
        a, owner = runs([K.fold(x) for x in answers])
        pair = np.unique(np.stack([owner.astype(np.uint64), a], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        cuts = np.searchsorted(pair[:, 0], np.arange(len(ids) + 1).astype(np.uint64))
        self.answers = [pair[cuts[i] : cuts[i + 1], 1] for i in range(len(ids))]
        self._lists: dict[int, tuple] = {}

    def _list(self, term: int) -> tuple[list[int], list[float], float, list[float]]:
        got = self._lists.get(term)
        if got is None:
            a, b = self.first[term], self.first[term + 1]
            impact = self.impact[a:b].tolist()
            got = self._lists[term] = (self.item[a:b].tolist(), impact, max(impact), [max(impact[k : k + BLOCK]) for k in range(0, len(impact), BLOCK)])
        return got

    def _held(self, terms: np.ndarray, items: list[int]) -> dict[int, int]:
        """How many of the terms each of the retrieved items has, by a search in each posting list."""
        count = dict.fromkeys(items, 0)
        for t in terms.tolist():
            docs = self._list(t)[0]
            for i in items:
                at = bisect_left(docs, i)
                count[i] += at < len(docs) and docs[at] == i
        return count

    def wand(self, terms: list[int]) -> list[int]:
        """Items whose impacts over ``terms`` sum to 1 or more, ascending."""
        cursors = [[lst[0][0], 0, lst] for lst in map(self._list, terms)]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2][2]
                if bound >= 1:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the bounds of the blocks that hold the target
            bound, edge = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                docs, at = c[2][0], bisect_left(c[2][0], target, c[1])
                block = at // BLOCK
                if block < len(c[2][3]):
                    bound += c[2][3][block]
                    last = docs[min(len(docs), (block + 1) * BLOCK) - 1]
                    edge = min(edge, last + 1)
            if bound < 1:  # no item before the end of these blocks can reach 1
                goal = max(edge, target + 1)
            elif cursors[0][0] == target:
                score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                if score >= 1:
                    found.append(target)
                goal = target + 1
            else:
                goal = target
            rest = []
            for i, c in enumerate(cursors):
                if i <= pivot and c[0] < goal:
                    c[1] = bisect_left(c[2][0], goal, c[1])
                    if c[1] == len(c[2][0]):
                        continue
                    c[0] = c[2][0][c[1]]
                rest.append(c)
            cursors = rest
        return found

    def search(self, texts: list[str | None]) -> tuple[list[int], list[int], list[float], list[float]]:
        """(row, item, share of the question's runs, share of the answer's) of every leak."""
        folded = [K.fold(t) for t in texts]
        h, row = runs(folded)
        near = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)]) if len(self.terms) else np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, h[near])
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == h[near][hit]
        key = np.unique(row[near[hit]] * (1 << 32) + at[hit])
        who, term = key >> 32, key & 0xFFFFFFFF
        out = ([], [], [], [])
        if not len(key):
            return out
        edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        bound = np.add.reduceat(self.best[term], edge[:-1])
        for k in np.flatnonzero(bound >= 1):
            terms = term[edge[k] : edge[k + 1]]
            r = int(who[edge[k]])
            items = self.wand(terms.tolist())
            if not items:
                continue
            count = self._held(terms, items)
            own = None
            for i in items:
                if count[i] * self.share[1] >= self.share[0] * self.distinct[i] > 0:
                    if own is None:
                        own = np.unique(runs([folded[r]])[0])
                    answer = self.answers[i]
                    out[0].append(r)
                    out[1].append(i)
                    out[2].append(float(count[i] / self.distinct[i]))
                    out[3].append(float(np.isin(answer, own).mean()) if len(answer) else 0.0)
        return out


def leaks(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str = "id", question: str = "question", answer: str = "reference_answer", share: tuple[int, int] = SHARE) -> DataFrame:
    """(``row_id``, ``item_id``, ``question_share``, ``answer_share``): each text with the items that leaked into it.

    An item leaked if the text holds at least ``share`` of the distinct runs of eight
    letters or numbers of its question, after NFKC and lower case; ``answer_share`` is the
    share of its answer's runs that the text holds as well. The items are
    broadcast as an index of at most 20,000; more are searched in blocks, each over
    all texts. Items of null or too short questions never leak; null, empty and short
    texts hold nothing; repeated rows are reported each; a repeated item id is
    reported once per row if any of its questions leaked; empty tables give no rows.
    """
    return _search(df.select(F.lit("").alias("table_name"), df[id_col].alias("row_id"), df[text_col].cast("string").alias("text")), items, item_id, question, answer, share).drop("table_name")


def _search(rows: DataFrame, items: DataFrame, item_id: str, question: str, answer: str, share: tuple[int, int]) -> DataFrame:
    """``leaks`` of rows (table_name, row_id, text) of any number of tables; an index is built once for all of them."""
    kind = rows.schema["row_id"].dataType.simpleString()
    known = items.select(items[item_id].cast("string").alias("i"), items[question].cast("string").alias("q"), items[answer].cast("string").alias("a")).where("i is not null and q is not null")
    blocks = -(-known.count() // ITEMS)
    out = None
    for b in range(max(1, blocks)):
        part = known if blocks <= 1 else known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        got = part.collect()  # a block of bounded size
        index = rows.sparkSession.sparkContext.broadcast(ItemIndex([r.i for r in got], [r.q for r in got], [r.a for r in got], share))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    piece = batch.slice(at, 2000)
                    r, i, q, a = index.value.search(piece.column(2).to_pylist())
                    best: dict = {}  # an id that stands twice counts once, by its best question
                    for k in range(len(r)):
                        key = (r[k], index.value.ids[i[k]])
                        if key not in best or q[k] > q[best[key]]:
                            best[key] = k
                    r, i, q, a = ([x[k] for k in best.values()] for x in (r, i, q, a))
                    if r:
                        at_ = pa.array(r, pa.int32())
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(at_), piece.column(1).take(at_), pa.array([index.value.ids[k] for k in i], pa.string()), pa.array(q, pa.float64()), pa.array(a, pa.float64())], ["table_name", "row_id", "item_id", "question_share", "answer_share"])

        found = rows.mapInArrow(run, f"table_name string, row_id {kind}, item_id string, question_share double, answer_share double")
        out = found if out is None else out.unionByName(found)
    return out


def leak_rows(tables: list[tuple[str, DataFrame, str, str]], items: DataFrame) -> DataFrame:
    """Leaks of several (name, table, id column, text column), with their ``table_name``."""
    rows = None
    for name, df, id_col, text_col in tables:
        one = df.select(F.lit(name).alias("table_name"), df[id_col].cast("long").alias("row_id"), df[text_col].cast("string").alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return _search(rows, items, "id", "question", "reference_answer", SHARE)


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return leak_rows([("decon_review_queue", at("decon_review_queue"), "entry_id", "instruction"), ("documents", at("documents"), "doc_id", "text")], at("gold_items"))
