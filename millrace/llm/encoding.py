"""Problem 7: token ids of a corpus by a public byte-level BPE, with a rank queue.

Merges are taken from a queue of *ranks*, not of pairs. The bucket of a rank holds
the list positions whose pair has that rank; a bitmap of three levels (64-way)
marks the buckets that aren't empty, and find-first-set in each level gives the next
rank. Positions form a doubly linked list over all new pre-tokens of a batch at
once, with breaks between pre-tokens, so the queue runs once per batch and every
step merges all places of one rank by array operations. An entry whose place has
meanwhile got another pair is stale and skipped when its bucket is opened. A merge
can only create pairs of higher rank, so the queue never goes back: the work for n
bytes is O(n log) whatever the length of a pre-token, where pairwise rescanning is
quadratic in it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Split of text before the merges, as the vocabulary's README gives it (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Bytes of new pre-tokens merged at once, and ids kept for pre-tokens already seen.
CHUNK_BYTES = 4 << 20
KEPT_IDS = 8 << 20


def _byte_letters() -> list[str]:
    """The printable letter by which such vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        by = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[by], positions[by]
        edge = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], edge])].tolist(), np.split(positions, edge) if len(edge) else [positions]):
            if rank in self.buckets:
                self.buckets[rank].append(part)
                continue
            self.buckets[rank] = [part]
            a, b = rank >> 6, rank >> 12
            self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
            self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
            self.top |= 1 << b

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank that has entries, and its positions; None at the end."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = b << 6 | (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = a << 6 | (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


class Encoder:
    """A byte-level BPE of a ``tokenizers`` file; ids of pre-tokens are kept up to a bound."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.twin = left == right
        self.none = len(pairs)
        key = left << 17 | right
        by = np.argsort(key)
        self.keys, self.ranks = np.append(key[by], 1 << 60), np.append(by, self.none).astype(np.int32)
        self.first = np.array([vocab[c] for c in _byte_letters()], np.int32)
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 17 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        gap = 1 << 16  # a token that is in no pair
        data = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
        tok = self.first[data]
        tok[ends] = gap
        n = len(tok)
        tok = np.append(tok, np.int32(gap))
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[n] = n
        rank = np.append(self._rank(tok[:-1], tok[1:]), np.int32(self.none)).astype(np.int32)
        queue, dead = RankQueue(), np.int32(self.none + 1)
        some = np.flatnonzero(rank < self.none).astype(np.int32)
        if len(some):
            queue.push(rank[some], some)
        while (entry := queue.pop()) is not None:
            r, at = entry
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                if self.twin[r]:  # aaa: the left pair goes first, its right half is gone
                    linked = np.concatenate([[False], at[1:] == nxt[at[:-1]]])
                    place = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(linked, 0, place))
                    at = at[(place - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = self.new[r]
            rank[gone] = dead
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            touched = np.concatenate([at, before[before >= 0]])
            now = self._rank(tok[touched], tok[nxt[touched]])
            rank[touched] = now
            live = now < self.none
            if live.any():
                queue.push(now[live], touched[live])
        kept = rank[:n] != dead
        kept[ends] = False
        count = np.add.reduceat(kept, np.concatenate([[0], ends[:-1]])).astype(np.int64)
        return tok[:n][kept], count

    def _learn(self, words: list[str]) -> None:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, sizes, at = [self.pool], [self.size], 0
        while at < len(data):
            end, total = at, 0
            while end < len(data) and (total < CHUNK_BYTES or end == at):
                total += len(data[end])
                end += 1
            got, count = self.merge(data[at:end])
            ids.append(got)
            sizes.append(count)
            at = end
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words))))
        self.pool, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size

    def _known(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of every pre-token, number of pre-tokens of each text)."""
        if len(self.pool) > KEPT_IDS:
            self.forget()
        words = [self.split(t) if t else [] for t in texts]
        count = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        index = self.index
        new = [w for w in dict.fromkeys(flat) if w not in index]
        if new:
            self._learn(new)
        return np.fromiter(map(index.__getitem__, flat), np.int64, len(flat)), count

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        word, count = self._known(texts)
        total = np.concatenate([[0], np.cumsum(self.size[word])])
        end = np.cumsum(count)
        return total[end] - total[end - count]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); null and empty texts have none."""
        word, count = self._known(texts)
        size = self.size[word]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.begin[word] - (ends - size), size)
        per_text = np.concatenate([[0], np.cumsum(count)])
        return self.pool[source], np.concatenate([[0], ends])[per_text]


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(batches: Iterator[pa.RecordBatch], limit: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``limit`` bytes of text, or one row."""
    for batch in batches:
        text = batch.column(1)
        size = np.cumsum(np.fromiter((len(t) if t else 0 for t in text.to_pylist()), np.int64, batch.num_rows)) if batch.nbytes > limit else None
        at = 0
        while at < batch.num_rows:
            end = batch.num_rows if size is None else max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit // 3, side="right")))
            yield batch.slice(at, end - at)
            at = end


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``ids``): the ids of each row's text, without special tokens.

    One pass, no shuffle, rows in and out of Arrow batches. Null and empty texts
    have an empty list, never null; strings that look like special tokens are
    ordinary text; repeated rows stay; other columns aren't read; an empty table
    gives an empty result. Every executor reads ``vocabulary``.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in _pieces(batches):
            ids, offsets = enc.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``tokens``): how many ids each text has; 0 for null and empty texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.sizes(batch.column(1).to_pylist()).astype(np.int32))], ["doc_id", "tokens"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, tokens int")
