"""Problem 8: filling containers of fixed capacity, by linear grouping.

Everything that must be decided depends only on how many items there are of each
size, and sizes are integers up to the capacity: the whole plan is made from that
histogram, a table bounded by the capacity whatever the number of items. Items then
find their container by their rank among those of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .encoding import VOCABULARY, token_counts

#: Items from an eighth of the capacity on are large; their lengths form so many groups.
SMALL_SHARE = 8
GROUPS = 96
#: Items of one size ranked in one task.
RANKED = 2_000_000


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum over multisets of few sizes, by column generation.

    The basis starts with containers of one size; each round the knapsack with the
    dual prices as values gives the best new configuration, until none is worth
    more than one container.
    """
    k = len(sizes)
    per = np.maximum(1, capacity // sizes)
    columns = np.diag(per).astype(float)
    inverse = np.diag(1.0 / per)
    x = demand / per
    most = int(capacity // sizes.min())
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        picks = []
        for _ in range(most):
            new, pick = best.copy(), np.full(capacity + 1, -1)
            for i in range(k):
                gain = best[: capacity + 1 - sizes[i]] + price[i]
                part = new[sizes[i] :]
                better = gain > part + 1e-12
                part[better] = gain[better]
                pick[sizes[i] :][better] = i
            picks.append(pick)
            if not (pick >= 0).any():
                break
            best = new
        if best[capacity] <= 1 + 1e-6:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            i = pick[room]
            if i >= 0:
                column[i] += 1
                room -= sizes[i]
        direction = inverse @ column
        ratio = np.where(direction > 1e-12, x / np.where(direction > 1e-12, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        if not np.isfinite(step):
            break
        x = x - step * direction
        x[out] = step
        x = np.maximum(x, 0)
        columns[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return [(columns[:, i].astype(int), float(x[i])) for i in range(k) if x[i] >= 1]


class _Fill:
    """Runs of alike containers by room left; best fit moves or splits a run."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room, self.done, self.total = capacity, [], {}, [], 0

    def add(self, first: int, copies: int, content: tuple, room: int) -> None:
        if room <= 0:
            self.done.append((first, copies, content))
            return
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((first, copies, content))

    def open(self, copies: int, content: tuple) -> None:
        self.add(self.total, copies, content, self.capacity - sum(content))
        self.total += copies

    def put(self, size: int, count: int) -> None:
        """Each of ``count`` items goes to the container with the least room that holds it."""
        while count:
            at = bisect_left(self.rooms, size)
            if at == len(self.rooms):
                each = self.capacity // size
                full, rest = divmod(count, each)
                if full:
                    self.open(full, (size,) * each)
                if rest:
                    self.open(1, (size,) * rest)
                return
            room = self.rooms[at]
            runs = self.by_room[room]
            first, copies, content = runs.pop()
            if not runs:
                del self.by_room[room]
                self.rooms.pop(at)
            used = min(copies, count)
            if used < copies:
                self.add(first + used, copies - used, content, room)
            self.add(first, used, (*content, size), room - size)
            count -= used

    def runs(self) -> list[tuple[int, int, tuple]]:
        return sorted(self.done + [r for runs in self.by_room.values() for r in runs])


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, int, tuple[int, ...]]]:
    """Runs (first container, number of containers, sizes in each) that hold every item once.

    1. Large sizes, longest first, are cut into groups of equal cardinality and
       rounded up to the longest of their group.
    2. The configurations of the few rounded sizes are optimised fractionally and
       used a whole number of times.
    3. The actual items replace the rounded ones, longest first within a group.
    4. What is left over, and then the small items, go best fit into the room left.
    """
    fill = _Fill(capacity)
    left = {s: c for s, c in histogram.items() if s > 0 and c > 0}
    if any(s > capacity for s in left):
        raise ValueError("an item exceeds the capacity")
    large = sorted((s for s in left if s * SMALL_SHARE >= capacity), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        k = min(groups, len(large))
        queues: list[list[list[int]]] = [[] for _ in range(k)]
        seen = 0
        for s in large:
            c = left[s]
            while c:
                g = min(k - 1, seen * k // total)
                edge = -(-(g + 1) * total // k) if g < k - 1 else total
                take = min(c, max(1, edge - seen))
                queues[g].append([s, take])
                seen, c = seen + take, c - take
        queues = [q for q in queues if q]
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(c for _, c in q) for q in queues], float)
        for column, uses in _configurations(sizes, demand, capacity):
            slots = [g for g in range(len(queues)) for _ in range(column[g])]
            need = {g: int(column[g]) for g in slots}
            copies = min([int(uses + 1e-6), *(sum(c for _, c in queues[g]) // n for g, n in need.items())])
            while copies > 0:
                # as far as every slot keeps one actual size
                length, content, taken = copies, [], {}
                for g in slots:
                    at = taken.get(g, 0)
                    content.append((g, at))
                    taken[g] = at + 1
                heads = []
                for g, n in need.items():
                    s, c = queues[g][0]
                    step = c // n
                    if step:
                        length = min(length, step)
                        heads += [(g, s)] * n
                    else:  # the run ends within one container
                        length, rest, own = 1, n, []
                        for s, c in queues[g]:
                            own += [(g, s)] * min(c, rest)
                            rest -= min(c, rest)
                            if not rest:
                                break
                        heads += own
                for g, s in heads:
                    q = next(q for q in queues[g] if q[0] == s)
                    q[1] -= length
                for g in need:
                    queues[g] = [q for q in queues[g] if q[1] > 0]
                fill.open(length, tuple(s for _, s in heads))
                copies -= length
        for s in large:
            left[s] = 0
        for q in queues:
            for s, c in q:
                left[s] += c
    for s in sorted(left, reverse=True):
        if left[s]:
            fill.put(s, left[s])
    return fill.runs()


def _places(runs: list[tuple[int, int, tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (size, first rank, length, first container) sorted by size and rank."""
    used: dict[int, int] = {}
    rows = []
    for first, copies, content in runs:
        for s in content:
            at = used.get(s, 0)
            rows.append((s, at, copies, first))
            used[s] = at + copies
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(df: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = 2048) -> DataFrame:
    """(``doc_id``, ``piece``, ``first``, ``tokens``, ``container``): where every item lies.

    An item above the capacity is cut into full containers and a rest; no other is
    cut. ``first`` is the place of the piece within its item. Items of null, zero or
    negative size take no container and have no row; rows of one id repeated are
    items of their own; an empty table gives no rows. Containers are numbered from
    0 on. The ranks are made in hashed parts of each size, so a size that holds a
    third of all items is ranked by many tasks.
    """
    kind = df.schema[id_col].dataType.simpleString()
    pieces = F.expr(f"transform(sequence(0L, cast((n - 1) div {capacity} as bigint)), k -> struct(cast(k as int) as piece, k * {capacity} as first, cast(least(n - k * {capacity}, {capacity}) as int) as tokens))")
    items = cut(df.select(df[id_col].alias("doc_id"), df[size_col].cast("long").alias("n")).where("n > 0").select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*"))
    counts = {r.tokens: r["count"] for r in items.groupBy("tokens").count().collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    places = df.sparkSession.sparkContext.broadcast(_places(runs))
    parts = max(1, -(-max(counts.values(), default=1) // RANKED))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "part").orderBy("doc_id", "piece")) - 1)
    if parts > 1:
        before = items.groupBy("tokens", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("tokens").orderBy("part")) - F.col("count")).drop("count")
        ranked = ranked.join(before, ["tokens", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, _, first = places.value
        key = size << 40 | low
        for batch in batches:
            tokens, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            at = np.searchsorted(key, tokens << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first[at] + rank - low[at])], ["doc_id", "piece", "first", "tokens", "container"])

    return ranked.select("doc_id", "piece", "first", "tokens", F.col("rank").cast("long")).mapInArrow(place, f"doc_id {kind}, piece int, first long, tokens int, container long")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents by the token counts of their texts; see :func:`pack`."""
    return pack(token_counts(df, id_col, text_col, vocabulary), "doc_id", "tokens", capacity)
