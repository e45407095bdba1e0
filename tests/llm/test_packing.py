import random
from collections import Counter

import pytest

from millrace.llm import packing as P


def check(histogram, capacity):
    runs = P.plan(histogram, capacity)
    held = Counter()
    number = 0
    for first, copies, content in runs:
        assert first == number and copies > 0 and content and sum(content) <= capacity
        number += copies
        for s in content:
            held[s] += copies
    assert held == Counter({s: c for s, c in histogram.items() if s > 0 and c > 0})
    return number


def test_every_item_once_and_little_waste():
    r = random.Random(5)
    h = Counter(r.choice([r.randint(1, 200), r.randint(200, 900), r.randint(900, 2048)]) for _ in range(20_000))
    n = check(h, 2048)
    assert n <= 1.02 * -(-sum(s * c for s, c in h.items()) // 2048)


@pytest.mark.parametrize("h", [{}, {0: 5}, {2048: 3}, {1: 1}, {1025: 7}, {1024: 7, 1: 1}, {300: 1_000_000, 2047: 500_000, 1: 3}])
def test_small_and_hot_histograms(h):
    check(h, 2048)


def test_an_item_above_the_capacity_is_refused():
    with pytest.raises(ValueError):
        P.plan({2049: 1}, 2048)


def test_pack(spark):
    rows = [(1, 5000), (2, 100), (3, 2048), (4, 0), (5, None), (6, 1900), (7, 48), (7, 48), (8, -3)]
    df = spark.createDataFrame(rows, "doc_id long, tokens int")
    got = P.pack(df).collect()
    assert sorted((r.piece, r.first, r.tokens) for r in got if r.doc_id == 1) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert Counter(r.doc_id for r in got) == {1: 3, 2: 1, 3: 1, 6: 1, 7: 2}
    size = Counter()
    for r in got:
        size[r.container] += r.tokens
    assert max(size.values()) <= 2048 and sorted(size) == list(range(len(size)))
    assert P.pack(df.where("false")).count() == 0


def test_ranks_in_hashed_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)
    got = P.pack(spark.range(1000).selectExpr("id as doc_id", "cast(700 + id % 3 as int) as tokens")).collect()
    size = Counter()
    for r in got:
        size[r.container] += r.tokens
    assert len(got) == 1000 and max(size.values()) <= 2048 and len(size) <= 510
