import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.llm import cross_split, near_dup
from millrace.llm import kernels as K
from millrace.llm import setjoin as J


def tokens(x):
    return re.findall("[a-z0-9]+|[一-鿿]", unicodedata.normalize("NFKC", x or "").lower())


def grams(x):
    t = tokens(x)
    return frozenset(zip(t, t[1:], t[2:]))


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(n, seed=1):
    """Texts with shared phrases, edits, reordered parts, copies and junk."""
    r = random.Random(seed)
    words = [f"词{i}语" for i in range(40)] + [f"w{i}" for i in range(60)]
    base = ["".join(r.choice(words) + r.choice(["", "，", " "]) for _ in range(r.randint(3, 25))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        t = r.choice(base)
        k = r.randint(0, 4)
        if k == 0:
            i = r.randrange(len(t) + 1)
            t = t[:i] + r.choice(words) + t[i:]
        elif k == 1:
            i = r.randrange(len(t) + 1)
            t = t[i:] + t[:i]
        elif k == 2:
            t = t.upper().replace("，", "、")
        elif k == 3:
            t = "".join(c for c in t if r.random() > 0.05)
        out.append(t)
    return out


@pytest.fixture
def rows(edge_texts):
    r = random.Random(9)
    texts = [*edge_texts, *corpus(250)]
    return [(i, t, r.choice(["train", "train", "validation", "test", None, "TEST "]), "clash") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id long, instruction string, split string, h string").repartition(3)


def pairs(rows, t):
    g = [grams(r[1]) for r in rows]
    return {(i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if similarity(g[i], g[j]) >= t}


@pytest.mark.parametrize("hot", [20_000, 4])
def test_near_duplicates_equal_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(J, "HOT", hot)
    got = [tuple(r) for r in near_dup.near_duplicate_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs(rows, 0.7)


def test_groups_are_components(spark, rows):
    want = pairs(rows, 0.7)
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.record_id: r for r in near_dup.near_duplicate_groups(frame(spark, rows)).collect()}
    usable = {i for i, r in enumerate(rows) if grams(r[1])}
    assert set(got) == usable
    assert all(got[i].group_id == find(i) for i in usable)
    g = [grams(r[1]) for r in rows]
    for i in usable:
        assert got[i].copies == sum(g[i] == x for x in g)
        assert got[i].links == len({g[j] for j in usable if g[j] != g[i] and similarity(g[i], g[j]) >= 0.7})


@pytest.mark.parametrize("hot", [20_000, 4])
def test_cross_split_equals_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(J, "HOT", hot)
    side = {"train": 0, "validation": 1, "test": 1}
    s = [side.get((r[2] or "").strip().lower()) for r in rows]
    want = {(i, j) for i, j in pairs(rows, 0.5) if {s[i], s[j]} == {0, 1}}
    df = frame(spark, rows)
    found = cross_split.cross_split_pairs(df)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hits = {r.id: r.n for r in cross_split.counterparts(df).collect()}
    assert hits == {i: n for i in range(len(rows)) if s[i] == 1 and (n := sum(i in p for p in want))}
    report = cross_split.overlap_report(df, cross_split.counterparts(df), by=("h",)).collect()
    assert sum(r.pairs for r in report) == len(want) and sum(r.rows for r in report) == sum(x == 1 for x in s)


def test_cross_split_of_three_and_four_tokens(spark):
    r = random.Random(2)
    texts = ["甲乙丙丁", "乙丙丁", "戊己庚", "戊己庚辛"] + ["".join(r.choice("子丑寅卯辰") for _ in range(r.choice([3, 4]))) for _ in range(120)]
    rows = [(i, t, ("validation", "train")[i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id long, instruction string, split string")
    got = {(x.record_id_a, x.record_id_b) for x in cross_split.cross_split_pairs(df).select("record_id_a", "record_id_b").collect()}
    g = [grams(t) for t in texts]
    assert got == {(i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if (i - j) % 2 and similarity(g[i], g[j]) >= 0.5}


def test_empty_tables(spark, rows):
    empty = frame(spark, rows).where("false")
    assert near_dup.near_duplicate_pairs(empty).count() == 0
    assert near_dup.near_duplicate_groups(empty).count() == 0
    assert cross_split.cross_split_pairs(empty).count() == 0
    junk = spark.createDataFrame([(1, None, None), (None, "a b c d", "train")], "record_id long, instruction string, split string")
    assert near_dup.near_duplicate_pairs(junk).count() == 0
    assert cross_split.cross_split_pairs(junk).count() == 0


def test_kernels_equal_plain_python():
    texts = [K.fold(t) for t in [*corpus(60, 3), "", "a", "ab cd ef ab cd ef", "Ｆｕｌｌ width１２"]]
    g, at = K.gram_sets(texts)
    assert [b - a for a, b in zip(at, at[1:])] == [len(grams(t)) for t in texts]
    sets = [set(g[a:b].tolist()) for a, b in zip(at, at[1:])]
    plain = [grams(t) for t in texts]
    assert all(len(sets[i] & sets[j]) == len(plain[i] & plain[j]) for i in range(len(texts)) for j in range(len(texts)))
    ids = list(zip(*(x.tolist() for x in K.set_ids(g, at)[:2])))
    assert all((ids[i] == ids[j]) == (plain[i] == plain[j]) for i in range(len(texts)) for j in range(len(texts)))
    assert K.tokens([])[0].size == 0 and K.gram_sets([])[1].tolist() == [0]


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)"])
def test_ids_of_any_type_and_repeated_ids(spark, kind):
    texts = ["甲乙丙丁戊己庚辛", "甲乙丙丁戊己庚", "子丑寅卯辰巳午未", "子丑寅卯辰巳午", "甲乙丙丁戊己庚"]
    rows = [("1", texts[0], "train"), ("1", texts[2], "train"), ("5", texts[1], "test"), ("2", texts[3], "validation"), ("7", texts[4], "train")]
    df = spark.createDataFrame(rows, "record_id string, instruction string, split string").withColumn("record_id", F.col("record_id").cast(kind))
    # id 1 holds two texts; each is compared on its own
    near = sorted((str(x.record_id_a), str(x.record_id_b)) for x in near_dup.near_duplicate_pairs(df).collect())
    assert near == [("1", "2"), ("1", "5"), ("1", "7"), ("5", "7")]
    cross = sorted((str(x.record_id_a), str(x.record_id_b)) for x in cross_split.cross_split_pairs(df).collect())
    assert cross == [("1", "2"), ("1", "5"), ("5", "7")]


@pytest.mark.parametrize("module, name, sides", [(near_dup, "near_duplicate_pairs", 1), (cross_split, "cross_split_pairs", 2)])
def test_the_partial_overlaps_decide(spark, rows, monkeypatch, module, name, sides):
    """Without what the fragments (or suffix intervals) counted, pairs are missed."""
    whole = getattr(module, name)(frame(spark, rows)).count()
    right = J.summed
    monkeypatch.setattr(J, "summed", lambda src, members, pairs, *more: right(src, members, pairs.withColumn("w", F.lit(0).cast("long")), *more))
    assert getattr(module, name)(frame(spark, rows)).count() < whole


def test_a_hot_class_is_paired_in_parts(spark):
    members = spark.createDataFrame([(1, 1, i, i % 3 == 0) for i in range(40)] + [(2, 2, 99, True)], "h long, l long, rid long, side boolean")
    got = {(r.ra, r.rb) for r in J.copies(members, F.col("side"), ~F.col("side"), most=7).collect()}
    assert got == {(i, j) for i in range(40) for j in range(40) if i % 3 == 0 and j % 3}


def test_coverage_equals_brute_force(spark, rows):
    s = [{"train": 0, "validation": 1, "test": 1}.get((r[2] or "").strip().lower()) for r in rows]
    g = [grams(r[1]) for r in rows]
    train = frozenset().union(*(x for x, k in zip(g, s) if k == 0))
    got = {r.id: (r.grams, r.covered) for r in cross_split.coverage(frame(spark, rows)).collect()}
    assert got == {i: (len(x), len(x & train)) for i, (x, k) in enumerate(zip(g, s)) if k == 1 and x}
    assert cross_split.coverage(frame(spark, rows).where("false")).count() == 0


def test_levels_add_up():
    import numpy as np

    c = np.array([0, 1, 2, 3, 5, 8, 1000, 10**9], np.uint64)
    got = J.COUNT_OF[J.level_of(c)]
    assert (got[:6] == c[:6]).all() and (abs(got.astype(float) - c) <= 0.13 * c).all()
