import random

import pytest
from pyspark.sql import functions as F

from millrace import shared
from millrace.functions import stats as S
from millrace.operators import building as B
from millrace.operators import dedup as D
from millrace.operators import evaluation as V
from millrace.operators import gates as G
from millrace.operators import projections as P
from millrace.operators import ranking as R
from millrace.sources import io


def rows(n=400, seed=3):
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(20)])) for i in range(n)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(rows(), "i int, g string, v int").repartition(5)


def groups(data):
    out = {}
    for i, g, v in data:
        out.setdefault(g, []).append((i, v))
    return out


def test_numbers_sums_and_running_values(spark, df):
    number = {r.i: r.k for r in R.numbered(df, ["g"], [F.desc("i")]).collect()}
    total = {r.i: r.before for r in R.prefix_sums(df, ["g"], [F.col("i")], F.coalesce("v", F.lit(0))).collect()}
    last = {r.i: r.x for r in R.running_last(df, "v", ["g"], "i", "x").collect()}
    least = {r.i: (r.x, r.y) for r in R.running_min(df, "v", ["g"], "i", "x", "y").collect()}
    for g, own in groups(rows()).items():
        for k, (i, v) in enumerate(own):
            so_far = [x for _, x in own[: k + 1] if x is not None]
            before = [x for _, x in own[:k] if x is not None]
            assert number[i] == len(own) - k and total[i] == sum(before)
            assert last[i] == (so_far[-1] if so_far else None)
            assert least[i] == (min(so_far, default=None), min(before, default=None))
    assert R.numbered(df.where("false"), ["g"], [F.col("i")]).count() == 0


def test_first_rows_of_groups(df):
    got = sorted(r.i for r in R.first_rows(df, [F.col("g")], [F.desc(F.coalesce("v", F.lit(-1))), F.col("i")], 7, parts=3).collect())
    want = sorted(i for own in groups(rows()).values() for i, _ in sorted(own, key=lambda x: (-(x[1] if x[1] is not None else -1), x[0]))[:7])
    assert got == want


def test_average_ranks_of_ties_and_null_groups(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), (None, 5.0), (None, 5.0), (None, 4.0)], "g string, v double")
    assert sorted((r.g or "", r.v, r.r) for r in S.average_ranks(d, "v", ["g"], "r").collect()) == [("", 4.0, 1.0), ("", 5.0, 2.5), ("", 5.0, 2.5), ("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5)]


def grams(t):
    t = t.split()
    return set(zip(t, t[1:], t[2:]))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_pairs_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(D, "HOT", hot)
    r = random.Random(8)
    base = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(2, 14))) for _ in range(40)]
    texts = base + [" ".join(w for w in r.choice(base).split() if r.random() > 0.1) for _ in range(60)] + [base[0]] * 10
    side = [r.choice([0, 1, None]) for _ in texts]
    d = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, side))], "i int, t string, s int")
    g = [grams(t) for t in texts]
    want = {(i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) >= 0.5}
    got = [(x.id_a, x.id_b) for x in D.near_pairs(d, "i", "t", 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [(x.id_a, x.id_b) for x in D.near_pairs(d, "i", "t", 0.5, F.col("s")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if {side[i], side[j]} == {0, 1}}


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_max_similarity_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(D, "REFERENCE", block)
    r = random.Random(9)
    text = lambda: " ".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
    refs, texts = [text() for _ in range(25)], [text() for _ in range(60)] + [None, ""]
    got = D.max_similarity(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(refs)), "r int, q string"), "i", "t", "r", "q").collect()
    for x in got:
        g = grams(texts[x.id] or "")
        best = max(((len(g & h) / len(g | h) if g | h else 0.0, -k) for k, h in enumerate(map(grams, refs))), default=(0.0, 0))
        assert x.j == pytest.approx(best[0]) and x.ref == (-best[1] if best[0] > 0 else None)
    assert len(got) == len(texts)


def test_stages_resume(spark, tmp_path):
    at, made = f"file://{tmp_path}/build", []

    def make():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert B.Stages(spark, at).run("one", make).count() == 5
    assert len(made) == 1
    (tmp_path / "build" / "one.done").unlink()  # broke off before its mark
    assert B.Stages(spark, at).run("one", make).count() == 5 and len(made) == 2


def test_completed_makes_only_what_is_missing(spark, tmp_path):
    at, seen = f"file://{tmp_path}/out", []

    def make(w):
        seen.append(sorted(r.id for r in w.collect()))
        return w

    B.completed(spark, spark.range(3), "id", at, make)
    assert B.completed(spark, spark.range(5), "id", at, make).count() == 5
    assert seen == [[0, 1, 2], [3, 4]]


def test_sources_that_vary(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/b")
    read = spark.read.parquet
    chain = [(f"file://{tmp_path}/a", read), (f"file://{tmp_path}/b", read)]
    assert B.first_source(spark, chain, lambda: spark.range(9)).count() == 3
    assert B.first_source(spark, chain[:1], lambda: spark.range(9)).count() == 9
    assert B.preferred_source(spark.range(99), spark.range(7)).count() == 7
    assert B.preferred_source(spark.range(100), spark.range(7)).count() == 100
    d = spark.createDataFrame([('{"text": "甲"}',), ("乙",), (None,)], "x string")
    assert [r[0] for r in d.select(B.response_text(F.col("x"))).collect()] == ["甲", "乙", None]


def test_limits_quotas_and_caps(spark):
    d = spark.createDataFrame([(i, 1 + i % 3) for i in range(20)], "i int, n int")
    assert sorted(r.i for r in B.until_limit(d, "i", "n", 7).collect()) == [0, 1, 2, 3]  # 1 + 2 + 3 and the row that crosses
    q = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 0)], "s string, n int")
    assert [r.s for r in B.quota_order(q, "s", "n").orderBy("place").collect()] == ["c", "b", "c", "b", "c", "b", "a"]
    d = spark.createDataFrame([(i, "xyn"[i % 3] if i % 3 < 2 else None, "t" * i) for i in range(60)], "i int, g string, t string")
    got = B.rebalanced(d, "g", {"x": 4, "y": 100}, {}, "t", "i").collect()
    assert sorted(r.i for r in got if r.g == "x") == [48, 51, 54, 57]  # the longest
    assert sum(r.g == "y" for r in got) == 20 and sum(r.g is None for r in got) == 20
    one, two = (sorted(r.i for r in B.rebalanced(d, "g", {"x": 4}, {"x": "random"}, "t", "i", seed).collect() if r.g == "x") for seed in ("1", "2"))
    assert len(one) == len(two) == 4 and one != two


def test_term_coverage_takes_what_brings_most(spark):
    d = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["x", "y", "z"]), (3, "a", []), (4, "a", ["w"]), (5, None, ["x"]), (6, "a", ["y"])], "i int, g string, t array<string>")
    got = [(r.g, r.i) for r in B.term_coverage(d, "g", F.col("t"), "i", 2).collect()]
    assert sorted(i for g, i in got if g == "a") == [2, 4] and (None, 5) in got
    assert B.term_coverage(d, "g", F.col("t"), "i", 100).count() == 6


def test_checks_find_each_violation(spark):
    d = spark.createDataFrame([(1, "a", "train"), (1, "a", "test"), (2, " ", "x"), (3, "b", None)], "i int, k string, s string")
    got = {r["check"]: r.violations for r in B.checks(d, "i", {"text": F.trim("k") != "", "side": F.col("s").isin("train", "test")}, ["i"], {"apart": (F.col("k"), "s")}).collect()}
    assert got == {"text": 1, "side": 2, "i_unique": 1, "apart": 1}


def test_scores_by_kind(spark):
    d = spark.createDataFrame([("principle", "用分割法", ["分割"]), ("principle", "用分割法", ["分割", "反馈"]), ("principle", "x", []), ("generation", "改参数", []), ("ariz", "先看冲突", []), ("probe", "X", ["x"]), ("other", "x", ["x"])], "k string, t string, w array<string>")
    usual, steps = F.array(F.lit("参数"), F.lit("结构")), F.array(F.lit("矛盾"), F.lit("资源"))
    aliases = F.create_map(F.lit("矛盾"), F.array(F.lit("冲突")))
    got = [(r.metric, r.score, r.correct) for r in d.select(V.typed_score(F.col("k"), F.col("t"), F.col("w"), usual, steps, aliases).alias("s")).select("s.*").collect()]
    assert got == [("principle_coverage", 1.0, 1), ("principle_coverage", 0.5, 0), (None, None, None), ("generation_coverage", 0.5, None), ("ariz_coverage", 0.5, None), ("probe_coverage", 1.0, None), (None, None, None)]


def test_principles_numbers_and_flags(spark):
    d = spark.createDataFrame([("先用运用分割原理，再用反馈原理，和推荐的发明原理，又用分割原理。",), (None,)], "x string")
    assert [r[0] for r in d.select(V.expected_principles(F.col("x"), ["分割", "割"])).collect()] == [["分割", "再用反馈原理"], []]
    d = spark.createDataFrame([("0.35",), ('{"value": 0.35}',), ('{"after": 0.3, "value": 1}',), ('{"value": {"after": 0.2}}',), ("{}",), ("x",), (None,)], "x string")
    assert [r[0] for r in d.select(P.nested_number(F.col("x"))).collect()] == [0.35, 0.35, 0.3, 0.2, None, None, None]
    loop = "甲乙丙丁" * 25
    d = spark.createDataFrame([(loop * 6,), (loop * 4,), ("x" * 501,), ("".join(chr(0x4E00 + i) for i in range(9000)),), ("",)], "x string")
    assert [r[0] for r in d.select(G.failure_flags(F.col("x"))).collect()] == [["loop"], [], ["loop"], [], ["empty"]]
    d = spark.createDataFrame([("你是谁？", "我不是小匠"), ("你是谁？", "我是小匠"), (None, "我不是小匠")], "q string, a string")
    assert [r[0] for r in d.select(G.identity_denied(F.col("q"), F.col("a"), "你是谁", "不是小匠")).collect()] == [True, False, False]


def test_weighted_interval_holds_the_weighted_mean(spark):
    r = random.Random(2)
    data = [(i, s, 0.0, r.gauss(1.0 if s == "x" else 2.0, 0.1)) for i in range(300) for s in "xy"] + [(1, "z", 0.0, 99.0), (2, "x", None, 1.0)]
    d = spark.createDataFrame(data, "i int, s string, a double, b double")
    for block in (20_000, 40):
        x = V.weighted_interval(d, "s", "i", "a", "b", {"x": 0.25, "y": 0.75}, rounds=2000, block=block).first()
        assert x.n == 600 and x.diff == pytest.approx(1.75, abs=0.02) and x.low < x.diff < x.high and 0.005 < x.high - x.low < 0.03
    assert V.weighted_interval(d.where("false"), "s", "i", "a", "b", {"x": 1.0}, rounds=10).first().n == 0


def test_session_messages(spark):
    lines = ['{"type":"model_change","modelId":"m1"}', '{"type":"message","message":{"role":"user","content":"问"}}', "{broken", '{"type":"message","message":{"role":"assistant","content":[{"type":"text","text":"甲"},{"type":"toolCall","name":"find"},{"type":"text","text":"乙"}]}}', '{"type":"message","message":{"role":"system","content":"x"}}', '{"type":"message","message":{"role":"user","content":[]}}']
    d = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("t", 0, lines[1])], "s string, n int, x string")
    got = [(r.s, r.n, r.role, r.content, r.tools, r.model) for r in io.session_messages(d, "s", "n", "x").orderBy("s", "n").collect()]
    assert got == [("s", 1, "user", "问", [], "m1"), ("s", 3, "assistant", "甲乙", ["find"], "m1"), ("t", 0, "user", "问", [], None)]


def test_csv_round_trip_of_hard_cells(spark, tmp_path, edge=("a\"b,'c'", "x\r\ny\n", " pad ", "", None, "\\N not null", "﻿mark", "\\", "长" * 100_000)):
    d = spark.createDataFrame(list(enumerate(edge)), "i int, t string")
    io.write_csv(d, f"file://{tmp_path}/c")
    got = {r.i: r.t for r in io.read_csv(spark, f"file://{tmp_path}/c", "i int, t string").collect()}
    assert got == dict(enumerate(edge))


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared.shared_dir(Fake)


def test_coverage_and_lengths(spark):
    data = [(i, "a" if i < 90 else "b" if i < 95 else None, "t" * (i % 45), ["x"] if i == 3 else ["y", "z"] if i == 80 else []) for i in range(99)]
    d = spark.createDataFrame(data, "i int, g string, t string, w array<string>")
    got = B.coverage_and_lengths(d, "g", F.col("w"), "t", "i", {"a": 30, "b": 30, "c": 4}, share=0.2).collect()
    a = [r for r in got if r.g == "a"]
    assert len(a) == 30 == len({r.i for r in a}) and {3, 80} <= {r.i for r in a}
    assert sum(r.g == "b" for r in got) == 5 and sum(r.g is None for r in got) == 4
    thirds = [sum(len(r.t) // 15 == k for r in a) for k in range(3)]
    assert min(thirds) >= 6 and max(thirds) <= 14
    assert B.coverage_and_lengths(d.where("false"), "g", F.col("w"), "t", "i", {"a": 3}).count() == 0


def test_a_table_goes_when_another_takes_its_place(spark):
    one = shared.cut(spark.range(3))
    assert B.exists(spark, one._millrace_path)
    two = shared.cut(one.where("id > 0"), instead=one)
    assert two.count() == 2 and not B.exists(spark, one._millrace_path)
    shared.drop(spark.range(1))
