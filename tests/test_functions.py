import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import stats as S
from millrace.functions import text as T

TEXTS = ["Ｈello　世界! été ABC12", "一。二！三", "只有一句", "", "末尾。", "a\nb\n", "x<think>y\n</think>z"]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_norms(spark):
    assert column(spark, [TEXTS[0], None], T.norm_a) == ["hello世界!étéabc12", None]
    assert column(spark, ["A b，C。(d)[e]"], T.norm_b) == ["abcde"]
    assert column(spark, ["A b\nC"], T.norm_c) == ["abc"]


def test_tokens_and_grams(spark):
    assert column(spark, ["Ab1 中文été"], T.tokens) == [["ab1", "中", "文", "t"]]
    sets = [set(x) for x in column(spark, ["a b c d", "A b C", "b c d", "a b", None, "c b a"], T.token_grams)]
    assert [len(x) for x in sets] == [2, 1, 1, 0, 0, 1] and sets[0] == sets[1] | sets[2] and not sets[5] & sets[0]
    sets = [set(x) for x in column(spark, ["ab c d", "abc", "bcd", "a b", "ab", None, ""], T.char_grams)]
    assert [len(x) for x in sets] == [2, 1, 1, 1, 1, 1, 1] and sets[0] == sets[1] | sets[2] and sets[3] == sets[4] != sets[5] == sets[6]
    assert column(spark, ["abc", "a", None], lambda c: T.char_ngrams(c, 2)) == [["ab", "bc"], [], []]


def test_sentences_against_their_definition(spark):
    def last(s):
        k = max(s[:-1].rfind(c) for c in T.SENTENCE_ENDS) if s else -1
        return s[k + 1 :]

    def strip(s):
        k = max(s[:-1].rfind(c) for c in T.SENTENCE_ENDS) if s else -1
        return s[: k + 1]

    assert column(spark, TEXTS, T.last_sentence) == [last(s) for s in TEXTS]
    assert column(spark, TEXTS, T.strip_last) == [strip(s) for s in TEXTS]


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"), 0.0)).collect()] == [0.5, 0.0, 0.0]


def test_repaired_answers(spark):
    body = "甲" * 120
    assert column(spark, [f'{{"index": 3, "answer": "{body}"}}', f'{{"index": 3, "answer": "{body}', '{"index": 1, "answer": "短"}', "平常"], T.repaired_answer) == [body, body, None, "平常"]


def test_published_values(spark):
    assert S.mcnemar_p(2, 9) == 0.0654296875 and S.mcnemar_p(0, 20) == 2 / 2**20 and S.mcnemar_p(0, 0) == 1.0
    assert S.mcnemar_p(55, 4) == pytest.approx(1.6979681549678105e-12, rel=1e-12)
    assert S.bootstrap_interval([1, 2, 3, 4, 5, 6, 7, 8], [2, 1, 3, 5, 4, 7, 6, 9]) == (0.125, -0.5, 0.75)
    ci = spark.range(1).select(S.wilson(F.lit(50), F.lit(100)).alias("w"), S.wilson(F.lit(0), F.lit(0)).alias("z")).first()
    assert round(ci.w.low, 4) == 0.4038 and round(ci.w.high, 4) == 0.5962 and tuple(ci.z) == (0.0, 0.0, 0.0)


def test_draws_are_those_of_the_standard_library():
    for n in (1, 2, 7, 64, 300):
        d = [math.sin(i) for i in range(n)]
        rng = random.Random(42)
        assert S._drawn_means(d, 50, 42, block=1000) == [sum(d[rng.randrange(n)] for _ in range(n)) / n for _ in range(50)]


def test_bootstrap_queries_use_all_rounds(spark, monkeypatch):
    from millrace.plans import queries as core

    asked = {}
    for name in ("x03_paired_bootstrap", "x04_bootstrap_quantiles", "x06_bootstrap_9750", "x16_comparison_bundle"):

        def note(df, key, a, b, by, rounds=10_000, high=9749, variant="stdlib", name=name):
            asked[name] = (rounds, high, variant)
            return df.groupBy(*by).count()

        monkeypatch.setattr(S, "paired_bootstrap", note)
        at = spark.createDataFrame([(1, "s", "short", "o", (0.1,), (0.2,))], "entry_id long, subset string, style string, origin string, a struct<j: double>, b struct<j: double>")
        monkeypatch.setitem(core.QUERIES[name].__globals__, "table", lambda *_: at)
        core.QUERIES[name](spark, "")
    assert set(asked.values()) == {(10_000, 9749, "stdlib"), (10_000, 9749, "numpy"), (10_000, 9750, "stdlib")} and len(asked) == 4


def test_constant_shift_has_no_spread():
    d, lo, hi = S.bootstrap_quantiles(np.arange(9.0), np.arange(9.0) + 0.25, 200)
    assert (d, lo, hi) == (0.25, 0.25, 0.25)
    m, lo, hi = S.weighted_bootstrap({"a": np.full(5, 0.5), "b": np.full(4, 0.25)}, {"a": 1 / 3, "b": 1.0}, 100)
    assert m == pytest.approx(0.5 / 3 + 0.25) and lo == pytest.approx(m) and hi == pytest.approx(m)


def test_ranks_and_correlations(spark):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in [(1, 2), (2, 2), (2, 5), (4, 9), (5, 1)]] + [("g", None, 1.0), ("h", 1.0, 1.0)], "g string, x double, y double")
    ranks = {(r.x, r.r) for r in S.average_ranks(df.where("g = 'g' and x is not null"), "x", ["g"], "r").collect()}
    assert ranks == {(1.0, 1.0), (2.0, 2.5), (4.0, 4.0), (5.0, 5.0)}
    rho = {r.g: (r.n, r.rho) for r in S.spearman(df, "x", "y", ["g"]).collect()}
    assert rho["h"] == (1, None) and rho["g"][0] == 5 and math.isclose(rho["g"][1], np.corrcoef([1, 2.5, 2.5, 4, 5], [2.5, 2.5, 4, 5, 1])[0, 1], rel_tol=1e-9)
    u = S.mann_whitney(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double"), "v", "g", "a", "b").first()
    assert (u.n1, u.n2, u.u) == (2, 2, 0.5)


def test_index_quantile(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 7)], "g string, v int")
    got = {r.g: r.q for r in S.quantile_index(df, "v", ["g"], 0.5, "q").collect()}
    assert got == {"a": 5, "b": 7}


def test_kernels_against_plain_python():
    import re

    from millrace.functions import kernels as K

    r = random.Random(4)
    texts = ["".join(r.choice(["甲", "乙", "ab", "c1", " ", "，", "é", "😀"]) for _ in range(r.randrange(30))) for _ in range(200)] + ["", "a", "x" * 5000]
    for kernel, plain in ((K.token_gram_sets, lambda t: re.findall(T.TOKEN, t)), (K.char_gram_sets, lambda t: list(t) if len(t) >= 3 else [t])):
        g, at = kernel(texts)
        got = [set(g[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
        want = [set(zip(t, t[1:], t[2:])) if len(t) >= 3 else {tuple(t)} if kernel is K.char_gram_sets else set() for t in map(plain, texts)]
        assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(0, len(texts), 3) for j in range(len(texts)))
    assert K.token_gram_sets([])[1].tolist() == [0] and K.char_gram_sets([])[1].tolist() == [0]
