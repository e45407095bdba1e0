import pytest
from pyspark.sql import functions as F

from millrace.llm import group_splits as G
from millrace.operators.components import components


@pytest.mark.parametrize(
    "text, marks",
    [
        ("据案卷“ZX 0024 0412”，", ["zx00240412"]),
        ("卷宗 ＦＫ-０００００７７２", ["fk00000772"]),
        ("TZ·00.000.406；wj/0000-1449", ["tz00000406", "wj00001449"]),
        ("AR_00002808 and ar–00002808", ["ar00002808"]),
        ("（图号 TZ-959641）", []),
        ("(lot 43511429)", []),
        ("QC000028080", []),
        ("图qc00002808号", ["qc00002808"]),
        ("", []),
        (None, None),
    ],
)
def test_marks(spark, text, marks):
    assert spark.createDataFrame([(text,)], "t string").select(G.case_marks(F.col("t")).alias("m")).first().m == marks


ROWS = [
    (1, "g1", "案卷 AR-00000001", "a"),
    (2, " G1\t", "无", "a"),
    (3, "g2", "案卷 ar00000001 和 FK 00000002", "a"),
    (4, "g3", "fk-00000002", None),
    (5, None, "AR 0000 0001", "b"),
    (6, None, "案卷 QC00000009", "b"),
    (7, "g4", "案卷 QC00000009", "b"),
    (8, "g5", None, "b"),
    (9, "  ", "案卷 WJ00000007", "b"),
    (10, None, None, None),
    (11, "g6", "WJ-00000007", "a"),
    (12, "g7", "FK-00000002", "a"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "record_id long, group_id string, instruction string, subset string")


def test_related_pairs(spark):
    got = {tuple(r) for r in G.related_pairs(frame(spark)).collect()}
    assert got == {("g1", "g2"), ("g1", "g3"), ("g2", "g3"), ("g1", "g7"), ("g2", "g7"), ("g3", "g7")}
    assert G.related_pairs(frame(spark).where("false")).count() == 0


def test_related_rows_share_a_split(spark):
    got = {r.record_id: r for r in G.assign_splits(frame(spark)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for together in ([1, 2, 3, 4, 5, 12], [6, 7], [9, 11]):
        assert len({got[i].split for i in together}) == 1 and len({got[i].unit for i in together}) == 1
    assert G.assign_splits(frame(spark).where("false")).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 200])
def test_proportions(spark, bucket, monkeypatch):
    monkeypatch.setattr(G, "BUCKET", bucket)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i // 4}", f"案卷 AR{i % 997:08d}" if i % 50 == 0 and i % 3 else "x", "ab"[i % 2]) for i in range(6000)]
    df = frame(spark, rows)
    got = G.assign_splits(df)
    share = {(r.label, r.split): r.share for r in G.split_balance(got, df).collect()}
    for label in ("*", "a", "b"):
        assert abs(share[label, "train"] - 0.85) < 0.01 and abs(share[label, "validation"] - 0.10) < 0.01 and abs(share[label, "test"] - 0.05) < 0.01
    by = {}
    for r in got.collect():
        by.setdefault(r.unit, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [("s0", f"s{i}") for i in range(1, 40)]
    loops = [("x", "x"), (None, "y"), ("p", "q"), ("q", "p")]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain + star + loops, "x string, y string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert {got[f"s{i}"] for i in range(40)} == {"s0"}
    assert got["p"] == got["q"] == "p" and "x" not in got and "y" not in got


def test_separators_of_any_kind_and_number(spark):
    texts = ["见 AB  -  12 34 56 78", "参考 ab————1234\u30005678。", "ab:12~34\u200b5678", "Ａｂ１２３４５６７８", "xab12345678", "ab123456789", "ab甲12345678"]
    df = spark.createDataFrame([(i, f"g{i}", t) for i, t in enumerate(texts)], "record_id long, group_id string, instruction string")
    got = {(r.group_id_a, r.group_id_b) for r in G.related_pairs(df).collect()}
    assert got == {(f"g{i}", f"g{j}") for i in range(4) for j in range(i + 1, 4)}
