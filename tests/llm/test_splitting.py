import random

import pytest

from millrace.llm import splitting as S

PAD = " \t\r\n　"


def whole(rows, text, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece)
    assert [r.piece for r in rows] == list(range(len(rows)))
    out, last = "", None
    for r in rows:
        assert len(r.piece_text) <= limit and text[r.start : r.end] == r.piece_text
        if last is not None:
            assert r.piece_text.startswith(last[-overlap:] if overlap else "")
        out += r.piece_text if last is None else r.piece_text[overlap:]
        last = r.piece_text
    assert out == text


def test_pieces_of_a_table(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("字词句，。！\n a.b🙂") for _ in range(n)) for n in (10, 2048, 2049, 9000)]
    texts += ["x" * 5000, "　" * 3000, " " * 3000 + "y", "\r\n" * 3000 + "z" * 2100, None, "", texts[3]]
    df = spark.createDataFrame([(None if i == 3 else f"t{i}", t, None, i, "clash") for i, t in enumerate(texts)], "id string, text string, heading string, page_num int, piece string")
    got = S.split_oversized(df).collect()
    by = {}
    for x in got:
        by.setdefault(x.page_num, []).append(x)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t.strip(PAD)) > 2048}
    for i, rows in by.items():
        whole(rows, texts[i], 2048, 128)
    assert S.split_oversized(df.where("false")).count() == 0


def test_ranges_give_whole_texts(spark):
    r = random.Random(3)
    text = "".join(r.choice("字词句，。！\n a.b🙂") for _ in range(40_000))
    df = spark.createDataFrame([("a", text, "h", 1), ("a", text, "h", 1), ("b", "q" * 30_000, None, None)], "id string, text string, heading string, page_num int")
    got = S.split_oversized(df, limit=300, overlap=40, range_chars=2000).collect()
    a = sorted((x for x in got if x.id == "a"), key=lambda x: x.piece)
    assert a[0::2] == a[1::2]  # the same row twice gives the same pieces twice
    whole(a[0::2], text, 300, 40)
    whole([x for x in got if x.id == "b"], "q" * 30_000, 300, 40)


def test_files_by_byte_ranges(spark, tmp_path):
    r = random.Random(4)
    texts = {"a": "".join(r.choice("é字🙂a。\n ") for _ in range(30_000)), "b": "短", "c": ""}
    for k, t in texts.items():
        (tmp_path / k).write_bytes(t.encode())
    got = S.split_files(spark, [str(tmp_path / k) for k in texts], limit=300, overlap=40, range_bytes=4096).collect()
    for k in ("a", "b"):
        whole([x for x in got if x.path.endswith(f"/{k}")], texts[k], 300, 40)
    assert not [x for x in got if x.path.endswith("/c")]


def test_malformed_bytes_at_range_edges(spark, tmp_path):
    data = b"a" * 4090 + b"\x80" * 40 + "字".encode() * 3000 + b"\xe5\xad" + b"z" * 4000
    (tmp_path / "bad").write_bytes(data)
    got = S.split_files(spark, [str(tmp_path / "bad")], limit=300, overlap=40, range_bytes=4096).collect()
    out = "".join(r.piece_text if r.piece == 0 else r.piece_text[40:] for r in sorted(got, key=lambda r: r.piece))
    assert out == data.decode("utf-8", "replace")


def test_rejoined(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("字词句，。！\n a.b🙂") for _ in range(n)) for n in (2100, 9000, 30_000)]
    df = spark.createDataFrame([(str(i), t, None, i) for i, t in enumerate(texts)], "id string, text string, heading string, page_num int")
    pieces = S.split_oversized(df, range_chars=5000).cache()
    import hashlib

    got = {x.id: (x.chars, x.digest, x.broken) for x in S.rejoined(pieces).collect()}
    assert got == {str(i): (len(t), hashlib.md5(t.encode()).hexdigest(), 0) for i, t in enumerate(texts)}
    worse = pieces.where("not (id = '1' and piece = 2)")
    assert {x.id: x.broken for x in S.rejoined(worse).collect()}["1"] > 0


def test_ranges_of_any_length_lose_nothing():
    r = random.Random(6)
    for n in (600, 601, 4096, 20_000):
        text = "".join(r.choice("字词，。\n ab") for _ in range(n))
        for size in (600, 1000, 4096, 1 << 18):
            start, end = S.pieces_of(text, 300, 40, size)
            assert start[0] == 0 and end[-1] == n and (end - start <= 300).all() and (start[1:] == end[:-1] - 40).all()


def test_boundaries():
    s = "第一句。”第二句！\r\n\r\n第三 段, x.y z."
    b = S.boundaries(s)
    assert b[s.index("第二")] == 2 and b[s.index("”")] == 0
    assert b[s.index("第三")] == 4 and b[s.index("\n") + 0] == 255
    assert b[s.index(".y") + 1] == 0 and b[len(s)] >= 2


def test_arguments(spark):
    df = spark.createDataFrame([("a", "b", "c", 1)], "id string, text string, heading string, page_num int")
    with pytest.raises(ValueError):
        S.split_oversized(df, limit=10, overlap=10)
    with pytest.raises(ValueError):
        S.split_oversized(df, range_chars=100)
