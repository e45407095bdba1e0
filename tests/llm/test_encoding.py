import functools
import os

import pytest

from millrace.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary files here")


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.VOCABULARY)
    t.encode_special_tokens = True
    return t


def reference(texts):
    t = library()
    return [r.ids for r in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [None, "", " ", "aaaa aaa aa a", "a" * 4000, "啊" * 3000, "<|endoftext|>", " \n\n  x\t", "ﬀ​😀😀é", "It's we'LL they've 12345 ½ ²", "混合 mixed 文本，with 标点。", "\r\n\r\n  end  "]


def test_ids_equal_the_public_library():
    ids, at = E.Encoder().encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(TEXTS)


def test_hypothesis_round_trip():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = E.Encoder()

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(max_size=40), max_size=5))
    def check(texts):
        ids, at = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(texts)

    check()


def test_rank_queue_gives_ranks_in_order_and_keeps_all_positions():
    import numpy as np

    q = E.RankQueue()
    q.push(np.array([70, 3, 4096, 3]), np.array([1, 2, 3, 4]))
    q.push(np.array([3, 50_000]), np.array([5, 6]))
    out = []
    while (e := q.pop()) is not None:
        out.append((e[0], sorted(e[1].tolist())))
    assert out == [(3, [2, 4, 5]), (70, [1]), (4096, [3]), (50_000, [6])]


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(E, "KEPT_IDS", 1)
    enc = E.Encoder()
    assert [enc.encode([t])[0].tolist() for t in TEXTS] == reference(TEXTS)


def test_query_form(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "字 word", "x"), (3, "字 word", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in E.token_ids(df).collect())
    assert got == [(1, []), (2, []), (3, reference(["字 word"])[0])] + [(3, reference(["字 word"])[0])]
    assert E.token_ids(df.where("false")).count() == 0
    assert sorted(r.tokens for r in E.token_counts(df).collect()) == sorted([0, 0, len(got[2][1]), len(got[2][1])])
