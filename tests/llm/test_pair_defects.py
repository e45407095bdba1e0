import pytest

from millrace.llm import pair_defects as P

Q = "我们为郧澜宣莳项目配套的印制电路板已运行2767小时，请写出一个以湛蘅纨岐为主角的预先作用案例。"
A = "问题的根子不在分子筛，而在萃取时留下的相分离。把分子筛拆成两段后，可以在不停机的条件下进行。"


@pytest.mark.parametrize(
    "instruction, output, subset, want",
    [
        (Q, A, None, None),
        (Q, None, None, "empty"),
        (Q, "​ ﻿", None, "empty"),
        (Q, "<think>先看题目</think>", None, "empty"),
        (Q, "<think>未完", None, "empty"),
        (Q, "**回答：**\n", None, "empty"),
        (Q, "N/A", None, "empty"),
        (Q, "（空）", None, "empty"),
        (Q, "否。", None, None),
        (Q, "可行", None, None),
        (Q, "很抱歉，我无法回答这个问题。", None, "refusal"),
        (Q, "很抱歉，我无法回答这个问题。", "safety_refusal", None),
        (Q, "<think>x</think>\n该内容不适合讨论，请换一个话题。", "ariz_guidance", "refusal"),
        (Q, "遗憾的是，旧的硅烷偶联剂无法承受这一负荷。" + A, None, None),
        ("Describe the conflict of the pump.", "I'm sorry, but I can't help with that.", None, "refusal"),
        (Q, Q, None, "echo"),
        (Q, f"「{Q}」", None, "echo"),
        (Q, f"您问的是：{Q[:-3]}", None, "echo"),
        (Q, f"{Q}\n{Q}", None, "echo"),
        (Q, Q[:-1] + "，这是一个值得思考的问题。", None, "echo"),
        (Q, "客户曾为花键轴的延误道歉，我们据此调整了次序。" + A, None, None),
        (Q, Q + "\n" + A, None, None),
        (Q, "First describe the conflict. Then the part can be split in two sections.", None, "wrong_language"),
        (Q + "请用英文作答。", "First describe the conflict. Then the part can be split in two sections.", None, None),
        ("Describe the conflict of the pump.", "Ensuite la pièce peut être coupée en deux sections.", None, "wrong_language"),
        (Q, "이렇게 하면 묶음마다 약 6분이 줄어듭니다.", None, "wrong_language"),
        (Q, A[:-7] + "，", None, "truncated"),
        (Q, A[:-4], None, "truncated"),
        (Q, A + "\n3.", None, "truncated"),
        (Q, A + "\n## ", None, "truncated"),
        (Q, A + "\n```\nstep 1 -> step", None, "truncated"),
        (Q, A + "\n| 参数 | 变化 |\n|---|---|\n| 鬼像 | -9% |", None, None),
        (Q, A + "\n| 参数 | ", None, "truncated"),
        (Q, "可从以下3个方面入手：\n(1) 甲。\n(2) 乙。", None, "truncated"),
        (Q, "可从以下2个方面入手：\n(1) 甲。\n(2) 乙。", None, None),
        (Q, '{"index": 5, "answer": "在列出操作时间之后', None, "truncated"),
        (Q, A + "\n\n（完）", None, None),
        (Q, A + "\n\n推荐方案：分段布置的触点", None, None),
        (None, A, None, None),
        ("", "First describe the conflict.", None, None),
        (Q, "长" * 200_000 + "。", None, None),
    ],
)
def test_defects(instruction, output, subset, want):
    assert P.defect_of(instruction, output, subset) == want


@pytest.mark.parametrize(
    "answer",
    [  # wordings that are neither templates nor in the test tables
        "Sorry, that's not something I'm able to go into.",
        "I'm afraid I cannot share details about this topic.",
        "I'd prefer not to comment on that.",
        "That is beyond what I can answer here. You may want to ask an expert.",
        "这件事恕难从命。",
        "对此我无可奉告，您可以向主管部门了解。",
        "不好意思，这个我答不上来。",
        "您问的内容超出了我的能力范围，建议咨询专业机构。",
        "我暂时没法回答这个问题，希望您理解。",
        "谢谢您的信任。" * 20 + "很抱歉，我无法回答这个问题。",  # late in the answer
    ],
)
def test_refusals_in_other_words(answer):
    assert P.defect_of("请说明这台泵的矛盾，并给出改进的方向。", answer) in (("refusal",) if len(answer) < 120 else ("refusal", None))
    assert P.defect_of("请说明这台泵的矛盾，并给出改进的方向。", answer, "safety_refusal") != "refusal"


def test_nothing_is_cut_off_from_view():
    long = "先把阀体分成两段，再让其中一段可调。" * 25
    assert P.defect_of(Q, long + "最后再核对（见附录") == "truncated"  # far behind any prefix
    assert P.defect_of(Q, "（注：" + long + "\n" + A) is None  # an old bracket doesn't count at the end
    question = "请把下面的说明改写得更短：" + "阀体在高温下会变形，" * 20
    assert P.defect_of(question, question[:-1] + "。很抱歉，我无法回答这个问题。") == "refusal"  # behind the repeated question
    assert P.defect_of(Q, A + "客户回信说：很抱歉，我无法回答这个问题。" + long) is None  # reported within an answer


def test_longest_common_subsequence():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    @settings(max_examples=200, deadline=None)
    @given(st.text("ab字", max_size=30), st.text("ab字", max_size=30))
    def check(a, b):
        assert P.longest_common_subsequence(a, b) == plain(a, b)

    check()


def test_table(spark):
    rows = [(1, Q, None, None, "x"), (1, Q, None, None, "x"), (2, Q, A, "s", "x"), (None, None, "", None, "x")]
    df = spark.createDataFrame(rows, "sample_id long, instruction string, output string, subset string, defect string")
    assert sorted((str(r.sample_id), r.defect) for r in P.pair_defects(df).collect()) == [("1", "empty"), ("1", "empty"), ("None", "empty")]
    assert P.pair_defects(df.where("false")).count() == 0
