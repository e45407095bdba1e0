"""Problem 2: question and answer pairs whose answer is empty, cut off, a refusal, an echo or in the wrong language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# How answers decline. Matched by alignment, so wording may differ somewhat.
REFUSALS = (
    "很抱歉，我无法回答这个问题",
    "对不起，这个请求超出了我能提供帮助的范围",
    "抱歉，恕我不能就此给出建议，请咨询相关专业人士",
    "目前我没办法处理这类请求，敬请谅解",
    "这个问题我帮不上忙，建议另找资料",
    "由于缺少授权，这里不予回答",
    "作为语言模型，我没有能力对该项目作出判断",
    "我只是一个助手，不掌握现场情况，因此不能作答",
    "这道题恐怕要让您失望了，我给不出答案",
    "该内容不适合讨论，请换一个话题",
    "感谢提问。不过出于谨慎，我不便给出具体做法",
    "您的描述我已阅读。经过考虑，我决定不提供方案，请理解",
    "作为一个人工智能助手，我不能提供这方面的帮助",
    "抱歉，我不能协助完成这个请求",
    "As an AI language model, I am unable to answer this",
    "I'm sorry, but I can't help with that",
    "I don't have the ability to judge this project",
    "No answer will be given to questions of this kind",
    "Unfortunately this request is outside of what I can assist with",
    "I must decline to give advice on this matter",
    "Thank you for asking. Out of caution I would rather not describe a method",
    "I cannot assist with this request",
    "I won't be able to provide that information",
    "Thank you for asking. I would rather not provide a solution here; please consult a professional",
)
#: A speaker who declines to answer, in one sentence, whatever the wording.
_DECLINES = re.compile(
    r"(?:我(?!们)|本助手|本人|这里|恕|作为.{0,12}(?:模型|助手))[^。！？!?\n]{0,14}(?:无法|不能|不便|不会|不予|没办法|没法|没有能力|无权|无力|拒绝|决定不|不方便|不适合|不打算|难以)[^。！？!?\n]{0,6}(?:回答|作答|解答|答复|回应|回复|提供|给出|给到|协助|帮助|帮到|帮上|处理|讨论|谈论|判断|满足|透露|评论|展开|奉告)"
    r"|(?:恕难从命|无可奉告|爱莫能助|恕不(?:回答|奉告|受理)|请恕我|(?:我|这边)(?:帮不了|帮不上|答不了|答不上来|给不了|给不出|不好回答|不便多说|没法答))"
    r"|(?:超出|不属于|不在)(?:了)?我[^。！？!?\n]{0,8}(?:能力|范围|职责|所知)"
    r"|\bI(?:['’]m| am|['’]d| would)? (?:simply |just |really |afraid I )?(?:can(?:no|['’])t|cannot|won['’]t|will not|must decline|unable|not able|not in a position|not comfortable|not allowed|not permitted|have to (?:decline|pass)|don['’]t (?:have the ability|feel able)|do not have the ability|rather not|prefer not|decline)\b[^.!?\n]{0,60}\b(?:help|assist|answer|advice|advise|provide|judge|discuss|describe|respond|comment|share|go into|talk about|speak to|get into|support|this|that|it)\b"
    r"|\bnot something (?:that )?I(?:['’]m| am| can|['’]d| would| could)\b"
    r"|\b(?:beyond|outside(?: of)?) what I (?:can|am able|['’]m able)\b",
    re.I,
)
#: Words without which no sentence declines: most answers hold none and are looked at no further.
_NEGATION = re.compile(r"无法|不能|不便|不会|不予|没办法|没法|没有能力|无权|无力|拒绝|决定不|不方便|不适合|不打算|难以|恕|无可奉告|爱莫能助|帮不|答不|给不|不好回答|超出|不属于|不在|失望|谅解|\b(?:can|won|don)['’]t\b|\b(?:cannot|unable|decline|not|no answer|outside|beyond|rather)\b", re.I)
#: Tokens an answer may hold beside its refusal: an apology, a reason, where else to ask.
BESIDE = 120
# What stands where an answer should be.
_PLACEHOLDERS = frozenset("无 略 空 暂无 暂无内容 暂无答案 待补充 待定 待填 未填写 无内容 同上 n/a na null none nil nan todo tbd empty undefined".split())
_LABELS = frozenset("答 回答 答案 输出 回复 解答 answer response output reply a".split())
_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S | re.I)
_INVISIBLE = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_ENDS = tuple("。！？!?.…」』”’\"'）)】]》>～~")
_DANGLING = re.compile(r"(?:^|\n)[ \t　>]*(?:[-*•+·]|#+|\d{1,3}[.、)）．]?|[(（]\d{1,3}[)）]?|[①-⑳]|第[一二三四五六七八九十\d]{1,3}[步条点，、,:：]{0,2}|[一二三四五六七八九十]{1,3}[、.]|\|)[ \t　]*$")
_CLOSING = re.compile(r"(?:^|\n)[^\n。，,.!?！？；;|]{1,20}[：:][ \t　]*[^\n。，,；;：:、|（(“「]+$")
_COUNT_ZH = re.compile(r"(?:以下|如下|下列|下面|共分?|分为?|有|列出|给出|提出|包括)(?:的)?([一二两三四五六七八九十]|\d{1,2})(?:个|条|点|步|项|种|方面|步骤|阶段)[^。\n]{0,12}[：:]?[^\n。]{0,6}(?:\n|$)")
_COUNT_EN = re.compile(r"\b(?:there are|the following|in|these|has|have|takes?|list(?:s|ed)?|as)\s+(\d{1,2}|two|three|four|five|six|seven|eight|nine|ten)\s+(?:points?|steps?|items?|ways?|parts?|reasons?|aspects?|options?|measures?|directions?)\b[^.:\n]{0,20}[.:](?=\s)", re.I)
_NUMBER = {w: i for i, w in enumerate("零 一 二 三 四 五 六 七 八 九 十".split())} | {"两": 2} | {w: i + 2 for i, w in enumerate("two three four five six seven eight nine ten".split())}
_ITEM = re.compile(r"(?:^|\n|[.:。：] )[ \t　]*(?:[(（](\d{1,2})[)）]|(\d{1,2})[.、)）．](?!\d)|第(\d{1,2}|[一二三四五六七八九十])(?:步|条|点|项)|(?:step|point)\s+(\d{1,2})\b)", re.I)
_PAIRS = {"）": "（", ")": "(", "】": "【", "]": "[", "》": "《", "」": "「", "』": "『", "”": "“"}
_BRACKET = re.compile("[（(【\\[《「『“）)】\\]》」』”]")
_ASKED = (
    ("en", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:英文|英语)|\b(?:in|into) english\b", re.I)),
    ("zh", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:中文|汉语|华语)|\b(?:in|into) (?:simplified |traditional |mandarin )?chinese\b", re.I)),
    ("ja", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:日文|日语)|\b(?:in|into) japanese\b", re.I)),
    ("ko", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:韩文|韩语)|\b(?:in|into) korean\b", re.I)),
    ("ru", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:俄文|俄语)|\b(?:in|into) russian\b", re.I)),
    ("fr", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:法文|法语)|\b(?:in|into) french\b", re.I)),
    ("de", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:德文|德语)|\b(?:in|into) german\b", re.I)),
    ("es", re.compile(r"(?:用|以|为|成|作|写)[^。，,？?]{0,4}(?:西班牙文|西班牙语|西语)|\b(?:in|into) spanish\b", re.I)),
)
# Frequent words that tell languages of Latin script apart.
_WORDS = {
    "en": frozenset("the of and to in is are was be with for on by from that this it as at not which so an one can has have then first into".split()),
    "fr": frozenset("le la les de des du et un une est en dans par que qui on pour sur avec pas ne ce cela peut être d'abord ensuite enfin entre petit environ minutes".split()),
    "de": frozenset("der die das und ein eine einer ist in den dem zu mit von wird sich nicht auf für im zwischen danach zuerst zum schluss etwa je lässt kann werden".split()),
    "es": frozenset("el la los las de del y un una es en con por que se al para no lo como entre después primero final puede unos esto ahorra".split()),
    "it": frozenset("il lo la gli le di del della e un una è in con per che si al non come tra dopo prima può questo".split()),
    "pt": frozenset("o a os as de do da e um uma é em com por que se ao para não como entre depois primeiro pode isto".split()),
}
_HAN, _KANA, _HANGUL, _CYRILLIC = (re.compile(f"[{r}]") for r in ("一-鿿㐀-䶿", "぀-ヿ", "가-힯", "Ѐ-ӿ"))
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*")


def language(text: str) -> str | None:
    """The main language of a text; None without letters. A Latin word weighs as much as two signs of other scripts."""
    han, kana, hangul, cyrillic = (len(p.findall(text)) for p in (_HAN, _KANA, _HANGUL, _CYRILLIC))
    words = _LATIN.findall(text)
    score = {"zh": han, "ja": kana * 3 if kana else 0, "ko": hangul, "ru": cyrillic / 2, "latin": 2 * len(words)}
    if kana * 5 > han:
        score["ja"] += han
        score["zh"] = 0
    best = max(score, key=score.get)
    if not score[best]:
        return None
    if best != "latin":
        return best
    low = [w.lower().replace("’", "'") for w in words]
    hits = {k: sum(w in v for w in low) for k, v in _WORDS.items()}
    top = max(hits, key=hits.get)
    return top if hits[top] > hits["en"] else "en"


def longest_common_subsequence(a: str, b: str) -> int:
    """Its length, by bit-parallel rows: one big-integer step per character of b."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = at.get(c, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _plain(text: str) -> str:
    """Letters and numbers after NFKC and lower case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def _shingles(text: str, n: int = 5) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


_TEMPLATES = [(p, _shingles(p, 3)) for p in map(_plain, REFUSALS)]
_TEMPLATE_GRAMS = frozenset().union(*(g for _, g in _TEMPLATES))
_SENTENCE = re.compile(r"[^。！？!?\n]*?(?:[。！？!?\n]|\.(?=\s|$)|$)")


def _aligned(text: str, grams: set[str]) -> int:
    """How much of a stretch a template takes: shingle containment first, then the longest common subsequence; 0 if none fits."""
    if len(grams & _TEMPLATE_GRAMS) >= 3:
        for own, shingles in _TEMPLATES:
            if len(grams & shingles) >= 0.5 * len(shingles) and longest_common_subsequence(own, text) >= 0.75 * len(own):
                return len(own)
    return 0


def is_refusal(answer: str, question: str = "") -> bool:
    """Whether an answer declines, wherever it says so, and brings little beside that.

    Every sentence that could decline, with the one after it, is aligned with the
    templates, and is held against the forms in which a speaker declines. What the answer
    says besides, without what only repeats the question, must be short. A quoted or
    reported refusal within a longer answer thus isn't one.
    """
    if not _NEGATION.search(answer):
        return False
    parts = [p for p in _SENTENCE.findall(answer) if p.strip()]
    plain = [_plain(p) for p in parts]
    taken = found = 0
    for i, p in enumerate(parts):
        near = plain[i] + (plain[i + 1] if i + 1 < len(plain) else "")
        fits = _aligned(near, _shingles(near, 3)) if _NEGATION.search(p) or (i + 1 < len(parts) and _NEGATION.search(parts[i + 1])) else 0
        if fits:
            found += 1
            taken += min(len(near), fits + 12)
        elif _DECLINES.search(p):
            found += 1
            taken += len(plain[i])
    if not found:
        return False
    asked = _shingles(_plain(question), 5) if len(question) > 5 else set()
    rest = sum(len(p) for p in plain if not (asked and len(p) >= 5 and len(_shingles(p, 5) & asked) >= 0.8 * len(_shingles(p, 5))))
    return rest - taken <= BESIDE


def is_echo(question: str, answer: str) -> bool:
    """Whether an answer says nothing beyond the question: it holds nearly all of it and little else."""
    q, a = _plain(question), _plain(answer)
    if len(q) < 4 or len(a) < 0.7 * len(q):
        return False
    n = 5 if len(q) > 20 else 2
    gq, ga = _shingles(q, n), _shingles(a, n)
    both = len(gq & ga)
    if both < 0.35 * len(gq):
        return False
    if len(a) > 1.35 * len(q) + 12:  # the question over and over
        return both >= 0.85 * len(gq) and len(ga) - both <= 10 + 0.1 * len(gq)
    common = longest_common_subsequence(q, a)
    return common >= 0.85 * len(q) and len(a) - common <= max(14, 0.2 * len(q))


def _items_missing(text: str) -> bool:
    for pattern in (_COUNT_ZH, _COUNT_EN):
        m = pattern.search(text)
        if m:
            want = int(m[1]) if m[1].isdigit() else _NUMBER.get(m[1].lower(), 0)
            got = 0
            for item in _ITEM.finditer(text, max(0, m.end() - 2)):
                k = next(g for g in item.groups() if g)
                k = int(k) if k.isdigit() else _NUMBER.get(k, 0)
                if k == got + 1:
                    got = k
            if 2 <= want <= 40 and got and got < want:
                return True
            if want and not got and m.end() >= len(text.rstrip()):
                return True
    return False


def is_truncated(answer: str) -> bool:
    """Whether an answer breaks off before its sentence, list, table, block or announced points are complete."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    if text[:1] == "{" and '"' in text[:12] and text[-1:] != "}":
        return True
    if _DANGLING.search(text):
        return True
    lines = text.split("\n")
    last = lines[-1].strip()
    if last.startswith("|"):
        rows = [x.strip() for x in lines if x.strip().startswith("|")]
        width = rows[0].count("|")
        return not last.endswith("|") or last.count("|") < width or len(rows) < 3 or set(last) <= set("|-: ")
    if _items_missing(text):
        return True
    if text.endswith("```") or last in ("（完）", "(完)", "(end)", "（end）", "完", "END", "end"):
        return False
    open_at: list[str] = []
    for c in _BRACKET.findall(lines[-1]):  # what the last line leaves open
        if c not in _PAIRS:
            open_at.append(c)
        elif open_at and open_at[-1] == _PAIRS[c]:
            open_at.pop()
    if open_at and not text.endswith(_ENDS):
        return True
    if text.endswith(("，", ",", "、", "；", ";", "：", ":", "（", "(", "“", "「", "-", "—", "=", "/", "+")):
        return True
    if text.endswith('"') and text.count('"') % 2:
        return True
    if text.endswith(_ENDS):
        return bool(open_at) and not text.endswith(("。", "！", "？", ".", "!", "?"))
    if _CLOSING.search(text):
        return False
    # no mark ends it: a word or a short phrase is complete, a broken sentence isn't
    return bool(re.search(r"[。！？!?；;，]|\.\s|,\s", text)) or len(_HAN.findall(text)) > 12 or len(_LATIN.findall(text)) > 6


def is_empty(answer: str | None) -> bool:
    """Null, or nothing beyond white space, invisible signs, a placeholder, a label or a thinking block."""
    if answer is None:
        return True
    text = _INVISIBLE.sub("", _THINK.sub("", answer)).strip()
    bare = unicodedata.normalize("NFKC", text).lower().strip(" \t\r\n*#_`~>-—–=|.。…:：()[]{}<>\"'“”‘’【】《》「」、,;/\\")
    return not bare or bare in _PLACEHOLDERS or bare in _LABELS


def defect_of(instruction: str | None, output: str | None, subset: str | None = None) -> str | None:
    """The defect of one pair, or None. The first that holds counts: empty, refusal, echo, wrong_language, truncated."""
    if is_empty(output):
        return "empty"
    answer = _INVISIBLE.sub("", _THINK.sub("", output)).strip()
    if is_refusal(answer, instruction or ""):
        return None if subset == "safety_refusal" else "refusal"
    question = instruction or ""
    if question and is_echo(question, answer):
        return "echo"
    asked = language(question)
    if asked is not None:
        got = language(answer)
        if got is not None and got != asked and (len(_HAN.findall(answer)) + len(_LATIN.findall(answer)) > 2 or got not in ("zh", "en")):
            if not any(got == k and p.search(question) for k, p in _ASKED):
                return "wrong_language"
    return "truncated" if is_truncated(answer) else None


def pair_defects(df: DataFrame, id_col: str = "sample_id", instruction_col: str = "instruction", output_col: str = "output", subset_col: str = "subset") -> DataFrame:
    """(``sample_id``, ``defect``) of every defective pair; sound pairs have no row.

    One pass without a shuffle. Refusals are found by aligning the answer with
    templates, echoes by aligning it with the question (shingle containment, then
    longest common subsequence). In the subset ``safety_refusal`` a refusal is no
    defect. A null answer is empty; without an instruction an answer can be neither
    an echo nor in the wrong language; repeated rows are reported each; an empty
    table gives no rows; other columns aren't read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect_of(i, o, s) for i, o, s in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            keep = pa.array([k for k, d in enumerate(found) if d], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([d for d in found if d], pa.string())], ["sample_id", "defect"])

    return df.select(df[id_col], *(df[c].cast("string") for c in (instruction_col, output_col, subset_col))).mapInArrow(run, f"sample_id {kind}, defect string")
