"""Text functions. Columns built in Spark where its functions express the rule, Arrow UDFs where they don't."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from . import kernels as K

# Punctuation that norm_b deletes, sentence ends, the token pattern.
PUNCTUATION = "，。！？、；：（）【】《》“”‘’,.!?;:()[]<>\"'"
SENTENCE_ENDS = "。！!?？\n"
TOKEN = "[a-z0-9]+|[一-鿿]"
_TOKEN = re.compile(TOKEN)


@F.pandas_udf(StringType())
def norm_a(x: pd.Series) -> pd.Series:
    """NFKC, lower case, no white space; null stays null."""
    return x.map(lambda s: None if s is None else "".join(unicodedata.normalize("NFKC", s).lower().split()))


def norm_b(x: Column) -> Column:
    """Lower case without white space and listed punctuation; no NFKC."""
    inside = "".join("\\" + c for c in PUNCTUATION)
    return F.regexp_replace(F.lower(x), rf"[\s{inside}]", "")


def norm_c(x: Column) -> Column:
    """Without white space, then lower case."""
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 and single Han characters, after lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def _arrays(ids, at) -> pd.Series:
    return pd.Series([ids[a:b] for a, b in zip(at[:-1], at[1:])])


@F.pandas_udf(ArrayType(LongType()))
def token_grams(x: pd.Series) -> pd.Series:
    """The set of three-token grams as 64-bit ids, ascending; empty below three tokens and for null."""
    return _arrays(*K.token_gram_sets([s.lower() if s else "" for s in x]))


def bare(s: str | None) -> str:
    """A text without white space; null gives the empty text."""
    return "".join((s or "").split())


@F.pandas_udf(ArrayType(LongType()))
def char_grams(x: pd.Series) -> pd.Series:
    """The set of three-character grams without white space as 64-bit ids; a shorter text is its own gram."""
    return _arrays(*K.char_gram_sets([bare(s) for s in x]))


def char_ngrams(x: Column, n: int) -> Column:
    """All character n-grams without white space, repeats included; empty below n characters."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (n - 1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard index of two sets given as arrays; one empty gives 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def last_sentence(x: Column) -> Column:
    """What follows the last sentence end, the final character not counting as one."""
    return F.regexp_extract(x, r"(?s)([^。！!?？\n]*.?)\z", 1)


def strip_last(x: Column) -> Column:
    """Up to and with the last sentence end before the final character; empty if there is none."""
    return F.regexp_extract(x, r"(?s)^(.*[。！!?？\n])(?=.)", 1)


def strip_think(x: Column) -> Column:
    """Without closed thinking blocks, trimmed."""
    return F.btrim(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""), F.lit(" \t\r\n"))


def strip_empty_think(x: Column) -> Column:
    return F.regexp_replace(x, r"<think>\s*</think>\s*", "")


def has_think(x: Column) -> Column:
    return F.contains(x, F.lit("<think>")) | F.contains(x, F.lit("</think>"))


def _kept(x: Column, others: str) -> Column:
    return F.length(F.regexp_replace(x, others, ""))


def han_ratio(x: Column) -> Column:
    """Han characters over characters that aren't white space; 0 if there are none."""
    total = _kept(x, r"\s")
    return F.when(total > 0, _kept(x, "[^一-鿿]") / total).otherwise(F.lit(0.0))


def latin_ratio(x: Column) -> Column:
    total = _kept(x, r"\s")
    return F.when(total > 0, _kept(x, "[^A-Za-z]") / total).otherwise(F.lit(0.0))


def group_key(x: Column) -> Column:
    """First twelve hex digits of the SHA-1 of norm_a."""
    return F.substring(F.sha1(norm_a(x)), 1, 12)


def estimated_tokens(x: Column) -> Column:
    """Stand-in for a model's tokenizer: the number of tokens as above."""
    return F.size(tokens(x))


def user_text(instruction: Column, more: Column, gap: str = "\n") -> Column:
    """Instruction, and the input below it unless blank."""
    blank = F.trim(F.coalesce(more, F.lit(""))) == ""
    return F.when(blank, instruction).otherwise(F.concat(instruction, F.lit(gap), more))


def chat_prompt(system: str, user: Column, empty_think: bool = False) -> Column:
    """Chat markup up to the assistant's turn, with or without an empty thinking block."""
    tail = "<|im_end|>\n<|im_start|>assistant\n" + ("<think>\n\n</think>\n\n" if empty_think else "")
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user, F.lit(tail))


def user_segment(prompt: Column) -> Column:
    return F.regexp_extract(prompt, r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>", 1)


def strip_markup(x: Column) -> Column:
    """Without inline markup: images, links, bold, italics, code."""
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1")):
        x = F.regexp_replace(x, pattern, to)
    return x


def json_block(x: Column, opening: str = "{", closing: str = "}") -> Column:
    """From the first opening to the last closing sign, for JSON inside other text; empty if there is none."""
    return F.regexp_extract(x, rf"(?s)(\{opening}.*\{closing})", 1)


def repaired_answer(x: Column, least: int = 100) -> Column:
    """The body of an answer wrapped in ``{"index": n, "answer": "...``; null if it is shorter than ``least``."""
    body = F.regexp_extract(x, r'(?s)^\s*\{"index":\s*\d+,\s*"answer":\s*"(.*?)(?:"\s*\}\s*)?$', 1)
    return F.when(~x.rlike(r'^\s*\{"index":\s*\d+,\s*"answer":'), x).when(F.length(body) >= least, body)
