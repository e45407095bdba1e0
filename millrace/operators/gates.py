"""Quality gates: named boolean columns, an ordered runner, and the gates that look at more than one row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import first_rows
from ..shared import cut


@dataclass(frozen=True)
class Gate:
    """A row passes where ``keep`` is true; null fails."""

    name: str
    keep: Column


def min_length(column: str, least: int) -> Gate:
    return Gate(f"min_length_{least}", F.length(column) >= least)


def not_empty(column: str) -> Gate:
    return Gate("not_empty", F.length(F.btrim(F.col(column), F.lit(" \t\r\n"))) > 0)


def no_think(column: str) -> Gate:
    return Gate("no_think", ~T.has_think(F.col(column)))


def han_share(column: str, least: float = 0.3) -> Gate:
    return Gate("han_share", T.han_ratio(F.col(column)) >= least)


def no_draft(column: str, markers: tuple[str, ...] = ("draft", "let me", "okay,", "the user"), share: float = 0.7) -> Gate:
    """Fails answers mainly in Latin script that open with a marker of a draft."""
    head = F.lower(F.substring(F.col(column), 1, 300))
    return Gate("no_draft", ~((T.latin_ratio(F.col(column)) > share) & head.rlike("|".join(markers))))


def max_tokens(columns: tuple[str, ...], most: int = 2048, count: Callable[[Column], Column] = T.estimated_tokens) -> Gate:
    total = sum((F.coalesce(count(F.col(c)), F.lit(0)) for c in columns), F.lit(0))
    return Gate(f"max_tokens_{most}", total <= most)


def max_chars(columns: tuple[str, ...], most: int = 4096) -> Gate:
    total = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0))
    return Gate(f"max_chars_{most}", total <= most)


def run_gates(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """Adds ``failures`` (names in the order of the gates) and ``passed``."""
    failures = F.array_compact(F.array(*(F.when(~F.coalesce(g.keep, F.lit(False)), F.lit(g.name)) for g in gates)))
    return df.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def gate_summary(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """Rows, passes and failures of every gate in one pass over the table."""
    failing = [F.count_if(~F.coalesce(g.keep, F.lit(False))).alias(f"_{i}") for i, g in enumerate(gates)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *failing)
    rows = F.explode(F.array(*(F.struct(F.lit(g.name).alias("gate"), F.col(f"_{i}").alias("failed")) for i, g in enumerate(gates))))
    return one.select("rows", rows.alias("g")).select("g.gate", "rows", "g.failed", (F.col("rows") - F.col("g.failed")).alias("passed"))


def funnel(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """How many rows are left after each gate, applied in order: ``step``, ``gate``, ``kept``, ``dropped``; one pass."""
    alive = F.lit(True)
    kept = [F.count(F.lit(1)).alias("_0")]
    for i, g in enumerate(gates, 1):
        alive = alive & F.coalesce(g.keep, F.lit(False))
        kept.append(F.count_if(alive).alias(f"_{i}"))
    one = df.agg(*kept)
    steps = [F.struct(F.lit(0).alias("step"), F.lit("input").alias("gate"), F.col("_0").alias("kept"), F.lit(0).cast("long").alias("dropped"))]
    steps += [F.struct(F.lit(i).alias("step"), F.lit(g.name).alias("gate"), F.col(f"_{i}").alias("kept"), (F.col(f"_{i - 1}") - F.col(f"_{i}")).alias("dropped")) for i, g in enumerate(gates, 1)]
    return one.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def length_reason(x: Column, low: int, high: int) -> Column:
    """``empty``, ``too_short``, ``too_long`` or ``ok``."""
    n = F.length(F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n")))
    return F.when(n == 0, "empty").when(n < low, "too_short").when(n > high, "too_long").otherwise("ok")


def min_length_against(df: DataFrame, base: DataFrame, key: str, column: str, floor: int, share: float = 0.03) -> DataFrame:
    """Adds ``passed``: at least ``floor`` characters and ``share`` of the base text of the same key (none: 0)."""
    b = base.select(F.col(key), F.length(column).alias("_base"))
    need = F.greatest(F.lit(floor).cast("double"), F.coalesce("_base", F.lit(0)) * share)
    return df.join(b, key, "left").withColumn("passed", F.coalesce(F.length(column), F.lit(0)) >= need).drop("_base")


def frequent_tails(df: DataFrame, column: str, chars: int = 80, least: int = 3) -> DataFrame:
    """(tail, n): ends that stand in at least ``least`` rows. Partial counts meet before the shuffle, so a frequent tail is cheap."""
    return df.where(F.length(column) > 0).groupBy(F.right(F.col(column), F.lit(chars)).alias("tail")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def frequent_last_sentences(df: DataFrame, column: str, least: int = 3, chars: int = 8) -> DataFrame:
    """(sentence, n): last sentences of at least ``chars`` characters in at least ``least`` rows."""
    s = F.btrim(T.last_sentence(F.col(column)), F.lit(" \t\r\n"))
    return df.where(F.col(column).isNotNull()).select(s.alias("sentence")).where(F.length("sentence") >= chars).groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: White space that Python's strip() removes.
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _last(x: Column) -> tuple[Column, Column]:
    """A text without white space at its end, and its last sentence; by plain functions, as a pattern would search from every character."""
    t = F.rtrim(x, F.lit(_SPACE))
    head = F.translate(F.left(t, F.length(t) - 1), T.SENTENCE_ENDS, "\n" * len(T.SENTENCE_ENDS))
    return t, F.concat(F.substring_index(head, "\n", -1), F.right(t, F.lit(1)))


def _without_last(x: Column) -> Column:
    t, last = _last(x)
    return F.left(t, F.length(t) - F.length(last))


def _tail_keys(x: Column, chars: int, shortest: int) -> list[Column]:
    """Digests of the last ``chars`` characters, and of the last sentence if it has at least ``shortest``; null for none."""
    last = F.btrim(_last(x)[1], F.lit(_SPACE))
    digest = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(kind), c)))
    return [F.when(F.length(x) > 0, digest("tail:", F.right(x, F.lit(chars)))), F.when(F.length(last) >= shortest, digest("sentence:", last))]


def drop_template_tails(df: DataFrame, column: str, chars: int = 80, least: int = 3, rounds: int = 10, keep: int = 150, shortest: int = 8) -> DataFrame:
    """Cuts the last sentence while the last ``chars`` characters or the last sentence are frequent, up to ``rounds`` times; rows cut below ``keep`` characters go.

    Frequencies are of the input: ends that stand in at least ``least`` rows, and last
    sentences of ``shortest`` characters or more that do. Adds ``cut`` (sentences
    removed). An empty text has nothing to cut. Only digests of the ends of all rows
    are shuffled; rounds go over the distinct texts that are still cut, and the lists
    may be of any size.
    """
    names = df.columns
    keys = lambda x: F.explode(F.array_compact(F.array(*_tail_keys(x, chars, shortest))))
    ends = cut(df.select(F.unhex(F.md5(column)).alias("_t"), keys(F.col(column)).alias("_k")))
    bad = cut(ends.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_k"))
    hit = ends.join(bad, "_k", "left_semi").select("_t").distinct()
    left = df.select(F.unhex(F.md5(column)).alias("_t"), F.col(column).alias("_x")).join(hit, "_t", "left_semi").dropDuplicates(["_t"])
    done = None
    for i in range(1, rounds + 1):
        now = cut(left.select("_t", _without_last(F.col("_x")).alias("_x"), F.lit(i).alias("_c")))
        hit = now.select("_t", keys(F.col("_x")).alias("_k")).join(bad, "_k", "left_semi").select("_t").distinct()
        left = now.join(hit, "_t", "left_semi")
        last = now if i == rounds else now.join(hit, "_t", "left_anti")
        done = last if done is None else done.unionByName(last)
        if not left.limit(1).count():
            break
    out = df.withColumn("_t", F.unhex(F.md5(column))).join(done, "_t", "left")
    out = out.select(*(F.coalesce("_x", c).alias(c) if c == column else F.col(c) for c in names), F.coalesce("_c", F.lit(0)).alias("cut"))
    return out.where((F.col("cut") == 0) | (F.length(column) >= keep))


def at_most_per_key(df: DataFrame, key: Column, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; a hot key is cut down in hash parts first."""
    return first_rows(df, [key], order, most)


def contains_any(x: Column, phrases: list[str]) -> Column:
    """Whether a text has any of the phrases, letter case aside; false for null."""
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def normalized_choice(x: Column, allowed: list[str], default: str) -> Column:
    """A name trimmed, in lower case, with ``-`` and spaces as ``_``, if it is allowed; else the default."""
    n = F.regexp_replace(F.lower(F.trim(x)), r"[\s\-]+", "_")
    return F.when(n.isin(*allowed), n).otherwise(F.lit(default))


def below_percentile(df: DataFrame, score: str, q: float) -> DataFrame:
    """Rows whose score is at most the exact q-quantile; rows without a score go."""
    cut = df.agg(F.percentile(score, F.lit(q)).alias("_cut"))
    return df.join(F.broadcast(cut)).where(F.col(score) <= F.col("_cut")).drop("_cut")


def repeats_window(x: Column, size: int = 80, step: int = 200, most: int = 6000, least: int = 3, longer: int = 500) -> Column:
    """Whether a window of ``size`` characters, begun every ``step`` before place ``most``, stands at least ``least`` times in a text of more than ``longer``."""
    last = F.least(F.length(x) - size, F.lit(most)) - 1
    begins = F.sequence(F.lit(1), F.greatest(F.lit(0), last) + 1, F.lit(step))

    def often(i: Column) -> Column:
        return (F.length(x) - F.length(F.replace(x, F.substring(x, i, F.lit(size)), F.lit("")))) >= size * least

    return F.when(F.length(x) > longer, F.exists(begins, often)).otherwise(False)


def identity_denied(question: Column, answer: Column, asks: str, denies: str) -> Column:
    """Whether a question asks who answers (pattern ``asks``) and the answer denies it (pattern ``denies``)."""
    return F.coalesce(F.rlike(question, F.lit(f"(?i){asks}")) & F.rlike(answer, F.lit(denies)), F.lit(False))


def failure_flags(x: Column, runaway: int = 30_000) -> Column:
    """Names of what is wrong with an answer: ``empty``, ``runaway``, ``loop``."""
    text = F.coalesce(x, F.lit(""))
    return F.array_compact(F.array(F.when(F.length(F.btrim(text, F.lit(" \t\r\n"))) == 0, "empty"), F.when(F.length(text) > runaway, "runaway"), F.when(repeats_window(text), "loop")))


def valid_calls(calls: Column) -> Column:
    """Of an array of (name, arguments) structs, those whose arguments are valid JSON."""
    return F.filter(calls, lambda c: F.expr("true") & F.try_parse_json(c["arguments"]).isNotNull())


def id_columns(df: DataFrame, parts: tuple[str, ...] = ("id", "source", "chunk", "path")) -> list[str]:
    """Columns that look like identifiers, by name."""
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def contract_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule isn't true."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("r")).select("r.*")
