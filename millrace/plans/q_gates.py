"""Gates, projections and text functions (T, F, P) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import gates as G
from ..operators import scoring as E
from ..operators.ranking import numbered
from .q_dedup import norm_a_sql
from .registry import query, table

def _gates() -> list[G.Gate]:
    return [G.not_empty("output"), G.no_think("output"), G.min_length("output", 150), G.han_share("output"), G.max_chars(("instruction", "output"), 4096)]


_NAMES = ("not_empty", "no_think", "min_length_150", "han_share", "max_chars_4096")
#: The same gates in SQL, in order.
_GATE_SQL = (
    "length(trim(output, ' ' || chr(9) || chr(13) || chr(10))) > 0",
    "NOT (contains(output, '<think>') OR contains(output, '</think>'))",
    "length(output) >= 150",
    "CASE WHEN length(regexp_replace(output, '\\s', '', 'g')) > 0 THEN length(regexp_replace(output, '[^一-鿿]', '', 'g')) / length(regexp_replace(output, '\\s', '', 'g')) ELSE 0 END >= 0.3",
    "coalesce(length(instruction), 0) + coalesce(length(output), 0) <= 4096",
)
_STRIP = "trim(regexp_replace(output, '<think>.*?</think>', '', 'gs'), ' ' || chr(9) || chr(13) || chr(10))"


def _funnel_sql() -> str:
    names = _NAMES
    keep, counts = "true", ["count(*) AS k0"]
    for i, g in enumerate(_GATE_SQL, 1):
        keep += f" AND coalesce({g}, false)"
        counts.append(f"count(*) FILTER (WHERE {keep}) AS k{i}")
    rows = ["SELECT 0 AS step, 'input' AS gate, k0 AS kept, CAST(0 AS BIGINT) AS dropped FROM c"]
    rows += [f"SELECT {i} AS step, '{n}' AS gate, k{i} AS kept, k{i - 1} - k{i} AS dropped FROM c" for i, n in enumerate(names, 1)]
    return f"WITH c AS (SELECT {', '.join(counts)} FROM data_build) " + " UNION ALL ".join(rows)


@query("v02_gate_funnel", _funnel_sql())
def _(s, d):
    return G.funnel(table(s, d, "data_build"), _gates())


@query("f13_gate_summary", "WITH c AS (SELECT * FROM data_build) " + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce({q}, false)) AS failed, count(*) FILTER (WHERE coalesce({q}, false)) AS passed FROM c" for g, q in zip(_NAMES, _GATE_SQL)))
def _(s, d):
    return G.gate_summary(table(s, d, "data_build"), _gates())


@query("f13_gate_failures", "SELECT sample_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({q}, false) THEN '{g}' END" for g, q in zip(_NAMES, _GATE_SQL)) + "], lambda x: x IS NOT NULL), ',') AS failures FROM data_build")
def _(s, d):
    return G.run_gates(table(s, d, "data_build"), _gates()).select("sample_id", F.array_join("failures", ",").alias("failures"))


@query("t02_norm_b_lengths", "SELECT sample_id, length(regexp_replace(lower(instruction), '[\\s，。！？、；：（）【】《》“”‘’,.!?;:()\\[\\]<>\"'']', '', 'g')) AS n FROM data_build")
def _(s, d):
    return table(s, d, "data_build").select("sample_id", F.length(T.norm_b(F.col("instruction"))).alias("n"))


@query("t03_norm_c_digest", "SELECT record_id, md5(lower(regexp_replace(instruction, '\\s+', '', 'g'))) AS digest FROM assemble_v5")
def _(s, d):
    return table(s, d, "assemble_v5").select("record_id", F.md5(T.norm_c(F.col("instruction"))).alias("digest"))


@query("t01_norm_a", f"SELECT record_id, md5({norm_a_sql('instruction')}) AS digest FROM assemble_v5")
def _(s, d):
    return table(s, d, "assemble_v5").select("record_id", F.md5(T.norm_a("instruction")).alias("digest"))


@query("t04_tokens", "SELECT record_id, CASE WHEN instruction IS NULL THEN -1 ELSE len(regexp_extract_all(lower(instruction), '[a-z0-9]+|[一-鿿]')) END AS tokens FROM assemble_v5")
def _(s, d):
    return table(s, d, "assemble_v5").select("record_id", F.coalesce(F.size(T.tokens(F.col("instruction"))), F.lit(-1)).cast("long").alias("tokens"))


@query("t05_gram_counts", "WITH t AS (SELECT record_id, regexp_extract_all(lower(coalesce(instruction, '')), '[a-z0-9]+|[一-鿿]') AS t FROM assemble_v5) SELECT record_id, CASE WHEN len(t) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) END AS grams FROM t")
def _(s, d):
    return table(s, d, "assemble_v5").select("record_id", F.size(T.token_grams("instruction")).cast("long").alias("grams"))


@query("t06_char_grams", "WITH t AS (SELECT sample_id, regexp_replace(coalesce(instruction, ''), '[\\s\\x{3000}\\x{00A0}\\x{000B}]+', '', 'g') AS t FROM data_build) SELECT sample_id, CASE WHEN length(t) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))) END AS grams FROM t")
def _(s, d):
    return table(s, d, "data_build").select("sample_id", F.size(T.char_grams("instruction")).cast("long").alias("grams"))


@query("t08_question_answer_jaccard", "WITH t AS (SELECT id, regexp_extract_all(lower(question), '[a-z0-9]+|[一-鿿]') AS a, regexp_extract_all(lower(coalesce(reference_answer, '')), '[a-z0-9]+|[一-鿿]') AS b FROM gold_items), g AS (SELECT id, CASE WHEN len(a) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) END AS a, CASE WHEN len(b) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(b) - 1), lambda i: b[i] || ' ' || b[i + 1] || ' ' || b[i + 2])) END AS b FROM t), n AS (SELECT id, len(a) + len(b) - len(list_intersect(a, b)) AS u, len(list_intersect(a, b)) AS i FROM g) SELECT id, round(CASE WHEN u = 0 THEN 1.0 ELSE i / u END, 6) AS j FROM n")
def _(s, d):
    g = table(s, d, "gold_items").select("id", T.token_grams("question").alias("a"), T.token_grams("reference_answer").alias("b"))
    return g.select("id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query("t11_last_sentence", "SELECT sample_id, md5(regexp_extract(output, '([^。！!?？\\n]*.?)$', 1, 's')) AS digest FROM data_build WHERE output IS NOT NULL")
def _(s, d):
    return table(s, d, "data_build").where("output is not null").select("sample_id", F.md5(T.last_sentence(F.col("output"))).alias("digest"))


@query("f01_think_stripped", f"SELECT sample_id, contains(output, '<think>') AS had, length({_STRIP}) AS n FROM data_build WHERE output IS NOT NULL")
def _(s, d):
    x = F.col("output")
    return table(s, d, "data_build").where("output is not null").select("sample_id", F.contains(x, F.lit("<think>")).alias("had"), F.length(T.strip_think(x)).alias("n"))


@query("f02_empty_think", "SELECT count(*) AS n FROM data_build WHERE regexp_replace(output, '<think>\\s*</think>\\s*', '', 'g') <> output")
def _(s, d):
    return table(s, d, "data_build").where(T.strip_empty_think(F.col("output")) != F.col("output")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_think_residue", "SELECT subset, count(*) AS n FROM data_build WHERE contains(output, '<think>') OR contains(output, '</think>') GROUP BY subset")
def _(s, d):
    return table(s, d, "data_build").where(T.has_think(F.col("output"))).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("f06_length_reasons", "WITH r AS (SELECT length(trim(coalesce(output, ''), ' ' || chr(9) || chr(13) || chr(10))) AS n FROM data_build) SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 150 THEN 'too_short' WHEN n > 600 THEN 'too_long' ELSE 'ok' END AS reason, count(*) AS n FROM r GROUP BY 1")
def _(s, d):
    return table(s, d, "data_build").groupBy(G.length_reason(F.col("output"), 150, 600).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_max_tokens", "SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(len(regexp_extract_all(lower(instruction), '[a-z0-9]+|[一-鿿]')), 0) + coalesce(len(regexp_extract_all(lower(output), '[a-z0-9]+|[一-鿿]')), 0) <= 300) AS kept FROM assemble_v5")
def _(s, d):
    g = G.max_tokens(("instruction", "output"), 300)
    return table(s, d, "assemble_v5").agg(F.count(F.lit(1)).alias("rows"), F.count_if(g.keep).alias("kept"))


@query("f10_han_ratio", "SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) > 0 THEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g')) ELSE 0 END, 6) AS ratio FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.round(T.han_ratio(F.col("text")), 6).alias("ratio"))


@query("f11_latin_drafts", "SELECT count(*) AS n FROM data_build WHERE length(regexp_replace(output, '\\s', '', 'g')) > 0 AND length(regexp_replace(output, '[^A-Za-z]', '', 'g')) / length(regexp_replace(output, '\\s', '', 'g')) > 0.7 AND regexp_matches(lower(substring(output, 1, 300)), 'the team|the first')")
def _(s, d):
    g = G.no_draft("output", ("the team", "the first"))
    return table(s, d, "data_build").where(~g.keep).agg(F.count(F.lit(1)).alias("n"))


@query("f12_length_against_base", "SELECT d.sample_id, coalesce(length(d.output), 0) >= greatest(CAST(100 AS DOUBLE), coalesce(length(a.output), 0) * 0.5) AS passed FROM data_build d LEFT JOIN assemble_v5 a ON a.record_id = d.sample_id")
def _(s, d):
    base = table(s, d, "assemble_v5").select(F.col("record_id").alias("sample_id"), "output")
    return G.min_length_against(table(s, d, "data_build"), base, "sample_id", "output", 100, 0.5).select("sample_id", "passed")


@query("f14_frequent_tails", "SELECT right(output, 80) AS tail, count(*) AS n FROM data_build WHERE length(output) > 0 GROUP BY 1 HAVING count(*) >= 3")
def _(s, d):
    return G.frequent_tails(table(s, d, "data_build"), "output")


@query("f14_frequent_last_sentences", "WITH l AS (SELECT trim(regexp_extract(output, '([^。！!?？\\n]*.?)$', 1, 's'), ' ' || chr(9) || chr(13) || chr(10)) AS sentence FROM data_build WHERE output IS NOT NULL) SELECT sentence, count(*) AS n FROM l WHERE length(sentence) >= 8 GROUP BY 1 HAVING count(*) >= 3")
def _(s, d):
    return G.frequent_last_sentences(table(s, d, "data_build"), "output")


@query("f15_tail_truncation")
def _(s, d):
    out = G.drop_template_tails(table(s, d, "data_build").where("output is not null").select("sample_id", "output"), "output")
    return out.select("sample_id", "cut", F.length("output").alias("chars"))


@query("f17_template_quota", "WITH r AS (SELECT record_id, row_number() OVER (PARTITION BY right(output, 80) ORDER BY record_id) AS k FROM assemble_v5 WHERE output IS NOT NULL) SELECT record_id FROM r WHERE k <= 2")
def _(s, d):
    rows = table(s, d, "assemble_v5").where("output is not null").select("record_id", "output")
    return G.at_most_per_key(rows, F.right(F.col("output"), F.lit(80)), [F.col("record_id")], 2).select("record_id")


@query("f18_refusal_with_alternative", "SELECT count(*) AS n FROM data_build WHERE (contains(lower(output), '抱歉') OR contains(lower(output), '无法') OR contains(lower(output), 'sorry')) AND (contains(lower(output), '建议') OR contains(lower(output), '请'))")
def _(s, d):
    x = F.col("output")
    return table(s, d, "data_build").where(G.contains_any(x, ["抱歉", "无法", "sorry"]) & G.contains_any(x, ["建议", "请"])).agg(F.count(F.lit(1)).alias("n"))


@query("f19_hedging", "SELECT sample_id, len(regexp_extract_all(output, '可能|或许|大概|perhaps|maybe')) AS hedges FROM data_build WHERE output IS NOT NULL")
def _(s, d):
    return table(s, d, "data_build").where("output is not null").select("sample_id", F.regexp_count("output", F.lit("可能|或许|大概|perhaps|maybe")).cast("long").alias("hedges"))


@query("f20_numbered_entities", "WITH r AS (SELECT sample_id, list_filter(list_transform(regexp_extract_all(coalesce(output, ''), '第\\s*([0-9]{1,3})', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 40) AS l FROM data_build) SELECT sample_id, array_to_string(list_sort(list_distinct(l)), ',') AS found FROM r")
def _(s, d):
    return table(s, d, "data_build").select("sample_id", F.array_join(E.numbered_entities(F.col("output"), "第").cast("array<string>"), ",").alias("found"))


@query("f21_question_intent", "SELECT count(*) AS n FROM assemble_v5 WHERE contains(instruction, '原理') AND regexp_matches(instruction, '推荐|选择|适用|应用')")
def _(s, d):
    x = F.col("instruction")
    return table(s, d, "assemble_v5").where(F.contains(x, F.lit("原理")) & x.rlike("推荐|选择|适用|应用")).agg(F.count(F.lit(1)).alias("n"))


@query("f22_gold_validation", "SELECT id, coalesce(length(reference_answer), 0) >= 40 AND len(list_filter(keywords, lambda k: contains(coalesce(reference_answer, ''), k))) >= 1 AS valid, len(list_filter(keywords, lambda k: contains(coalesce(reference_answer, ''), k))) AS kept FROM gold_items")
def _(s, d):
    kept = F.filter("keywords", lambda k: F.contains(F.coalesce("reference_answer", F.lit("")), k))
    return table(s, d, "gold_items").select("id", ((F.coalesce(F.length("reference_answer"), F.lit(0)) >= 40) & (F.size(kept) >= 1)).alias("valid"), F.size(kept).cast("long").alias("kept"))


@query("f23_gold_checks", "SELECT id, question IS NOT NULL AND length(question) >= 10 AS has_question, reference_answer IS NOT NULL AS has_answer, len(keywords) BETWEEN 1 AND 6 AS keyword_count, subset IS NOT NULL OR ref_set = 'B' AS has_subset FROM gold_items")
def _(s, d):
    n = F.size("keywords")
    return table(s, d, "gold_items").select("id", (F.col("question").isNotNull() & (F.length("question") >= 10)).alias("has_question"), F.col("reference_answer").isNotNull().alias("has_answer"), n.between(1, 6).alias("keyword_count"), (F.col("subset").isNotNull() | (F.col("ref_set") == "B")).alias("has_subset"))


@query("f25_subset_names", "WITH n AS (SELECT regexp_replace(lower(trim(lang)), '[\\s\\-]+', '_', 'g') AS l FROM documents) SELECT CASE WHEN l IN ('zh', 'zh_cn', 'en', 'en_us', 'de', 'fr') THEN l ELSE 'other' END AS lang, count(*) AS n FROM n GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy(G.normalized_choice(F.col("lang"), ["zh", "zh_cn", "en", "en_us", "de", "fr"], "other").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("f26_below_percentile", "SELECT count(*) AS n FROM documents WHERE n_chars <= (SELECT quantile_cont(n_chars, 0.8) FROM documents)")
def _(s, d):
    return G.below_percentile(table(s, d, "documents").select("n_chars"), "n_chars", 0.8).agg(F.count(F.lit(1)).alias("n"))


@query("f28_phrase_rate", "SELECT count(*) AS n, count(*) FILTER (WHERE contains(lower(coalesce(output, '')), '我无法') OR contains(lower(coalesce(output, '')), 'i''m sorry')) AS hits FROM data_build")
def _(s, d):
    return table(s, d, "data_build").agg(F.count(F.lit(1)).alias("n"), F.count_if(G.contains_any(F.col("output"), ["我无法", "i'm sorry"])).alias("hits"))


_LOOP = "len(list_filter(range(0, least(length(text) - 80, 6000), 200), lambda i: (length(text) - length(replace(text, substring(text, i + 1, 80), ''))) >= 240)) > 0"


@query("f29_failure_flags", f"WITH f AS (SELECT [CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)) = '' THEN 'empty' END, CASE WHEN length(text) > 30000 THEN 'runaway' END, CASE WHEN length(text) > 500 AND {_LOOP} THEN 'loop' END] AS l FROM documents) SELECT unnest AS flag, count(*) AS n FROM f, unnest(l) WHERE unnest IS NOT NULL GROUP BY 1")
def _(s, d):
    flags = table(s, d, "documents").select(F.explode(G.failure_flags(F.col("text"))).alias("flag"))
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("f30_candidates", "SELECT count(*) AS n FROM decon_review_queue WHERE a.j >= 0.42 AND b.j >= 0.42")
def _(s, d):
    return table(s, d, "decon_review_queue").where("a.j >= 0.42 and b.j >= 0.42").agg(F.count(F.lit(1)).alias("n"))


@query("f33_id_columns", "SELECT 'id' AS name, count(id) AS filled, count(DISTINCT id) AS \"values\" FROM corpus_builder UNION ALL SELECT 'source_path', count(source_path), count(DISTINCT source_path) FROM corpus_builder")
def _(s, d):
    """Columns that look like identifiers, with their non-null rows and distinct values."""
    rows = table(s, d, "corpus_builder")
    names = G.id_columns(rows)
    c = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("v")) for n in names))).alias("x")).select("x.*")
    return c.groupBy("name").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("values"))


@query("f34_row_filter", "SELECT file_type, count(*) AS n FROM corpus_builder WHERE title IS NOT NULL AND text IS NOT NULL AND file_type IN ('pdf', 'docx') GROUP BY file_type")
def _(s, d):
    return table(s, d, "corpus_builder").where("title is not null and text is not null and file_type in ('pdf', 'docx')").groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


@query("f35_contract", "SELECT 'instruction' AS rule, count(*) FILTER (WHERE NOT coalesce(length(instruction) > 0, false)) AS violations FROM assemble_v5 UNION ALL SELECT 'style', count(*) FILTER (WHERE NOT coalesce(style IN ('short', 'long'), false)) FROM assemble_v5 UNION ALL SELECT 'split', count(*) FILTER (WHERE NOT coalesce(split IN ('train', 'validation', 'test'), false)) FROM assemble_v5")
def _(s, d):
    return G.contract_violations(table(s, d, "assemble_v5"), {"instruction": F.length("instruction") > 0, "style": F.col("style").isin("short", "long"), "split": F.col("split").isin("train", "validation", "test")})


_PROMPT = "'<|im_start|>system' || chr(10) || 'S<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {u} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_USER = "(CASE WHEN trim(coalesce(input, '')) = '' THEN instruction ELSE instruction || chr(10) || input END)"


@query("p01_chat_prompt", f"SELECT sample_id, md5({_PROMPT.format(u=_USER)}) AS digest FROM data_build")
def _(s, d):
    user = T.user_text(F.col("instruction"), F.col("input"))
    return table(s, d, "data_build").select("sample_id", F.md5(T.chat_prompt("S", user)).alias("digest"))


@query("p02_think_block_kept", f"SELECT sample_id, length({_PROMPT.format(u=_USER)}) + 19 AS n FROM data_build WHERE instruction IS NOT NULL")
def _(s, d):
    user = T.user_text(F.col("instruction"), F.col("input"))
    return table(s, d, "data_build").where("instruction is not null").select("sample_id", F.length(T.chat_prompt("S", user, True)).alias("n"))


@query("p04_repaired_answers", "WITH b AS (SELECT sample_id, output, regexp_matches(output, '^\\s*\\{\"index\":\\s*\\d+,\\s*\"answer\":') AS wrapped, regexp_extract(output, '^\\s*\\{\"index\":\\s*\\d+,\\s*\"answer\":\\s*\"(.*?)(?:\"\\s*\\}\\s*)?$', 1, 's') AS body FROM data_build WHERE output IS NOT NULL) SELECT sample_id, length(CASE WHEN NOT wrapped THEN output WHEN length(body) >= 100 THEN body END) AS n FROM b")
def _(s, d):
    return table(s, d, "data_build").where("output is not null").select("sample_id", F.length(T.repaired_answer(F.col("output"))).alias("n"))


@query("p06_json_block", "SELECT sample_id, length(regexp_extract(output, '(\\{.*\\})', 1, 's')) AS n FROM data_build WHERE contains(output, '{')")
def _(s, d):
    return table(s, d, "data_build").where(F.contains("output", F.lit("{"))).select("sample_id", F.length(T.json_block(F.col("output"))).alias("n"))


@query("p09_user_segment", "SELECT sample_id, instruction AS u FROM data_build WHERE instruction IS NOT NULL AND trim(coalesce(input, '')) = ''")
def _(s, d):
    rows = table(s, d, "data_build").where("instruction is not null and trim(coalesce(input, '')) = ''")
    return rows.select("sample_id", T.user_segment(T.chat_prompt("S", F.col("instruction"))).alias("u"))


@query("p10_literal_fix", "SELECT count(*) AS n, sum(length(replace(text, '百分点', '个百分点'))) AS chars FROM documents WHERE contains(text, '百分点')")
def _(s, d):
    return table(s, d, "documents").where(F.contains("text", F.lit("百分点"))).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.replace("text", F.lit("百分点"), F.lit("个百分点")))).alias("chars"))


@query("p11_round_robin", "WITH r AS (SELECT record_id, row_number() OVER (PARTITION BY subset ORDER BY record_id) AS k FROM assemble_v5) SELECT k % 4 AS opening, count(*) AS n FROM r GROUP BY 1")
def _(s, d):
    r = numbered(table(s, d, "assemble_v5").select("subset", "record_id"), ["subset"], [F.col("record_id")])
    return r.groupBy((F.col("k") % 4).cast("long").alias("opening")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_first_match", "SELECT CASE WHEN contains(text, '电') THEN 'electric' WHEN contains(text, '水') THEN 'water' WHEN contains(text, '光') THEN 'light' ELSE 'none' END AS domain, count(*) AS n FROM corpus_builder GROUP BY 1")
def _(s, d):
    x = F.coalesce("text", F.lit(""))
    hit = lambda c: F.contains(x, F.lit(c))
    return table(s, d, "corpus_builder").groupBy(F.when(hit("电"), "electric").when(hit("水"), "water").when(hit("光"), "light").otherwise("none").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_upsample", "SELECT origin, count(*) AS n FROM assemble_v5, range(1, 4) WHERE starts_with(origin, 'seed') GROUP BY origin")
def _(s, d):
    rows = table(s, d, "assemble_v5").where(F.startswith("origin", F.lit("seed"))).select("origin", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("p16_cut_marker", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN length(substring(text, 1, 2000) || '...') ELSE length(text) END AS n FROM documents WHERE text IS NOT NULL")
def _(s, d):
    x = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(F.when(F.length(x) > 2000, F.concat(F.substring(x, 1, 2000), F.lit("..."))).otherwise(x)).alias("n"))


@query("p17_group_key", f"SELECT record_id, substring(sha1({norm_a_sql('instruction')}), 1, 12) AS k FROM assemble_v5 WHERE instruction IS NOT NULL")
def _(s, d):
    return table(s, d, "assemble_v5").where("instruction is not null").select("record_id", T.group_key(F.col("instruction")).alias("k"))


@query("p23_markup_stripped", "SELECT sample_id, length(regexp_replace(regexp_replace(regexp_replace(output, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '`([^`]+)`', '\\1', 'g')) AS n FROM data_build WHERE output IS NOT NULL AND NOT contains(output, '](')")
def _(s, d):
    return table(s, d, "data_build").where(F.col("output").isNotNull() & ~F.contains("output", F.lit("]("))).select("sample_id", F.length(T.strip_markup(F.col("output"))).alias("n"))


@query("s15_markdown_blocks")
def _(s, d):
    b = C.markdown_blocks(table(s, d, "data_build"), "sample_id", "output")
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s15_table_cells", "SELECT count(*) AS n FROM data_build WHERE regexp_matches(output, '(?m)^\\s*\\|.*\\|\\s*$')")
def _(s, d):
    return table(s, d, "data_build").where(F.size(C.table_rows("output")) > 0).agg(F.count(F.lit(1)).alias("n"))
