"""The registered queries of the training-data operators, each over its whole table.

Every query gets its rows through its operator; only digests of an operator's real output are added here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgate.llm import chat, decontaminate, licenses, line_dedup, mixing, quality_classifier, quality_ledger, simhash, tokens, toxicity
from siltgate.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.apply(quality_ledger.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names, _ = mixing.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", *[F.col(c).alias(n) for n, c in names.items()])


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.round_trip(rows.unionByName(chat.hostile(spark))))


#: The template's own length is arithmetic: 12 + 1 + 10 + 1 code points a turn, and one for each escape.
OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, 24 + length(role) + length(text)
    + len(regexp_extract_all(text, '<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|SYS>>|/SYS>>)|\[\\*(?:INST\]|/INST\])')) AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""


def word_tokenizer() -> str:
    """The vocabulary file of the token query; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), word_tokenizer())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM base),
keyed AS (
  SELECT doc_id, pos, line, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM each),
shared AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.documents_as_files(table(spark, sf_dir, "documents")), ["doc_id"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


#: Words are numbered within their document; a window is eight words joined, and a word counts if one of the
#: windows that it is in is there twice.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again AND regexp_matches(line, '[^ \x09-\x0D]')) AS n_dup_lines
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d))
  GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^ \x09-\x0D]+') AS ws FROM d)),
v AS (
  SELECT *, lag(w) OVER o AS before, string_agg(w, ' ') OVER f AS win, count(*) OVER f AS n, count(*) OVER (PARTITION BY doc_id, w) AS same
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos), f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
t AS (SELECT *, n = 8 AND count(*) OVER (PARTITION BY doc_id, win, n) > 1 AS twice FROM v),
c AS (SELECT *, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM t),
s AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words, max(same) AS n_top, count(*) FILTER (WHERE w = before) AS n_same
  FROM c GROUP BY doc_id),
a AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_top, 0) AS n_top, coalesce(n_same, 0) AS n_same,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_bang
  FROM d JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)),
m AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 14 * n_words OR 2 * word_chars < 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_top > 35 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_upper > 45 * word_chars OR 100 * n_bang > 50 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_same > 30 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_mask FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask FROM m
"""



def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every policy of the ledger would keep without each of its rules."""
    return quality_ledger.ablations(quality_ledger.ledger(table(spark, sf_dir, "documents")))


def _values(rows: list[tuple[str, int]]) -> str:
    return ", ".join(f"('{name}', {n}::BIGINT)" for name, n in rows)


ABLATIONS_SQL = OP2_SQL[: OP2_SQL.rindex("SELECT doc_id, n_words")] + f""", p AS (SELECT * FROM (VALUES {_values([(p.version, p.mask) for p in quality_ledger.POLICIES.values()])}) AS t(version, mask)),
r AS (SELECT * FROM (VALUES {_values([(name, 1 << bit) for bit, name in enumerate(quality_ledger.NAMES)])}) AS t(rule, bit)),
h AS (SELECT version, rule, bit, fail_mask & mask AS hit FROM m CROSS JOIN p JOIN r ON mask & bit <> 0)
SELECT version, rule, count(*) FILTER (WHERE hit & bit <> 0) AS n_fail, count(*) FILTER (WHERE hit = bit) AS n_only, count(*) FILTER (WHERE hit = 0) AS n_kept,
  count(*) FILTER (WHERE hit & ~bit = 0) AS n_kept_without
FROM h GROUP BY version, rule
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_ledger": op2_quality_ledger,
    "op3_mixing": op3_mixing,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_chat": op5_chat,
    "op6_token_ids": op6_token_ids,
    "op7_line_dedup": op7_line_dedup,
    "op8_licenses": op8_licenses,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_ledger": OP2_SQL, "op5_chat": OP5_SQL, "op7_line_dedup": OP7_SQL, "quality_ablations": ABLATIONS_SQL}
