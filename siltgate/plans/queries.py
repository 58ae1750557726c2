"""The registered queries of the scan and its evaluation, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltgate.config import ScanConfig
from siltgate.functions import checks
from siltgate.functions import text as rewritings
from siltgate.functions.spans import find_all
from siltgate.operators import detectors, semantic, verdicts
from siltgate.operators.similarity import best_score, matches, similarity_hits, top_k_of_all, top_k_of_each
from siltgate.plans import cases, evaluate, messages
from siltgate.plans.scan import scan
from siltgate.schema import HITS, empty, hit
from siltgate.sources.units import call_of
from siltgate.streaming.queries import STREAM_VERDICTS, STREAM_WINDOWS, q_stream_verdicts, q_stream_windows

def no_path() -> Column:
    return F.lit(None).cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """A synthesised table over one of the star schema's."""
    braced = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(braced, source=table(spark, sf_dir, name))


def rule_hits(df: DataFrame, key: str, rules: tuple, text: str = "text") -> DataFrame:
    """key, rule, entity, action, span_start, matched for the hits of some rules in raw texts."""
    found = F.concat(*[r.hits(F.col(text), F.lit("raw"), no_path()) for r in rules])
    return df.select(key, F.inline(found)).select(key, "rule", "entity", "action", "span_start", "matched")


# ---- The whole scan ----


#: Bytes of a file table for each core from which on its row groups surely keep all cores busy.
SPREAD_BYTES = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A file scan dealt over all cores if the table is small: scanning texts costs far more than dealing them.

    Small files have too few row groups to be read in as many tasks. A large table is read as it lies, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as prompts with their session's earlier texts, and documents as flowback."""
    # The window takes over this dealing by conversation; stated counts of partitions are not merged later.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    chat = table(spark, sf_dir, "conversations").repartition(parts, "conv_id").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("req_id"), F.lit("prompt").alias("injection_point"), F.lit("text").alias("content_kind"),
        F.col("text").alias("content"), F.collect_list(F.coalesce("text", F.lit(""))).over(earlier).alias("session_window"),
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat_ws("-", F.lit("d"), "doc_id").alias("req_id"), F.lit("flowback").alias("injection_point"), F.lit("text").alias("content_kind"),
        F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("session_window"),
    )
    return chat.unionByName(docs)


def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(requests(spark, sf_dir), ScanConfig(semantic=True)).select("req_id", "verdict", "top_layer", "n_hits", F.size("alerts").alias("n_alerts"))


def q_secret_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of the synthesised messages: verdict, deciding layer, redacted text."""
    rows = made(spark, sf_dir, "customer", messages.SECRETS).select(F.col("msg_id"), F.col("msg_id").cast("string").alias("req_id"), F.lit("prompt").alias("injection_point"), F.lit("text").alias("content_kind"), F.col("text").alias("content"))
    return scan(rows, ScanConfig(l3="off")).select("msg_id", "verdict", "top_layer", "redacted_text")


SECRET_VERDICTS = f"""
WITH m AS ({messages.SECRETS}), v AS (
  SELECT msg_id, text, CASE
    WHEN msg_id % 20 IN (0, 1, 3, 4) THEN 'L0' WHEN msg_id % 20 BETWEEN 6 AND 13 THEN 'L1' WHEN msg_id % 20 = 14 THEN 'L0'
    WHEN msg_id % 20 BETWEEN 16 AND 19 THEN 'L3.5' END AS layer,
    CASE WHEN msg_id % 20 IN (14, 16) THEN 'redact' WHEN msg_id % 20 IN (2, 5, 15) THEN 'pass' ELSE 'block' END AS verdict
  FROM m)
SELECT msg_id, verdict, layer AS top_layer, CASE
  WHEN msg_id % 20 = 14 THEN 'mail [REDACTED:EMAIL] today'
  WHEN msg_id % 20 = 16 THEN 'see [REDACTED:PROPRIETARY_TERM] soon' END AS redacted_text
FROM v
"""


def q_verdict_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = q_secret_verdicts(spark, sf_dir)
    return got.rollup("verdict", "top_layer").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


VERDICT_BY_LAYER = f"WITH s AS ({SECRET_VERDICTS}) SELECT verdict, top_layer, count(*) AS n, CAST(GROUPING(verdict, top_layer) AS INT) AS level FROM s GROUP BY ROLLUP (verdict, top_layer)"


# ---- Detectors ----


def q_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "customer", messages.SECRETS)
    return rule_hits(rows, "msg_id", tuple(r for r in (*detectors.L0, *detectors.L1) if r.action == "block"))


def _one_rule(where: str, rule: str, entity: str, pattern: str, group: int = 0) -> str:
    at = f"regexp_extract(text, '{pattern}', {group})"
    return f"SELECT msg_id, '{rule}' AS rule, '{entity}' AS entity, 'block' AS action, CAST(instr(text, {at}) - 1 AS INT) AS span_start, {at} AS matched FROM m WHERE {where}"


CREDENTIALS = f"WITH m AS ({messages.SECRETS}) " + " UNION ALL ".join([
    _one_rule("msg_id % 20 = 0", "aws_access_key", "AWS_ACCESS_KEY", "AKIA[0-9A-Z]{16}"),
    _one_rule("msg_id % 20 = 1", "aws_access_key", "AWS_ACCESS_KEY", "ASIA[0-9A-Z]{16}"),
    _one_rule("msg_id % 20 = 3", "gcp_api_key", "GCP_API_KEY", "AIza[0-9A-Za-z_-]{35}"),
    _one_rule("msg_id % 20 = 4", "aws_secret_key", "AWS_SECRET_KEY", "= ([A-Za-z0-9/+]{40})", 1),
    _one_rule("msg_id % 20 = 6", "pem_private_key", "PRIVATE_KEY", "-----BEGIN RSA PRIVATE KEY-----"),
    _one_rule("msg_id % 20 = 7", "stripe_live", "STRIPE_KEY", "sk_live_[0-9A-Za-z]{16,}"),
    _one_rule("msg_id % 20 = 8", "stripe_test", "STRIPE_KEY", "sk_test_[0-9A-Za-z]{16,}"),
    _one_rule("msg_id % 20 = 9", "github_pat", "GITHUB_PAT", "ghp_[0-9A-Za-z]{36}"),
    _one_rule("msg_id % 20 = 10", "github_token", "GITHUB_PAT", "gho_[0-9A-Za-z]{36}"),
    _one_rule("msg_id % 20 = 11", "openai_key", "OPENAI_KEY", "sk-proj-[0-9A-Za-z_-]{20,}"),
    _one_rule("msg_id % 20 = 12", "slack_token", "SLACK_TOKEN", "xoxb-[0-9A-Za-z-]{10,}"),
    _one_rule("msg_id % 20 = 13", "jwt", "JWT", "eyJ[^ ]*"),
])


def q_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(made(spark, sf_dir, "customer", messages.SECRETS), "msg_id", detectors.L35)


GLOSSARY = f"""
WITH m AS ({messages.SECRETS}), w AS (
  SELECT *, unnest([
    {{'rule': 'ticket_id', 'entity': 'PROPRIETARY_TERM', 'action': 'redact', 'tok': regexp_extract(text, 'SEV[0-9]-[0-9]{{3,6}}')}},
    {{'rule': 'corp_domain', 'entity': 'INTERNAL_DOMAIN', 'action': 'block', 'tok': regexp_extract(text, '[a-z0-9.-]+[.]corp[.]example[.]net')}},
    {{'rule': 'glossary:Project Nightingale', 'entity': 'PROPRIETARY_TERM', 'action': 'block', 'tok': regexp_extract(text, 'Project Nightingale')}},
    {{'rule': 'glossary:region-cn-shadow', 'entity': 'PROPRIETARY_TERM', 'action': 'block', 'tok': regexp_extract(text, '(?i)region-cn-shadow')}},
    {{'rule': 'glossary:Falcon', 'entity': 'PROPRIETARY_TERM', 'action': 'block', 'tok': CASE WHEN text LIKE '%internal%' THEN regexp_extract(text, 'Falcon') ELSE '' END}}]) AS r
  FROM m)
SELECT msg_id, r.rule AS rule, r.entity AS entity, r.action AS action, CAST(instr(text, r.tok) - 1 AS INT) AS span_start, r.tok AS matched FROM w WHERE r.tok <> ''
"""


def q_email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.inline(find_all(F.coalesce("text", F.lit("")), detectors.EMAIL)))
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("tok").alias("email"), checks.reserved_email(F.col("tok")).alias("reserved"))


#: Places of matches as in the library: gaps and matches summed up.
def _spans(source: str, key: str, pattern: str, text: str = "text") -> str:
    return f"""
  SELECT {key}, {text}, unnest(m) AS tok, unnest(list_transform(range(len(m)), lambda i: CAST(coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT))) AS span_start
  FROM (SELECT {key}, {text}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {source})"""


EMAIL_CANDIDATES = f"""
WITH s AS ({_spans("documents", "doc_id", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}")})
SELECT doc_id, CAST(span_start AS INT) AS span_start, tok AS email,
  regexp_matches(lower(split_part(tok, '@', 2)), '(^|[.])example[.](com|org|net|edu)$|[.](example|test|invalid|localhost)$') AS reserved
FROM s
"""


def q_entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(detectors.TOKEN))
    found = docs.select("doc_id", F.inline(detectors.entropy_tokens(F.col("text"))))
    good = F.col("exempt").isNull() & (F.round("entropy", 9) >= detectors.ENTROPY_LEAST) & F.col("context")
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("tok").alias("token"), F.round("entropy", 6).alias("entropy"), "exempt", "context", good.alias("is_hit"))


ENTROPY_TOKENS = f"""
WITH s AS ({_spans("documents", "doc_id", "[A-Za-z0-9+/=_-]{20,}")}),
e AS (
  SELECT *, list_aggregate(string_split(tok, ''), 'entropy') AS h,
    substr(text, greatest(0, span_start - 32) + 1, span_start - greatest(0, span_start - 32)) AS before_text,
    substr(text, greatest(0, span_start - 40) + 1, span_start + length(tok) + 8 - greatest(0, span_start - 40)) AS near
  FROM s),
x AS (
  SELECT *, CASE
    WHEN regexp_matches(before_text || substr(tok, 1, 16), 'data:[[:word:].+-]+/[[:word:].+-]+;base64,') THEN 'data-uri'
    WHEN regexp_matches(before_text, 'sha(?:256|512)-|integrity[\"'']?[[:space:]]*[:=]') THEN 'lockfile'
    WHEN regexp_full_match(tok, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN 'uuid'
    WHEN regexp_full_match(tok, '[0-9a-f]{{40}}|[0-9a-f]{{7,12}}') THEN 'sha' END AS exempt,
    regexp_matches(near, '(?i)(^|[^[:word:]])(password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credentials?|authorization|auth|bearer)($|[^[:word:]])') AS context
  FROM e)
SELECT doc_id, CAST(span_start AS INT) AS span_start, tok AS token, round(h, 6) AS entropy, exempt, context, exempt IS NULL AND round(h, 9) >= 4 AND context AS is_hit FROM x
"""


def q_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(detectors.CARD), F.lit(0))).alias("card"))
    digits = F.regexp_replace("card", r"\D", "")
    return found.select("doc_id", digits.alias("digits"), checks.card_valid(digits).alias("valid")).groupBy("valid").agg(F.count("*").alias("n"), F.min("digits").alias("low"), F.max("digits").alias("high"))


CARDS = """
WITH w AS (SELECT doc_id, ' ' || regexp_replace(replace(text, chr(10), '  '), '([0-9]{13,19}) ', '\\1  ', 'g') || ' ' AS t FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^0-9.])([0-9](?:[ -]?[0-9]){12,18})(?:$|[^0-9])', 1)) AS card FROM w),
d AS (SELECT doc_id, regexp_replace(card, '[^0-9]', '', 'g') AS digits FROM c),
l AS (SELECT digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), CAST(i AS INT), 1) AS INT)
  ELSE (2 * CAST(substr(reverse(digits), CAST(i AS INT), 1) AS INT)) // 10 + (2 * CAST(substr(reverse(digits), CAST(i AS INT), 1) AS INT)) % 10 END)) % 10 = 0 AS valid FROM d)
SELECT valid, count(*) AS n, min(digits) AS low, max(digits) AS high FROM l GROUP BY valid
"""


def q_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(detectors.IPV4), F.lit(0))).alias("address"))
    return found.groupBy("address").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


ADDRESSES = """
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)*')) AS run FROM documents)
SELECT run AS address, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM r
WHERE regexp_full_match(run, '(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.](?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')
GROUP BY run
"""


def _with_ids(rows: DataFrame) -> DataFrame:
    """The synthesised texts: a number that is right or wrong, and a mobile number in some context."""
    total = F.aggregate(F.zip_with(F.split("digits", ""), F.lit(list(checks.ID_WEIGHTS)), lambda d, w: d.cast("int") * w), F.lit(0), lambda s, x: s + x)
    right = F.substr(F.lit(checks.ID_CHECKS), total % 11 + 1, F.lit(1))
    number = F.concat("digits", F.when(F.col("kind") == 1, F.when(right == "0", "1").otherwise("0")).otherwise(right))
    return rows.select("msg_id", F.concat("lead_text", F.when(F.col("kind") < 2, number).otherwise(F.col("mobile")), F.lit(" ok")).alias("text"))


def q_ids_and_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_ids(made(spark, sf_dir, "orders", messages.IDS))
    return rule_hits(rows, "msg_id", tuple(r for r in detectors.L0 if r.name in ("cn_id_card", "cn_phone")))


IDS_AND_PHONES = f"""
WITH m AS ({messages.IDS}),
c AS (SELECT *, substr('{checks.ID_CHECKS}', CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(substr(digits, CAST(i AS INT), 1) AS INT) * ({list(checks.ID_WEIGHTS)})[i])) % 11 AS INT) + 1, 1) AS last FROM m)
SELECT msg_id, 'cn_id_card' AS rule, 'CN_ID_CARD' AS entity, 'redact' AS action, 3 AS span_start, digits || last AS matched FROM c WHERE kind = 0
UNION ALL SELECT msg_id, 'cn_phone', 'CN_PHONE', 'redact', 6, mobile FROM c WHERE kind = 3
"""


# ---- Rewritings ----


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "supplier", messages.CODED_SPARK)


def q_rot13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(rewritings.rot13(F.coalesce("text", F.lit(""))), 256).alias("rotated_sha256"))


ROT13 = f"SELECT doc_id, sha256(translate(coalesce(text, ''), '{rewritings.ALPHABET}', '{rewritings.ROTATED}')) AS rotated_sha256 FROM documents"


def q_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("msg_id", rewritings.decode_base64(F.col("text")).alias("from_base64"), rewritings.decode_hex(F.col("text")).alias("from_hex"))


DECODED = f"""
WITH m AS ({messages.CODED_SQL})
SELECT msg_id, CASE WHEN msg_id % 4 = 0 THEN text || ' supplier key number ' || CAST(msg_id AS STRING) END AS from_base64,
  CASE WHEN msg_id % 4 = 1 THEN text || ' supplier key number ' || CAST(msg_id AS STRING) END AS from_hex FROM m
"""


def q_strip_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("msg_id", rewritings.strip_separators(F.col("text")).alias("stripped"))


STRIP_SEPARATORS = f"""
WITH m AS ({messages.CODED_SQL}),
p AS (SELECT msg_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_[:space:].-]{{10,}}[A-Za-z0-9]') AS toks, regexp_split_to_array(text, '[A-Za-z0-9][A-Za-z0-9_[:space:].-]{{10,}}[A-Za-z0-9]') AS gaps FROM m)
SELECT msg_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(regexp_replace(toks[i], '[-_[:space:].]', '', 'g'), '')), '') AS stripped FROM p
"""


def q_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with Chinese digits, full-width letters and invisible characters, in their normal form."""
    digits = F.translate(F.col("c_custkey").cast("string"), "0123456789", "〇一二三四五六七八九")
    odd = F.concat(F.lit("ＡＫ​"), digits, F.lit("⁠x"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(rewritings.prepare(F.array(odd)), 1)["norm"].alias("normal"))


NORMALIZED = "SELECT c_custkey, 'AK' || CAST(c_custkey AS STRING) || 'x' AS normal FROM customer"


def q_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    code = F.concat(F.lit('k = "AKIA'), n, F.lit("\" + \"ABCD\" + 'EFGH'; a='L"), n, F.lit("'; b='R"), n, F.lit("'; c = a + b"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(rewritings.prepare(F.array(code)), 1)["folded"].alias("folded"))


FOLDED = """
SELECT s_suppkey, 'k = "AKIA' || n || '" + "ABCD" + ''EFGH''; a=''L' || n || '''; b=''R' || n || '''; c = a + b' || ' L' || n || 'R' || n || ' AKIA' || n || 'ABCDEFGH' AS folded
FROM (SELECT s_suppkey, lpad(CAST(s_suppkey AS STRING), 8, '0') AS n FROM supplier)
"""


def q_session_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.sha2(F.concat(F.array_join(F.collect_list("text").over(earlier), ""), "text"), 256).alias("window_sha256"))


SESSION_CONCAT = """
SELECT conv_id, turn, sha256(coalesce(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || text) AS window_sha256 FROM conversations
"""


# ---- Units and the channel policy ----


def q_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of tool calls made from events, with its path."""
    call = F.to_json(F.struct(F.col("event_type").alias("tool"), F.struct(F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("who"), F.struct(F.col("props").alias("body"), F.lit("x").alias("origin"), F.col("event_id").alias("n")).alias("inner")).alias("arguments")))
    rows = table(spark, sf_dir, "events").select("event_id", F.inline(call_of(call)["units"]))
    return rows.select("event_id", "field_path", "text")


LEAVES = """
SELECT event_id, u.field_path AS field_path, u.text AS text FROM (
  SELECT event_id, unnest([{'field_path': 'tool', 'text': event_type}, {'field_path': 'who[0]', 'text': event_type}, {'field_path': 'who[1]', 'text': CAST(user_id AS STRING)}, {'field_path': 'inner.body', 'text': props}]) AS u FROM events)
WHERE u.text IS NOT NULL
"""


def q_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "part", messages.COMMANDS)
    content = F.to_json(F.struct("tool", F.create_map("field", "body").alias("arguments")))
    calls = rows.select("msg_id", F.col("msg_id").cast("string").alias("req_id"), F.lit("egress").alias("injection_point"), F.lit("mcp_call").alias("content_kind"), content.alias("content"))
    got = scan(calls, ScanConfig(l3="off")).select("msg_id", F.inline("hits"))
    return got.where("rule = 'egress_channel'").select("msg_id", "entity", "matched", "field_path")


CHANNEL = f"""
WITH m AS ({messages.COMMANDS})
SELECT msg_id, 'EGRESS_READ_EXFIL' AS entity, body AS matched, 'command' AS field_path FROM m WHERE msg_id % 9 = 0
UNION ALL SELECT msg_id, 'EGRESS_DATA_UPLOAD', body, 'command' FROM m WHERE msg_id % 9 IN (0, 1)
UNION ALL SELECT msg_id, 'EGRESS_GIT_PUSH', regexp_extract(body, 'git push ([^ ]+)', 1), 'command' FROM m WHERE msg_id % 9 = 2
UNION ALL SELECT msg_id, 'EGRESS_HTTP', regexp_extract(body, 'https?://([^/ ]+)', 1), 'command' FROM m WHERE msg_id % 9 IN (0, 4)
UNION ALL SELECT msg_id, 'EGRESS_SQL_CONN', body, 'connection' FROM m WHERE msg_id % 9 = 6
"""


# ---- Hits to verdicts ----


def _crafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every order's lines: repeated keys, both actions, several layers."""
    lines = table(spark, sf_dir, "lineitem")
    one = lambda layer, rule, action: hit(layer, rule, "E", F.lit(0), F.col("l_linenumber") % 3, F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string")), action, F.lit("raw"), no_path(), F.round(F.col("l_discount"), 2))
    kind = F.col("l_partkey") % 3
    made_ = F.when(kind == 0, one("L0", "email", "redact")).when(kind == 1, one("L2", "high_entropy_secret", "block")).otherwise(one("L3.5", "ticket_id", "redact"))
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", made_.alias("h")))).alias("x"))
    return grouped.select("l_orderkey", F.transform("x", lambda x: x["h"]).cast(HITS).alias("found"))


def q_dedup_and_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _crafted(spark, sf_dir).select("l_orderkey", F.explode_outer(F.array(verdicts.dedup(F.col("found")))).alias("hits"))
    return hits.select("l_orderkey", F.size("hits").alias("n_hits"), verdicts.verdict(F.col("hits")).alias("verdict"), verdicts.top_layer(F.col("hits")).alias("top_layer"), F.round(F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["confidence"]), 4).alias("confidence"))


DEDUP_AND_VERDICT = """
WITH k AS (SELECT l_orderkey, l_partkey % 3 AS kind, l_linenumber % 3 AS span_end, max(round(l_discount, 2)) AS confidence FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(count(*) AS INT) AS n_hits, CASE WHEN bool_or(kind = 1) THEN 'block' ELSE 'redact' END AS verdict,
  CASE WHEN bool_or(kind = 1) THEN 'L2' WHEN bool_or(kind = 0) THEN 'L0' ELSE 'L3.5' END AS top_layer, round(sum(confidence), 4) AS confidence
FROM k GROUP BY l_orderkey
"""


def q_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "lineitem", messages.BUSINESS).select("msg_id", F.explode(semantic.alerts(F.col("text"))).alias("a"))
    return rows.groupBy("a.category").agg(F.count("*").alias("n"), F.max("a.confidence").alias("confidence"))


SEMANTIC = f"""
WITH m AS ({messages.BUSINESS}), f AS (
  SELECT regexp_matches(text, '(?i)pricing|margin|fraud') AS business, regexp_matches(text, '(?i)weight|threshold|formula|[*] *0[.][0-9]') AS logic,
    regexp_matches(text, '(?i)quicksort') AS generic, regexp_matches(text, '(?i)internal') AS disguise FROM m),
c AS (SELECT CASE WHEN generic AND NOT business THEN NULL WHEN business AND logic THEN 'proprietary-business-logic' WHEN disguise THEN 'proprietary-source' END AS category FROM f)
SELECT category, count(*) AS n, max(CASE category WHEN 'proprietary-source' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END) AS confidence FROM c WHERE category IS NOT NULL GROUP BY category
"""


# ---- Similarity and evaluation: every vector whose id is divisible by 50 against all vectors; hits: every vector ----


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    rows = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    return top_k_of_all(asked, rows, k + 1).where(F.col("query_id") != F.col("doc_id"))


def q_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _nearest(spark, sf_dir, 5)
    return got.select("query_id", "doc_id", F.round("score", 4).alias("score"))


_PAIRS = """
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score, q.label AS ql, d.label AS dl
  FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM pairs)"""
SIMILAR = f"WITH {_PAIRS} SELECT query_id, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 6 AND query_id <> doc_id"

_ALL_PAIRS = _PAIRS.replace(" WHERE q.vec_id % 50 = 0", "")


def q_similarity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against all rows; one without a vector, or that meets no other vector, has no score."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    near = top_k_of_each(vectors, 6).where(F.col("query_id") != F.col("doc_id")).withColumn("chunk_id", F.lit("0"))
    found = matches(near).select("query_id", best_score(F.col("similar")).alias("max_similarity"), similarity_hits(F.col("similar"), 0.5, "block", no_path()).alias("h"))
    ids, ends = vectors.select(F.col("doc_id").alias("query_id")).distinct(), vectors.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    every = ids.crossJoin(F.broadcast(ends)).where("first <> last").select("query_id").join(found, "query_id", "left")
    return every.select("query_id", "max_similarity", F.get("h", F.lit(0))["rule"].alias("rule"), F.get("h", F.lit(0))["matched"].alias("matched"))


SIMILARITY_HITS = f"""
WITH {_ALL_PAIRS}, best AS (SELECT query_id, max(round(score, 4)) AS s, min_by(doc_id, rank) AS doc_id FROM ranked WHERE rank <= 6 AND query_id <> doc_id GROUP BY query_id)
SELECT query_id, s AS max_similarity, CASE WHEN s >= 0.5 THEN 'rag:' || CAST(doc_id AS STRING) || '#0' END AS rule,
  CASE WHEN s >= 0.5 THEN printf('sim=%.2f doc=%d', s, doc_id) END AS matched FROM best
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score, label, matched, source, level: neighbours of each query, and whether they have the query's label."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "label")
    near = _nearest(spark, sf_dir, 5)
    both = near.join(labels.withColumnsRenamed({"vec_id": "doc_id", "label": "dl"}), "doc_id").join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id")
    return both.select(F.round("score", 4).alias("score"), (F.col("dl") == F.col("ql")).cast("int").alias("label"), F.col("dl").alias("matched"), F.col("ql").alias("source"), F.col("rank").alias("level"))


_SCORED = f"WITH {_PAIRS}, scored AS (SELECT round(score, 4) AS score, CASE WHEN ql = dl THEN 1 ELSE 0 END AS label, dl AS matched, ql AS source, rank AS level FROM ranked WHERE rank <= 6 AND query_id <> doc_id)"
_CURVE = (
    _SCORED
    + """, counts AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
run AS (SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM counts),
curve AS (SELECT threshold, tp, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS recall, CASE WHEN n > 0 THEN fp / n ELSE 0.0 END AS fpr FROM run)"""
)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def q_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.pr_curve(_scored(spark, sf_dir)), "precision", "recall", "fpr")


PR_CURVE = _CURVE + " SELECT threshold, tp, fp, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(fpr, 6)::DOUBLE AS fpr FROM curve"


def q_curve_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.curve_areas(evaluate.pr_curve(_scored(spark, sf_dir))), "average_precision", "roc_auc")


CURVE_AREAS = (
    _CURVE
    + """, steps AS (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS r0, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0) AS f0 FROM curve)
SELECT round(sum((recall - r0) * precision), 6)::DOUBLE AS average_precision, round(sum((fpr - f0) * (recall + r0) / 2), 6)::DOUBLE AS roc_auc FROM steps"""
)


def q_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.operating_point(evaluate.pr_curve(_scored(spark, sf_dir)), 0.5), "precision", "recall")


OPERATING_POINT = _CURVE + " SELECT threshold, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall FROM curve WHERE recall >= 0.5 ORDER BY precision DESC, threshold DESC LIMIT 1"


def q_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.top1(_scored(spark, sf_dir).where("level <= 2").withColumn("label", F.lit(1)))
    return _rounded(got, "accuracy", "low", "high", "at_least")


TOP1 = (
    _SCORED
    + f""", c AS (SELECT count(*) AS n, count(*) FILTER (WHERE matched = source) AS k FROM scored WHERE level <= 2),
w AS (SELECT n, k, k / n AS p, {evaluate.Z} AS z FROM c)
SELECT n, k AS correct, round(p, 6)::DOUBLE AS accuracy, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6)::DOUBLE AS low,
  round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6)::DOUBLE AS high, CASE WHEN k = n THEN round(1 - 3.0 / n, 6)::DOUBLE END AS at_least FROM w"""
)


def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.stratified(_scored(spark, sf_dir), "source")
    return got.select("source", "label1", "label0", F.sha2(F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s)), ","), 256).alias("scores_sha256"))


STRATIFIED = _SCORED + " SELECT source, count(*) FILTER (WHERE label = 1) AS label1, count(*) FILTER (WHERE label = 0) AS label0, sha256(string_agg(printf('%.4f', score), ',' ORDER BY score)) AS scores_sha256 FROM scored GROUP BY source"


def q_latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.index_quantile(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


LATENCY_QUANTILES = """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS quantile, n FROM s WHERE place = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))
"""


def q_derived_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.derive_evaluation(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10, 3)


DERIVED_EVALUATION = """
WITH sizes AS (SELECT source AS g, count(*) AS n FROM documents GROUP BY source), top AS (SELECT g FROM sizes ORDER BY n DESC, g LIMIT 10),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
SELECT doc_id, source, CASE WHEN place = 1 THEN 'corpus' ELSE 'positive' END AS kind FROM ranked WHERE source IN (SELECT g FROM top) AND place <= 4
UNION ALL SELECT * FROM (SELECT doc_id, source, 'negative' FROM ranked WHERE source NOT IN (SELECT g FROM top) ORDER BY place, source LIMIT 30)
"""


def q_suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the synthesised messages against expectations, every thirteenth of which is wrong on purpose."""
    rows = made(spark, sf_dir, "customer", messages.SECRETS)
    kind = F.col("msg_id") % 20
    requests_ = rows.select(F.col("msg_id").cast("string").alias("req_id"), F.lit("prompt").alias("injection_point"), F.lit("text").alias("content_kind"), F.col("text").alias("content"))
    want = F.when(kind.isin(14, 16), "redact").when(kind.isin(2, 5, 15), "pass").otherwise("block")
    layer = F.when(kind.isin(0, 1, 3, 4, 14), "L0").when(kind.between(6, 13), "L1").when(kind >= 16, "L3.5")
    wrong = F.col("msg_id") % 13 == 0
    none = empty("array<string>")
    expected = rows.select(
        F.col("msg_id").cast("string").alias("req_id"), (F.col("msg_id") % 3).cast("int").alias("suite"),
        F.when(wrong, F.when(want == "pass", "block").otherwise("pass")).otherwise(want).alias("verdict"), layer.alias("top_layer"),
        F.when(kind == 0, F.array(F.lit("AWS_ACCESS_KEY:block"))).otherwise(none).alias("must_hit"), F.when(kind == 2, F.array(F.lit("AWS_ACCESS_KEY"))).otherwise(none).alias("must_not_hit"),
    )
    return evaluate.suite_rollup(evaluate.check_expectations(scan(requests_, ScanConfig(l3="off")), expected))


SUITE_ROLLUP = f"""
WITH m AS ({messages.SECRETS}), o AS (
  SELECT CAST(msg_id % 3 AS INT) AS suite, msg_id % 13 = 0 AS wrong, msg_id % 20 IN (2, 5, 15) AS clean FROM m)
SELECT suite, count(*) FILTER (WHERE NOT wrong) AS passed, count(*) FILTER (WHERE wrong) AS failed, 0::BIGINT AS skipped,
  count(*) FILTER (WHERE wrong AND clean) AS missed, count(*) FILTER (WHERE wrong AND NOT clean) AS false_alarms
FROM o GROUP BY ROLLUP (suite)
"""


def q_model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' categories for every order, made from its priority and status."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus", "o_orderpriority")
    category = lambda c: F.when(c.isin("O", "1-URGENT", "2-HIGH"), "business_strategy").when(c == "F", "financial_nonpublic")
    a = rows.select("case_id", F.lit("business_strategy").alias("expected"), category(F.col("o_orderstatus")).alias("category"))
    return evaluate.model_agreement(a, rows.select("case_id", category(F.col("o_orderpriority")).alias("category")))


MODEL_AGREEMENT = """
WITH c AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'business_strategy' WHEN o_orderstatus = 'F' THEN 'financial_nonpublic' END AS a, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'business_strategy' END AS b FROM orders)
SELECT count(*) AS cases, count(*) FILTER (WHERE a = 'business_strategy') AS a_exact, count(*) FILTER (WHERE b = 'business_strategy') AS b_exact, count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS agree FROM c
"""

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {
    "verdicts": (q_verdicts, None),
    "secret_verdicts": (q_secret_verdicts, SECRET_VERDICTS),
    "verdict_by_layer": (q_verdict_by_layer, VERDICT_BY_LAYER),
    "credential_scan": (q_credentials, CREDENTIALS),
    "glossary_scan": (q_glossary, GLOSSARY),
    "email_candidates": (q_email_candidates, EMAIL_CANDIDATES),
    "entropy_tokens": (q_entropy_tokens, ENTROPY_TOKENS),
    "card_luhn": (q_cards, CARDS),
    "ip_candidates": (q_addresses, ADDRESSES),
    "cn_id_phone_scan": (q_ids_and_phones, IDS_AND_PHONES),
    "variant_rot13": (q_rot13, ROT13),
    "variant_decoded": (q_decoded, DECODED),
    "strip_separators": (q_strip_separators, STRIP_SEPARATORS),
    "normalized": (q_normalized, NORMALIZED),
    "folded": (q_folded, FOLDED),
    "session_concat": (q_session_concat, SESSION_CONCAT),
    "leaf_explode": (q_leaves, LEAVES),
    "egress_policy": (q_channel, CHANNEL),
    "dedup_and_verdict": (q_dedup_and_verdict, DEDUP_AND_VERDICT),
    "l4_heuristic": (q_semantic, SEMANTIC),
    "similarity_topk": (q_similar, SIMILAR),
    "similarity_hits": (q_similarity_hits, SIMILARITY_HITS),
    "pr_curve": (q_pr_curve, PR_CURVE),
    "curve_areas": (q_curve_areas, CURVE_AREAS),
    "operating_point": (q_operating_point, OPERATING_POINT),
    "top1_wilson": (q_top1, TOP1),
    "stratified_scores": (q_stratified, STRATIFIED),
    "latency_quantile": (q_latency_quantiles, LATENCY_QUANTILES),
    "eval_derivation": (q_derived_evaluation, DERIVED_EVALUATION),
    "suite_rollup": (q_suite_rollup, SUITE_ROLLUP),
    "model_agreement": (q_model_agreement, MODEL_AGREEMENT),
    **cases.QUERIES,
    "streaming_windows": (q_stream_windows, STREAM_WINDOWS),
    "streaming_verdicts": (q_stream_verdicts, STREAM_VERDICTS),
}
QUERIES: dict[str, Query] = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {k: s for k, (_, s) in _ALL.items() if s}
