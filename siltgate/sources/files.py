"""Reading and writing: registered corpora, evaluation rows, fixtures; rows, safe rows and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgate.plans.scan import alerts_table, safe_hits

MATCHED_CHARS = 64


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Registered texts from JSON lines; a missing doc_id is d and the place of its line among the corpus's rows, chunk_id is 0.

    Blank lines are no rows. Rows are in the order of their files' paths, and in a file in the order of its blocks and lines.
    Places are counted only if an id is missing: the rows of each block by one task, the blocks before it by the driver.
    """
    kind = "doc_id string, chunk_id string, text string, embedding array<float>"
    lines = spark.read.text(path).where(F.trim("value") != "")
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    parsed = lines.select(block.alias("block"), F.monotonically_increasing_id().alias("at"), F.from_json("value", kind).alias("r"))
    named = lambda doc_id, df: df.select(doc_id.alias("doc_id"), F.coalesce("r.chunk_id", F.lit("0")).alias("chunk_id"), "r.text", "r.embedding")
    if parsed.where(F.col("r.doc_id").isNull()).limit(1).count() == 0:
        return named(F.col("r.doc_id"), parsed)
    # A block is read by one task, whose rows have rising numbers: a row's place is its number less its block's first.
    sizes = parsed.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("block").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["block"]["path"], r["block"]["start"], total - r["first"]))
        total += r["n"]
    shift = spark.createDataFrame(before, "p string, s long, shift long")
    met = parsed.join(F.broadcast(shift), (F.col("block.path") == F.col("p")) & (F.col("block.start") == F.col("s")))
    return named(F.coalesce("r.doc_id", F.concat(F.lit("d"), F.col("at") + F.col("shift"))), met)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows from JSON lines; blank lines are no rows."""
    rows = spark.read.schema("id string, label int, src_doc string, rewrite_level string, text string").json(path)
    return rows.where(F.coalesce("id", "text").isNotNull())


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Scenario files (a JSON array each) as requests with what is expected of them.

    Content may be text or an object: it is kept as text, objects as JSON.
    """
    expected = "verdict string, top_layer string, must_hit array<struct<entity:string,action:string>>, must_not_hit array<struct<entity:string,action:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    content = F.when(get("$.content_kind", "string") == "mcp_call", F.to_json(get("$.content", "variant"))).otherwise(get("$.content", "string"))
    wanted = F.from_json(F.to_json(get("$.expected", "variant")), expected)
    words = lambda c: F.coalesce(F.transform(c, lambda x: F.concat_ws(":", x["entity"], x["action"])), F.array().cast("array<string>"))
    return raw.select(
        get("$.id", "string").alias("req_id"), get("$.suite", "int").alias("suite"), get("$.injection_point", "string").alias("injection_point"),
        get("$.content_kind", "string").alias("content_kind"), content.alias("content"), get("$.session_window", "array<string>").alias("session_window"),
        wanted["verdict"].alias("verdict"), wanted["top_layer"].alias("top_layer"), words(wanted["must_hit"]).alias("must_hit"), words(wanted["must_not_hit"]).alias("must_not_hit"),
    )


def read_groups(spark: SparkSession, path: str, max_chars: int = 2000) -> DataFrame:
    """Source files as (group, name, text): the folder is the group, texts are cut to ``max_chars``."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("group"), F.element_at(F.split("path", "/"), -1).alias("name"), F.substring("value", 1, max_chars).alias("text"))


def message_rows(scanned: DataFrame, key: str = "req_id") -> DataFrame:
    """A row per message, with or without hits: verdict, top_layer, hits and alerts in short, notes. Matched text is cut to 64
    characters."""
    hits = F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in ("layer", "rule", "entity", "action", "source", "field_path")], F.substr(h["matched"], F.lit(1), F.lit(MATCHED_CHARS)).alias("matched")))
    alerts = F.transform("alerts", lambda a: F.struct(*[a[c].alias(c) for c in ("category", "confidence", "model")]))
    return scanned.select(key, "verdict", "top_layer", hits.alias("hits"), alerts.alias("alerts"), "notes")


def write_rows(scanned: DataFrame, path: str, key: str = "req_id") -> None:
    """The rows of :func:`message_rows` as Parquet."""
    message_rows(scanned, key).write.mode("overwrite").parquet(path)


def write_safe(scanned: DataFrame, path: str, key: str = "req_id") -> None:
    """Hits without text or place as JSON lines."""
    safe_hits(scanned, key).write.mode("overwrite").json(path)


def write_alerts(scanned: DataFrame, path: str, key: str = "req_id") -> None:
    """Alerts without their context as JSON lines."""
    alerts_table(scanned, key).drop("context").write.mode("append").json(path)
