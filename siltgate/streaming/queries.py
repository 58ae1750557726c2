"""Registered queries that run as streams: conversations are read as a stream, and its results as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgate.config import ScanConfig
from siltgate.streaming import stream


def _shared(spark: SparkSession) -> str:
    """The folder that all executors see, or the warehouse where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/siltgate-stream-{uuid.uuid4().hex}"


def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of messages; a turn's second is its time."""
    name = "conversations.parquet"
    known = spark.read.parquet(f"{sf_dir}/{name}")
    source = spark.readStream.schema(known.schema)
    # A stream reads folders: a table that is one file is picked out of its folder by name.
    single = any(f.endswith(f"/{name}") for f in known.inputFiles()[:1])
    rows = source.option("pathGlobFilter", name).parquet(sf_dir) if single else source.parquet(f"{sf_dir}/{name}")
    return rows.select(
        F.col("conv_id").cast("string").alias("session"), "turn", F.timestamp_seconds(F.lit(1_767_225_600) + F.col("turn")).alias("event_time"),
        F.concat_ws("-", "conv_id", "turn").alias("req_id"), F.lit("prompt").alias("injection_point"), F.lit("text").alias("content_kind"), F.col("text").alias("content"),
    )


def finished(out: DataFrame) -> DataFrame:
    """Runs a stream over what is there now and reads what it wrote."""
    spark, path = out.sparkSession, _shared(out.sparkSession)
    query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session window that keyed state gives every message."""
    windowed = stream.session_windows(live_messages(spark, sf_dir))
    joined = F.concat(F.array_join("session_window", ""), F.coalesce("content", F.lit("")))
    return finished(windowed.select("req_id", F.size("session_window").alias("n_earlier"), F.sha2(joined, 256).alias("window_sha256")))


STREAM_WINDOWS = f"""
SELECT conv_id || '-' || turn AS req_id, CAST(count(*) OVER w AS INT) AS n_earlier, sha256(coalesce(string_agg(coalesce(text, ''), '') OVER w, '') || coalesce(text, '')) AS window_sha256
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {stream.FRAGMENTS} PRECEDING AND 1 PRECEDING)
"""


def q_stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan as a stream, with a key and an address in some first turns: a session's later turns have them in their window."""
    told = F.when((F.col("turn") == 0) & (F.col("session") % 3 == 0), F.concat(F.lit("key AKIA"), F.lpad("session", 16, "0"), F.lit(" "), "content"))
    told = told.when((F.col("turn") == 0) & (F.col("session") % 3 == 1), F.concat(F.lit("SEV1-12345 "), "content")).otherwise(F.col("content"))
    windowed = stream.session_windows(live_messages(spark, sf_dir).withColumn("content", told))
    return finished(stream.scan_stream(windowed, ScanConfig(l3="off")).select("req_id", "verdict", "top_layer"))


#: What the conversations hold themselves counts too: none of it looks like a key or a ticket.
STREAM_VERDICTS = f"""
WITH w AS (
  SELECT conv_id, turn, row_number() OVER o - 1 AS before, first_value(turn) OVER o = 0 AS starts, string_agg(coalesce(text, ''), '') OVER o AS seen
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id || '-' || turn AS req_id, CASE WHEN regexp_matches(seen, 'A[KS]IA[0-9A-Z]{{16}}') OR (conv_id % 3 = 0 AND starts AND before <= {stream.FRAGMENTS}) THEN 'block' WHEN regexp_matches(seen, 'SEV[0-9]-[0-9]{{3}}') OR (conv_id % 3 = 1 AND starts AND before <= {stream.FRAGMENTS}) THEN 'redact' ELSE 'pass' END AS verdict,
  CASE WHEN conv_id % 3 = 0 AND starts AND before <= {stream.FRAGMENTS} THEN 'L0' WHEN conv_id % 3 = 1 AND starts AND before <= {stream.FRAGMENTS} THEN 'L3.5' END AS top_layer
FROM w
"""
