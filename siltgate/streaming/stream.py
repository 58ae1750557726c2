"""The scan on streams: the same stateless plan, a session buffer as keyed state, and an alert sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltgate.config import ScanConfig
from siltgate.plans.scan import alerts_table, once, safe_hits, scan

#: Fragments of a session that are kept, at most, and how long they are kept without a new one.
FRAGMENTS, IDLE = 32, "1 hour"
WINDOWED = "session string, turn long, event_time timestamp, req_id string, injection_point string, content_kind string, content string, session_window array<string>"


def session_windows(messages: DataFrame, fragments: int = FRAGMENTS, idle_ms: int = 3_600_000, watermark: str = IDLE) -> DataFrame:
    """Messages (session, turn, event_time, req_id, injection_point, content_kind, content) with their earlier texts.

    State is the last fragments of each session; it goes after ``idle_ms`` of event time without a message.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["event_time", "turn"], kind="stable")
        windows = []
        for text in rows["content"]:
            windows.append(list(kept))
            kept = [*kept, text or ""][-fragments:]
        state.update((kept,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["event_time"].max().timestamp() * 1000)) + idle_ms)
        yield rows.assign(session=key[0], session_window=windows)[[f.split()[0] for f in WINDOWED.split(", ")]]

    timed = messages.withWatermark("event_time", watermark)
    made = timed.groupBy("session").applyInPandasWithState(run, WINDOWED, "fragments array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    # The state operator's rows have no binary form, which an Arrow function right above it would need.
    return once(made, "content", F.col("content"))


def scan_stream(messages: DataFrame, cfg: ScanConfig | None = None) -> DataFrame:
    """The scan of a stream of requests; the plan is the batch plan."""
    return scan(messages, cfg)


def sink(scanned: DataFrame, hits_path: str, alerts_path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch's safe hits and alerts (without context) as files. Batches are written by number, so that a
    batch that runs again replaces what it wrote before."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        safe_hits(batch).write.mode("overwrite").parquet(f"{hits_path}/batch={number}")
        alerts_table(batch).drop("context").write.mode("overwrite").parquet(f"{alerts_path}/batch={number}")
        batch.unpersist()

    return scanned.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def batch_windows(messages: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """The same windows over a table: the earlier texts of the session, the last ``fragments`` of them."""
    from pyspark.sql import Window

    earlier = Window.partitionBy("session").orderBy("turn").rowsBetween(-fragments, -1)
    return messages.withColumn("session_window", F.collect_list(F.coalesce("content", F.lit(""))).over(earlier))
