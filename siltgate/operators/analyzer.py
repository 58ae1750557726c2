"""Personal data from an injected analyzer: unique texts of a message, in chunks, within a time budget."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltgate.config import ScanConfig

#: A client takes (text, language, timeout) and returns results with entity_type, start, end, score.
Client = Callable[[str, str, float], list[dict]]

RESULT = T.StructType([T.StructField(n, t) for n, t in (("lang", T.StringType()), ("entity_type", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("score", T.DoubleType()))])
ANALYSED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("results", T.ArrayType(RESULT))]))


def _pieces(text: str, cfg: ScanConfig) -> list[str]:
    if len(text) <= cfg.l3_max_variant_len:
        return [text]
    return [text[i : i + cfg.l3_chunk_size] for i in range(0, len(text), cfg.l3_chunk_size)][: cfg.l3_max_chunks]


def _ask(client: Client, piece: str, cfg: ScanConfig) -> tuple[str, list[dict]]:
    """Results of all languages that answer, and whether all, some or none did. Whatever a client raises is no answer."""
    got, failed = [], 0
    for lang in cfg.languages:
        try:
            got += [{"lang": lang, "entity_type": str(r.get("entity_type", "")), "start": int(r.get("start", -1)), "end": int(r.get("end", -1)), "score": float(r.get("score", 0.0))} for r in client(piece, lang, cfg.l3_timeout_s)]
        except Exception:
            failed += 1
    return ("ok" if not failed else "unreachable" if failed == len(cfg.languages) else "partial"), got


def with_results(df: DataFrame, client: Client, cfg: ScanConfig | None = None, texts_column: str = "l3_texts") -> DataFrame:
    """``df`` with ``l3_results``: for each piece of its array of texts the status and the results.

    A message's pieces are asked for together; those that are not done within the budget have status ``late``.
    """
    cfg = cfg or ScanConfig(l3="results")
    schema = T.StructType([*df.schema.fields, T.StructField("l3_results", ANALYSED)])

    def message(pool: ThreadPoolExecutor, texts) -> tuple[list[dict], bool]:
        """Results by piece, and whether calls are left that did not end in time."""
        began, asked = time.monotonic(), []
        for t in dict.fromkeys([] if texts is None else list(texts)):
            asked += [(p, pool.submit(_ask, client, p, cfg)) for p in _pieces(t, cfg)]
        wait([f for _, f in asked], timeout=max(0.0, cfg.l3_budget_s - (time.monotonic() - began)))
        out, hung = [], False
        for piece, future in asked:
            status, results = future.result() if future.done() else ("late", [])
            hung |= not future.done() and not future.cancel()
            out.append({"text": piece, "status": status, "results": results})
        return out, hung

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(cfg.l3_concurrency)
        try:
            for frame in frames:
                found = []
                for texts in frame[texts_column]:
                    results, hung = message(pool, texts)
                    found.append(results)
                    if hung:
                        # Calls that hang keep their threads: later messages get a pool of their own.
                        pool.shutdown(wait=False, cancel_futures=True)
                        pool = ThreadPoolExecutor(cfg.l3_concurrency)
                yield frame.assign(l3_results=found)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(run, schema)
