"""The engine as one object: settings, the scan of a frame, and the tables that come from it."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame

from siltgate.config import ScanConfig
from siltgate.plans import scan as plan
from siltgate.schema import INJECTION_POINTS, LAYERS, VERDICTS
from siltgate.sources import files

InjectionPoint = Enum("InjectionPoint", {n.upper(): n for n in INJECTION_POINTS}, type=str)
Layer = Enum("Layer", {n.replace(".", "_"): n for n in LAYERS}, type=str)
Verdict = Enum("Verdict", {n.upper(): n for n in VERDICTS}, type=str)


class Engine:
    """Scans frames of messages under one set of settings; batch frames and streams alike."""

    def __init__(self, config: ScanConfig | None = None):
        self.config = config or ScanConfig()

    def scan(self, messages: DataFrame) -> DataFrame:
        """A row per message with its verdict, hits, alerts and notes; :func:`siltgate.plans.scan.scan` says what ``messages`` has."""
        return plan.scan(messages, self.config)

    def rows(self, messages: DataFrame, key: str = "req_id") -> DataFrame:
        """A flat row per message."""
        return files.message_rows(self.scan(messages), key)

    def hits(self, messages: DataFrame, key: str = "req_id") -> DataFrame:
        """A row per hit without text or place."""
        return plan.safe_hits(self.scan(messages), key)

    def alerts(self, messages: DataFrame, key: str = "req_id") -> DataFrame:
        """A row per alert without its context."""
        return plan.alerts_table(self.scan(messages), key).drop("context")
