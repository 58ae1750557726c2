"""Gives Python workers this package, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once; Spark's own file server brings them to the executors.

    Workers then need neither the driver's working folder nor its search path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="siltgate-ship-")) / "siltgate.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(packed))
    _SHIPPED.add(context.applicationId)
