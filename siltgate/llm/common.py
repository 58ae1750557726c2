"""Helpers that several training-data operators share: table access, shared storage, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time; a longer single text is one slice.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark reads it, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Only where neither that setting nor a checkpoint folder of
    the context is there and all tasks run in this process a temporary folder is made; on a cluster
    that is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    made = tempfile.mkdtemp(prefix="siltgate-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/siltgate/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    Zstandard keeps these short-lived tables small.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files that a frame from :func:`stored` reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a :func:`stored` whose tables are deleted when the block ends: for what no later step reads."""
    paths = []

    def put(df: DataFrame, what: str) -> DataFrame:
        paths.append(fresh_path(spark, what))
        df.write.option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            drop_path(spark, path)


#: Rows and bytes that go to a Python worker at a time, at most: texts differ in length a thousandfold, and two copies
#: of a batch are held in either process.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS rows and about BATCH_BYTES.

    Both bounds are settings of the session, read when the plan runs, so they stay set; smaller ones are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def unique_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores in front, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
