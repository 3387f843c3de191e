"""Tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of 64-bit keys that may be broadcast (8 to 32 MB as a hash relation); beyond it joins shuffle.
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only where it is unset and the master is local (tests) one of our own. A cluster without one is an error,
    as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_grovegrid_dir", None)
        if not found:
            found = spark.sparkContext._grovegrid_dir = f"file://{tempfile.mkdtemp(prefix='grovegrid-')}"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, row_group: int | None = None, wide: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: a lost executor costs no recomputation.

    row_group: bytes of a row group, which a writing task holds in memory; for tables of whole texts.
    wide: a row is a MB or so. Sizes are looked at after each row, as the first hundred would be a row group and a page.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grovegrid/{name}-{uuid.uuid4().hex}"
    to = df.write.option("parquet.block.size", row_group) if row_group else df.write
    if wide:
        to = to.options(**{"parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1})
    to.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._grovegrid_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_grovegrid_path", None)
        if path:
            jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def sized(small: DataFrame, rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Mark a table of known row count for broadcast if it is within the limit; else leave it to a shuffled join."""
    return F.broadcast(small) if rows <= limit else small


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What is run inside has Arrow batches of at most so many rows; the session's own value holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python stages: bound the rows of an Arrow batch, since texts can be long (a smaller value that
    the session has is kept), and let workers on this machine find this package where it is not installed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, env.get("PYTHONPATH", "")) if x)
