"""Tiles as they arrive: a file stream of point tables, each tile processed once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(all_ids: DataFrame, *done: DataFrame, key: str = "gtid") -> DataFrame:
    """Rows of all_ids whose key is in none of the others."""
    for d in done:
        all_ids = all_ids.join(d.select(key), key, "left_anti")
    return all_ids


def process_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, process: Callable[[DataFrame], DataFrame], arrived: str | None = None):
    """Start a stream over Parquet files of points. Points are kept per tile and batch in `arrived` (beside target by default); each tile
    that a batch touches is processed anew with all its points so far, and its partition of target overwritten. A batch that
    runs again after a failure overwrites its own points, so none counts twice."""
    kept = arrived or f"{target.rstrip('/')}-arrived"

    def batch(df: DataFrame, number: int) -> None:
        part = df.withColumn("batch", F.lit(number))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "tile_id").parquet(kept)
        so_far = spark.read.schema(f"{schema}, batch long").parquet(kept)
        touched = so_far.where(F.col("batch") == number).select("tile_id").distinct()
        whole = so_far.where(F.col("batch") <= number).join(touched, "tile_id", "left_semi").drop("batch").select(*df.columns)
        process(whole).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def echo_counts(points: DataFrame) -> DataFrame:
    """Running counts per tile and number of returns, for a stream or a table."""
    return points.groupBy("tile_id", "number_of_returns").agg(F.count(F.lit(1)).alias("n"))
