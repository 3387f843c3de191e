"""The test point cloud derived from `lineitem`, and its companion tables, as SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: An order is a pulse, its line items the echoes, a supplier a column of vegetation. Millimetres.
POINTS = """
WITH e AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice*100) AS BIGINT) AS cents,
         CAST(l_quantity AS BIGINT) AS q, l_shipdate, l_linestatus, l_returnflag FROM {lineitem}),
p AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cents, l_shipdate) AS INT) AS return_number,
         CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS number_of_returns FROM e),
x AS (
  SELECT l_orderkey*100 + return_number AS point_id, return_number, number_of_returns,
         CASE WHEN l_linestatus='F' AND l_returnflag='A' THEN 2 ELSE 1 END AS classification, l_suppkey AS src_id,
         (l_suppkey%32)*6000 + (l_partkey*7919 + q*31)%4000 - 2000 AS x_mm,
         CAST(floor(l_suppkey/32.0) AS BIGINT)*6000 + (cents*10473)%4000 - 2000 AS y_mm,
         2000 + q*120 + cents%120 AS z_mm FROM p)
SELECT concat(lpad(CAST(CAST(floor((x_mm+3000)/24000.0) AS BIGINT) AS VARCHAR(20)), 6, '0'), '_', lpad(CAST(CAST(floor((y_mm+3000)/24000.0) AS BIGINT) AS VARCHAR(20)), 6, '0')) AS tile_id, x.* FROM x
"""
#: A non-convex area of interest: edges of one ring, in mm.
AOI_RING = [(-3000, -3000), (27000, -3000), (27000, 3000), (9000, 3000), (9000, 15000), (-3000, 15000), (-3000, -3000)]
AOI_EDGES = [(0, 0, i, *a, *b) for i, (a, b) in enumerate(zip(AOI_RING, AOI_RING[1:], strict=False))]
AOI_SQL = "(VALUES " + ", ".join(str(e) for e in AOI_EDGES) + ") edges(part, ring, seq, x1, y1, x2, y2)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def aoi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AOI_EDGES, "part int, ring int, seq int, x1 long, y1 long, x2 long, y2 long")


def with_points(sql: str) -> str:
    """DuckDB SQL over a view `points`."""
    body = sql.strip()
    head = "WITH points AS (" + POINTS.format(lineitem="lineitem") + ")"
    if body.upper().startswith("WITH RECURSIVE"):
        return head.replace("WITH", "WITH RECURSIVE", 1) + ", " + body[len("WITH RECURSIVE"):]
    return head + (", " + body[4:] if body.upper().startswith("WITH") else " " + body)
