"""Tile catalogs, download addresses and outcome tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the 1 km tile grid: its origin and step in metres.
GRID_ORIGIN = (12000, 304000)
GRID_STEP = 1000
SCHEMES = {4: "catalog", 5: "catalog", 6: "grid"}


def scheme(version: int) -> str:
    """How a release is tiled: by a catalog of named tiles or by the kilometre grid."""
    if version not in SCHEMES:
        raise ValueError(f"unknown release {version}; known: {sorted(SCHEMES)}")
    return SCHEMES[version]


def grid_tiles(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Tiles (tile_id, minx, miny, maxx, maxy in m) whose square touches the box, x before y."""
    low = [int((v - o) // GRID_STEP) * GRID_STEP + o for v, o in zip((minx, miny), GRID_ORIGIN, strict=True)]
    out = spark.sql(f"SELECT explode(sequence({low[0]}L, {int(maxx)}L, {GRID_STEP}L)) AS minx").withColumn("miny", F.explode(F.sequence(F.lit(low[1]).cast("long"), F.lit(int(maxy)).cast("long"), F.lit(GRID_STEP).cast("long"))))
    return out.select(F.format_string("%06d_%06d", "minx", "miny").alias("tile_id"), "minx", "miny", (F.col("minx") + GRID_STEP).alias("maxx"), (F.col("miny") + GRID_STEP).alias("maxy"))


def address(template: str, tile_id: Column) -> Column:
    """A template with {tile} filled in."""
    before, _, after = template.partition("{tile}")
    return F.concat(F.lit(before), tile_id, F.lit(after))


def touching(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Tiles (tile_id, x1.. as minx, miny, maxx, maxy) that a polygon meets: an edge in the square, or a corner of it inside."""
    from ..operators.spatial import inside

    def clipped(p0: str, p1: str, low: str, high: str):
        d = F.col(p1) - F.col(p0)
        a, b = (F.col(low) - F.col(p0)) / F.nullif(d, F.lit(0)), (F.col(high) - F.col(p0)) / F.nullif(d, F.lit(0))
        flat = F.col(p0).between(F.col(low), F.col(high))
        return F.when(d == 0, F.when(flat, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(flat, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    box = F.col("maxx") >= F.least("x1", "x2"), F.col("minx") <= F.greatest("x1", "x2"), F.col("maxy") >= F.least("y1", "y2"), F.col("miny") <= F.greatest("y1", "y2")
    pairs = tiles.join(F.broadcast(edges), box[0] & box[1] & box[2] & box[3])
    ax, bx = clipped("x1", "x2", "minx", "maxx")
    ay, by = clipped("y1", "y2", "miny", "maxy")
    met = pairs.where(F.greatest(F.lit(0.0), ax, ay) <= F.least(F.lit(1.0), bx, by)).select("tile_id")
    corner = inside(tiles.select("tile_id", F.col("minx").alias("x_mm"), F.col("miny").alias("y_mm")), edges, ["tile_id"]).select("tile_id")
    return tiles.join(met.unionByName(corner).distinct(), "tile_id", "left_semi")


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("did_work").cast("long")).alias("n_worked"))
