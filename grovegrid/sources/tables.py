"""A case's tables by name, exports for other programs, and fetched tiles with an outcome for each."""

from __future__ import annotations

import os
import shutil
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a case: name -> columns that partition it.
TABLES = {"points": ["tile_id"], "vegetation": ["tile_id"], "segmentation": ["tile_id"], "hulls": ["tile_id"], "gtid_map": [], "forest": ["tile_id"], "dtm": ["tile_id"], "tree_metrics": ["tile_id"], "solids": ["tile_id"], "cityjson": [], "outcomes": ["stage"]}
STATUSES = ("ok", "exists", "not_in_coverage", "download_failed", "empty_tile", "failed")


class Case:
    """The tables of one case under a root folder or bucket path; each is Parquet, partitioned as TABLES says."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, f"{root.rstrip('/')}/{name}", name

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"unknown table {table}; known: {sorted(TABLES)}")
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.option("basePath", self.path(table)).parquet(self.path(table))

    def write(self, df: DataFrame, table: str, overwrite: bool = True) -> None:
        """Replace the partitions that df holds (all others stay), or with overwrite off add those that are not there yet."""
        self.path(table)
        keys = TABLES[table]
        if not overwrite and keys and self.exists(table):
            df = df.join(self.read(table).select(*keys).distinct(), keys, "left_anti")
        elif not overwrite and self.exists(table):
            return
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(*keys) if keys else out).parquet(self.path(table))

    def exists(self, table: str) -> bool:
        jvm, p = self.spark._jvm, self.path(table)
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def tiles(self, table: str = "points") -> list[str]:
        return sorted(r[0] for r in self.read(table).select("tile_id").distinct().collect())


def outcomes(tiles: DataFrame, counted: DataFrame, stage: str, least: int = 1) -> DataFrame:
    """(stage, tile_id, status, did_work, detail): one row for each of tiles(tile_id); a tile of which `counted` has fewer than `least` rows failed."""
    n = counted.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    rows = tiles.select("tile_id").distinct().join(n, "tile_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fine = F.col("n") >= least
    return rows.select(F.lit(stage).alias("stage"), "tile_id", F.when(fine, "ok").otherwise("empty_tile").alias("status"), fine.alias("did_work"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def fetch(url: str, target: str, overwrite: bool = False, opener: Callable = urllib.request.urlopen, piece: int = 1 << 20, timeout: float = 30.0) -> tuple[str, bool, str]:
    """(status, did_work, detail) of one download: pieces go to a file beside the target, which takes its name when all is there."""
    if os.path.exists(target) and not overwrite:
        return "exists", False, target
    part = f"{target}.part"
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    try:
        with opener(url, timeout=timeout) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out, piece)
        os.replace(part, target)
        return "ok", True, target
    except urllib.error.HTTPError as e:
        return ("not_in_coverage" if e.code in (403, 404) else "download_failed"), False, f"HTTP {e.code}"
    except OSError as e:
        return "download_failed", False, str(e)
    finally:
        Path(part).unlink(missing_ok=True)


def fetch_tiles(addresses: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """(stage, tile_id, status, did_work, detail) of addresses(tile_id, url, required): the files go to a folder that all executors see. A tile's
    optional files may be missing without harm to it; the worst status of its required ones counts."""

    def run(batches):
        for b in batches:
            got = [fetch(u, f"{folder}/{t}/{u.rsplit('/', 1)[-1]}", overwrite) for t, u in zip(b.tile_id, b.url, strict=True)]
            yield b[["tile_id", "required"]].assign(status=[g[0] for g in got], did_work=[g[1] for g in got], detail=[g[2] for g in got])

    one = addresses.select("tile_id", "url", "required").mapInPandas(run, "tile_id string, required boolean, status string, did_work boolean, detail string")
    bad = F.max(F.when(F.col("required") & ~F.col("status").isin("ok", "exists"), F.struct("status", "detail")))
    out = one.groupBy("tile_id").agg(bad.alias("bad"), F.bool_or("did_work").alias("did_work"))
    return out.select(F.lit("fetch").alias("stage"), "tile_id", F.coalesce("bad.status", F.when(F.col("did_work"), "ok").otherwise("exists")).alias("status"), "did_work", F.col("bad.detail").alias("detail"))


def tile_catalog(spark: SparkSession, path: str, key: str = "GT_AHNSUB") -> DataFrame:
    """Tiles (tile_id, minx, miny, maxx, maxy in m) of a GeoJSON catalog of named polygons: their bounding boxes."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<properties: map<string,string>, geometry: struct<coordinates: string>>>").alias("d")).select(F.explode("d.features").alias("f"))
    numbers = F.transform(F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[(-?[0-9.eE+]+\s*,\s*-?[0-9.eE+]+)"), 1), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.trim(F.split(p, ",")[1]).cast("double").alias("y")))
    return rows.select(F.col("f.properties")[key].alias("tile_id"), numbers.alias("p")).select("tile_id", *(f(f"p.{a}").alias(f"{n}{a}") for n, f in (("min", F.array_min), ("max", F.array_max)) for a in "xy"))


def write_gtid_map(gtids: DataFrame, path: str) -> None:
    """tile_id,tid,gtid as one CSV with a header, in order of gtid: a row per tree."""
    gtids.select("tile_id", "tid", "gtid").coalesce(1).sortWithinPartitions("gtid").write.mode("overwrite").csv(path, header=True)


def read_gtid_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="tile_id string, tid long, gtid long")


def write_segmentation(segmented: DataFrame, path: str) -> None:
    """Lines `tid x y z` in a folder per tile; tids are counted anew from 0 within the tile, in their order."""
    ranks = segmented.select("tile_id", "tid").distinct().selectExpr("tile_id", "tid", "row_number() over (partition by tile_id order by tid) - 1 as at")
    rows = segmented.join(ranks, ["tile_id", "tid"]).drop("tid").withColumnRenamed("at", "tid")
    rows.select("tile_id", xyz_line("tid")).write.mode("overwrite").partitionBy("tile_id").text(path)


def xyz_line(*before: str):
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in before), *(F.format_string("%.6f", F.col(f"{a}_mm") / 1000.0) for a in "xyz")).alias("value")


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    rows = spark.read.option("basePath", path).schema("value string, tile_id string").text(path)
    return rows.select("tile_id", parts[0].cast("long").alias("tid"), *(F.bround(parts[i].cast("double") * 1000).cast("long").alias(f"{a}_mm") for i, a in enumerate("xyz", 1)))


def write_coloured(segmented: DataFrame, path: str) -> None:
    """Lines `x y z r g b`, a colour of its own for each tree by a hash of (tile_id, tid)."""
    h = F.xxhash64("tile_id", "tid")
    colour = [F.pmod(F.shiftright(h, 8 * i), F.lit(256)).cast("string") for i in range(3)]
    segmented.select(F.concat_ws(" ", xyz_line(), *colour).alias("value")).write.mode("overwrite").text(path)


def write_hulls(hulls: DataFrame, path: str, crs: str = "EPSG:28992") -> None:
    """A GeoJSON collection per tile (tile_id=.../): closed rings in metres; hulls of fewer than three corners are lines or points."""
    pairs = F.transform("ring", lambda p: F.array(p["x_mm"] / 1000.0, p["y_mm"] / 1000.0))
    ring = F.to_json(F.array(F.concat(pairs, F.slice(pairs, 1, 1))))
    shape = F.when(F.size("ring") >= 3, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))).when(F.size("ring") == 2, F.concat(F.lit('{"type":"LineString","coordinates":'), F.to_json(pairs), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(pairs[0]), F.lit("}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"tid":'), F.col("tid").cast("string"), F.lit('},"geometry":'), shape, F.lit("}"))
    one = hulls.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("tid", feature.alias("f")))).alias("fs"))
    name = F.lit(f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"{crs}"}}}},"features":[')
    one.select("tile_id", F.concat(name, F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}")).alias("value")).write.mode("overwrite").partitionBy("tile_id").text(path)


def write_raster(dtm: DataFrame, path: str, cell: int = 500, nodata: int = -9999) -> None:
    """An ASCII grid per tile (tile_id=.../) of metres, rows from the north, nodata where there is no cell.
    A tile's text (32 MB for a kilometre of half metres) is put together in one task."""
    box = dtm.groupBy("tile_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    rows = dtm.groupBy("tile_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "z_mm"))).alias("m"))
    every = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).join(rows, ["tile_id", "row"], "left")
    value = F.transform(F.sequence("c0", "c1"), lambda c: F.when(F.col("m")[c].isNotNull(), F.format_string("%.3f", F.col("m")[c] / 1000.0)).otherwise(str(nodata)))
    lines = every.select("tile_id", (-F.col("row")).alias("at"), F.array_join(value, " ").alias("value"))
    corner = lambda c: F.format_string("%.3f", F.col(c) * cell / 1000.0)
    head = box.select("tile_id", F.posexplode(F.array(
        F.concat(F.lit("ncols "), (F.col("c1") - F.col("c0") + 1).cast("string")), F.concat(F.lit("nrows "), (F.col("r1") - F.col("r0") + 1).cast("string")),
        F.concat(F.lit("xllcorner "), corner("c0")), F.concat(F.lit("yllcorner "), corner("r0")), F.lit(f"cellsize {cell / 1000}"), F.lit(f"NODATA_value {nodata}")))).select("tile_id", (F.col("pos").cast("long") - (1 << 40)).alias("at"), F.col("col").alias("value"))
    every = head.unionByName(lines.select("tile_id", F.col("at").cast("long").alias("at"), "value")).groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("ls"))
    every.select("tile_id", F.array_join(F.transform("ls", lambda x: x["value"]), "\n").alias("value")).write.mode("overwrite").partitionBy("tile_id").text(path)


def read_raster_under(dtm: DataFrame, hulls: DataFrame, cell: int = 500, coarse: int = 4000) -> DataFrame:
    """The raster's cells (gtid, row, col, z_mm) whose centres lie in or on each hull: a masked read."""
    from ..operators.forest import cells_under

    return cells_under(hulls, dtm, cell, coarse).select("tile_id", "gtid", "row", "col", "z_mm")


def write_documents(documents: DataFrame, path: str) -> None:
    """A CityJSON document per tile (tile_id=.../); tiles without a document have no file."""
    documents.where("doc is not null").select("tile_id", F.col("doc").alias("value")).write.mode("overwrite").partitionBy("tile_id").text(path)
