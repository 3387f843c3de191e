"""Trees: separation, hulls, numbering over all tiles, joins, metrics, solids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import groups, kernels
from .spatial import nearest_join


def segment(points: DataFrame, **options) -> DataFrame:
    """(tile_id, point_id, tid) for the points in a tree; the sweep sees one tile at a time."""

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        tid = kernels.separate_trees(rows.point_id.to_numpy(), rows[["x_mm", "y_mm", "z_mm"]].to_numpy(), **options)
        return rows[["tile_id", "point_id"]].assign(tid=tid)[tid >= 0]

    return points.select("tile_id", "point_id", "x_mm", "y_mm", "z_mm").groupBy("tile_id").applyInPandas(tile, "tile_id string, point_id long, tid long")


def propagate(points: DataFrame, labelled: DataFrame, reach: int = 2500) -> DataFrame:
    """(tile_id, point_id, tid) of the points that join a tree in one round: that of the nearest of labelled(..., tid) at less than reach (ties: lowest id)."""
    return nearest_join(points, labelled, reach, carry="tid").select("tile_id", F.col("q_id").alias("point_id"), "tid")


def hulls(points: DataFrame, keys: tuple[str, ...] = ("tile_id", "tid"), every: bool = False) -> DataFrame:
    """Convex hull (ring), area (m2) and centroid (mm) for each tree of three points at least; with every, nulls for the others."""

    def trees(table: pa.Table, first: np.ndarray) -> pa.Table:
        found = [outline(xy) for xy in np.split(groups.columns(table, ["x_mm", "y_mm"]), first[1:])]
        out = outlined(table.select(list(keys)).take(first), found)
        return out if every else out.filter(pa.array([f is not None for f in found], pa.bool_()))

    return groups.in_groups(points.select(*keys, "x_mm", "y_mm"), keys, trees, f"{groups.key_schema(points, keys)}, {OUTLINE}")


#: Fixed value: the columns that outlined adds.
OUTLINE = "ring array<struct<x_mm:bigint,y_mm:bigint>>, area_m2 double, cx double, cy double"


def outline(xy: np.ndarray) -> tuple[np.ndarray, float, float, float] | None:
    """The hull's corners, area (m2) and centroid; none for fewer than three points."""
    if len(xy) < 3:
        return None
    ring = kernels.hull(xy)
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    area = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2
    if area > 0:
        ox, oy = x[0], y[0]
        c2 = (x - ox) * (np.roll(y, -1) - oy) - (np.roll(x, -1) - ox) * (y - oy)
        cx = ox + ((x + np.roll(x, -1) - 2 * ox) * c2).sum() / (6 * area)
        cy = oy + ((y + np.roll(y, -1) - 2 * oy) * c2).sum() / (6 * area)
    else:
        cx, cy = x.mean(), y.mean()
    return ring, max(area, 0.0) / 1e6, cx, cy


def outlined(rows: pa.Table, found: list) -> pa.Table:
    """rows with the columns of OUTLINE, one outline or none for each."""
    rings = [np.zeros((0, 2), np.int64) if f is None else f[0] for f in found]
    corners = np.concatenate(rings).astype(np.int64)
    values = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["x_mm", "y_mm"])
    ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rings]))), pa.int32())
    rows = rows.append_column("ring", pa.ListArray.from_arrays(ends, values, mask=pa.array([f is None for f in found], pa.bool_())))
    for i, name in enumerate(("area_m2", "cx", "cy"), 1):
        rows = rows.append_column(name, pa.array([None if f is None else float(f[i]) for f in found], pa.float64()))
    return rows


def number_trees(trees: DataFrame) -> DataFrame:
    """(tile_id, tid, gtid): 1..N by tile, then tid. Counts per tile give offsets, so no window spans all rows."""
    one = trees.select("tile_id", "tid").distinct()
    offset = one.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("tile_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(W.partitionBy("tile_id").orderBy("tid"))
    return one.withColumn("rank", at).join(F.broadcast(offset.select("tile_id", "before")), "tile_id").select("tile_id", "tid", (F.col("before") + F.col("rank")).cast("long").alias("gtid"))


def min_raster(points: DataFrame, cell: int = 500, spread: bool = False) -> DataFrame:
    """The lowest z per cell; with spread, over the points at most cell * sqrt(2) from the cell's centre."""
    ground = points.where("classification = 2").withColumns({"row": F.floor(F.col("y_mm") / cell), "col": F.floor(F.col("x_mm") / cell)})
    if spread:
        steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)))
        ground = ground.withColumn("o", F.explode(steps)).withColumns({"row": F.col("row") + F.col("o.i"), "col": F.col("col") + F.col("o.j")})
        dx, dy = 2 * F.col("x_mm") - (2 * F.col("col") + 1) * cell, 2 * F.col("y_mm") - (2 * F.col("row") + 1) * cell
        ground = ground.where(dx * dx + dy * dy <= 8 * cell * cell)
    return ground.groupBy("tile_id", "row", "col").agg(F.min("z_mm").alias("z_mm"))


def trunk_base(trees: DataFrame, dtm: DataFrame, cell: int = 500, reach: int = 2000) -> DataFrame:
    """For trees(tile_id, gtid, cx, cy): the raster cell of the own tile nearest to the centroid within reach
    (ties: row, then column). Cells are matched on a coarse grid, an equi-join."""
    coarse = F.floor(F.col("cx") / reach), F.floor(F.col("cy") / reach)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    one = trees.withColumn("o", F.explode(steps)).withColumns({"gx": coarse[0] + F.col("o.i"), "gy": coarse[1] + F.col("o.j")})
    x, y = (F.col("col") * 2 + 1) * cell / 2, (F.col("row") * 2 + 1) * cell / 2
    two = dtm.withColumns({"px": x, "py": y, "gx": F.floor(x / reach), "gy": F.floor(y / reach)})
    d2 = (F.col("cx") - F.col("px")) * (F.col("cx") - F.col("px")) + (F.col("cy") - F.col("py")) * (F.col("cy") - F.col("py"))
    pairs = one.join(two, ["tile_id", "gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= float(reach) ** 2)
    return pairs.groupBy("tile_id", "gtid").agg(F.min(F.struct("d2", "row", "col", "z_mm")).alias("b")).select("tile_id", "gtid", F.col("b.row").alias("row"), F.col("b.col").alias("col"), F.col("b.z_mm").alias("base_z_mm"))


def cells_under(hulls: DataFrame, dtm: DataFrame, cell: int = 500, coarse: int = 4000, kept: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Raster cells of the own tile whose centres (px, py) lie in or on each of hulls(tile_id, gtid, ring counter-clockwise, cx, cy); with how
    left also hulls without one."""
    one = hulls.select("tile_id", "gtid", "ring", "cx", "cy", *(kept or []), *(f(f"ring.{a}_mm").alias(f"{a}{n}") for n, f in enumerate((F.array_min, F.array_max)) for a in "xy"))
    for g, lo, hi in (("gx", "x0", "x1"), ("gy", "y0", "y1")):
        one = one.withColumn(g, F.explode_outer(F.sequence(F.floor(F.col(lo) / coarse), F.floor(F.col(hi) / coarse))))
    x, y = (F.col("col") * 2 + 1) * cell / 2, (F.col("row") * 2 + 1) * cell / 2
    two = dtm.withColumns({"px": x, "py": y, "gx": F.floor(x / coarse), "gy": F.floor(y / coarse)})
    inside = "forall(sequence(0, size(ring) - 1), i -> (ring[(i + 1) % size(ring)].x_mm - ring[i].x_mm) * (py - ring[i].y_mm) - (ring[(i + 1) % size(ring)].y_mm - ring[i].y_mm) * (px - ring[i].x_mm) >= 0)"
    same = [F.col(f"q.{c}") == F.col(f"c.{c}") for c in ("tile_id", "gx", "gy")]
    on = same[0] & same[1] & same[2] & F.expr("px between x0 and x1 and py between y0 and y1") & F.expr(inside)
    return one.alias("q").join(two.alias("c"), on, how).select(*(F.col(f"q.{c}") for c in one.columns), *(F.col(f"c.{c}") for c in two.columns if c not in ("tile_id", "gx", "gy")))


def _nearest_cell() -> Column:
    d2 = (F.col("cx") - F.col("px")) * (F.col("cx") - F.col("px")) + (F.col("cy") - F.col("py")) * (F.col("cy") - F.col("py"))
    return F.min(F.when(d2.isNotNull(), F.struct(d2.alias("d2"), "row", "col", "z_mm")))


def trunk_base_under(trees: DataFrame, hulls: DataFrame, dtm: DataFrame, cell: int = 500, coarse: int = 4000) -> DataFrame:
    """For each of trees(tile_id, gtid): of all raster cells of the own tile whose centres lie in or on the tree's hull
    (hulls: ring counter-clockwise, cx, cy) the one nearest to the centroid (ties: row, then column); nulls if there is none."""
    best = cells_under(hulls, dtm, cell, coarse).groupBy("tile_id", "gtid").agg(_nearest_cell().alias("b"))
    out = trees.select("tile_id", "gtid").distinct().join(best, ["tile_id", "gtid"], "left")
    return out.select("tile_id", "gtid", F.col("b.row").alias("row"), F.col("b.col").alias("col"), F.col("b.z_mm").alias("base_z_mm"))


def with_trunk_base(crowns: DataFrame, dtm: DataFrame, cell: int = 500, coarse: int = 4000) -> DataFrame:
    """trunk_base_under for crowns(tile_id, gtid, ring, cx, cy, ...), one row for each tree with a null ring where it has no hull; all columns but these
    three are kept. Crowns are worked out once, where trunk_base_under reads trees and hulls apart."""
    kept = [c for c in crowns.columns if c not in ("tile_id", "gtid", "ring", "cx", "cy")]
    best = cells_under(crowns, dtm, cell, coarse, kept, "left").groupBy("tile_id", "gtid").agg(*(F.first(c).alias(c) for c in kept), _nearest_cell().alias("b"))
    return best.select("tile_id", "gtid", *kept, F.col("b.row").alias("row"), F.col("b.col").alias("col"), F.col("b.z_mm").alias("base_z_mm"))


def crown_width(area_m2: Column) -> Column:
    """The diameter (m) of a circle of the hull's area."""
    return 2 * F.sqrt(area_m2 / F.pi())


def allometry(crown_width: Column, median_z: Column, base_z: Column, a: float = 1.0, b: float = 1.1, c: float = 0.7) -> tuple[Column, Column, Column]:
    """Height, stem diameter and radius (m) of a trunk; without a positive height the last two are null."""
    h = median_z - base_z
    dbh = F.when(h > 0, a * F.pow(crown_width, F.lit(b)) * F.pow(h, F.lit(c)) / 100)
    return h, dbh, dbh / 2


def trunk_ring(sections: int = 24) -> Column:
    """Corners (i, cos, sin) of a closed cylinder's ring."""
    angle = lambda i: i * F.lit(2 * np.pi / sections)
    return F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), lambda i: F.struct(i.alias("i"), F.cos(angle(i)).alias("c"), F.sin(angle(i)).alias("s")))


def voxels(points: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    return voxel_of(points, size, keys).distinct()


def voxel_of(points: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """The voxel (keys, i, j, k) of each point."""
    return points.select(*keys, *(F.floor(F.col(f"{a}_mm") / size).alias(v) for a, v in zip("xyz", "ijk", strict=True)))


def voxel_faces(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Triangles (ax..cz, in voxel corners) between a voxel and an empty neighbour: a closed surface."""
    corner = lambda v: F.struct((F.col("i") + v[0]).alias("x"), (F.col("j") + v[1]).alias("y"), (F.col("k") + v[2]).alias("z"))
    sides = F.array(*(F.struct((F.col("i") + n[0]).alias("ni"), (F.col("j") + n[1]).alias("nj"), (F.col("k") + n[2]).alias("nk"), F.array(*(F.struct(*(corner(v).alias(c) for v, c in zip(t, "abc", strict=True))) for t in ts)).alias("ts")) for n, *ts in kernels.SIDES))
    out = cells.withColumn("s", F.explode(sides)).select(*keys, "s.*")
    full = cells.withColumnsRenamed({"i": "ni", "j": "nj", "k": "nk"})
    return out.join(full, [*keys, "ni", "nj", "nk"], "left_anti").select(*keys, F.explode("ts").alias("t")).select(*keys, "t.*")


CHECKS = ("n_faces", "six_volume", "n_edges", "n_open")


def checked(rows: DataFrame, keys: tuple[str, ...], mesh, single: bool = False) -> DataFrame:
    """(keys, n_faces, six_volume, n_edges, n_open) of each solid that has a face: mesh(rows of whole solids, solid of each) gives solids and corners of
    their triangles. Only rows are dealt out, no faces or edges; with single each row is a solid and stays where it is."""

    def solids(table: pa.Table, first: np.ndarray) -> pa.Table:
        solid = np.repeat(np.arange(len(first)), np.diff(first, append=table.num_rows))
        got = kernels.mesh_checks(*mesh(table, solid), len(first))
        out = table.select(list(keys)).take(first)
        for name, values in zip(CHECKS, got, strict=True):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out.filter(pa.array(got[0] > 0))

    def rowwise(batches):
        for b in batches:
            if b.num_rows:
                yield from solids(pa.Table.from_batches([b]), np.arange(b.num_rows)).to_batches()

    schema = groups.key_schema(rows, keys) + "".join(f", {c} long" for c in CHECKS)
    return rows.mapInArrow(rowwise, schema) if single else groups.in_groups(rows, keys, solids, schema)


def voxel_checks(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """open_edges of the surface of voxels (keys, i, j, k; each any number of times)."""
    return checked(cells.select(*keys, "i", "j", "k"), keys, lambda table, solid: kernels.voxel_surface(solid, groups.columns(table, ["i", "j", "k"])))


def open_edges(faces: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per solid: faces, undirected edges, edges with an odd number of faces (0: watertight), and six times the volume."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.lit(i).alias("i")) for i, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))))
    c = lambda p, q: F.col(f"{p}.{q}")
    six = c("a", "x") * (c("b", "y") * c("c", "z") - c("b", "z") * c("c", "y")) - c("a", "y") * (c("b", "x") * c("c", "z") - c("b", "z") * c("c", "x")) + c("a", "z") * (c("b", "x") * c("c", "y") - c("b", "y") * c("c", "x"))
    # A face's volume is counted with its first edge, so that one pass over the edges gives all.
    one = F.when(F.col("e.i") == 0, F.lit(1)).otherwise(F.lit(0))
    edges = faces.select(*keys, six.alias("six"), F.explode(pairs).alias("e")).groupBy(*keys, "e.u", "e.v")
    edges = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("f"), F.sum(one * F.col("six")).alias("six"))
    return edges.groupBy(*keys).agg(F.sum("f").cast("long").alias("n_faces"), F.sum("six").alias("six_volume"), F.count(F.lit(1)).alias("n_edges"), F.sum((F.col("n") % 2).cast("long")).alias("n_open"))
