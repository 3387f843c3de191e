"""Spatial joins as equi-joins on grid cells with an exact residual predicate; coordinates are integer millimetres."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import groups, kernels

AXES = ("x_mm", "y_mm", "z_mm")


def _cells(df: DataFrame, size: int, dims: int, offsets: bool) -> DataFrame:
    cell = [F.floor(F.col(a) / F.lit(size)).cast("long") for a in AXES[:dims]]
    if not offsets:
        return df.withColumns({f"_c{i}": c for i, c in enumerate(cell)})
    steps = F.array(*(F.struct(*(F.lit(v).alias(f"_o{i}") for i, v in enumerate(o))) for o in product((-1, 0, 1), repeat=dims)))
    df = df.withColumns({f"_b{i}": c for i, c in enumerate(cell)}).withColumn("_o", F.explode(steps))
    return df.withColumns({f"_c{i}": F.col(f"_b{i}") + F.col(f"_o._o{i}") for i in range(dims)}).drop("_o", *(f"_b{i}" for i in range(dims)))


def squared_distance(dims: int = 3) -> Column:
    return sum(((F.col(f"q.{a}") - F.col(f"p.{a}")) * (F.col(f"q.{a}") - F.col(f"p.{a}")) for a in AXES[:dims]), F.lit(0).cast("long"))


def grid_join(query: DataFrame, base: DataFrame, radius: int, closed: bool, dims: int = 3, keys: tuple[str, ...] = ("tile_id",), limit: int | None = None) -> DataFrame:
    """Pairs (keys, q_id, p_id, d2) of points within radius (mm); limit is a squared distance in place of radius**2.

    The query side gets the 3**dims neighbour cells, so that Catalyst plans a hash or sort-merge join on keys and cell.
    """
    bound = radius * radius if limit is None else limit
    one = _cells(query.select(*keys, F.col("point_id"), *AXES), radius, dims, True).alias("q")
    two = _cells(base.select(*keys, F.col("point_id"), *AXES), radius, dims, False).alias("p")
    same = [F.col(f"q.{c}") == F.col(f"p.{c}") for c in (*keys, *(f"_c{i}" for i in range(dims)))]
    on = same[0]
    for s in same[1:]:
        on = on & s
    d2 = squared_distance(dims)
    return one.join(two, on & ((d2 <= bound) if closed else (d2 < bound))).select(*(F.col(f"q.{k}") for k in keys), F.col("q.point_id").alias("q_id"), F.col("p.point_id").alias("p_id"), d2.alias("d2"))


def nearest_join(query: DataFrame, base: DataFrame, radius: int, keys: tuple[str, ...] = ("tile_id",), carry: str | None = None) -> DataFrame:
    """The nearest base point at less than radius of each query point (ties: the lowest id), with base's column `carry`; others have no row."""
    side = lambda df, q: df.select(*keys, "point_id", *(F.col(a).cast("long").alias(a) for a in AXES), *((F.lit(None).alias(c) if q else c) for c in [carry] if c), F.lit(q).alias("is_query"), F.lit(not q).alias("is_base"))
    return nearest_among(side(base, False).unionByName(side(query, True)), radius, keys, carry)


def nearest_among(rows: DataFrame, radius: int, keys: tuple[str, ...] = ("tile_id",), carry: str | None = None) -> DataFrame:
    """nearest_join of rows' query points (is_query) with its base points (is_base). Each row is dealt out once, with those of its keys; they are in one task."""
    more = [carry] if carry else []

    def run(table: pa.Table, first: np.ndarray) -> pa.Table:
        xyz, ids = groups.columns(table, list(AXES)), table.column("point_id").to_numpy()
        query, base = (table.column(n).to_numpy() for n in ("is_query", "is_base"))
        found = []
        for lo, hi in zip(first, [*first[1:], table.num_rows], strict=True):
            q, p = lo + np.flatnonzero(query[lo:hi]), lo + np.flatnonzero(base[lo:hi])
            p = p[np.argsort(ids[p], kind="stable")]
            i, j, d2 = kernels.nearest(xyz[q], xyz[p], radius)
            found.append((q[i], p[j], d2))
        i, j, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
        out = table.select(list(keys)).take(i).append_column("q_id", pa.array(ids[i])).append_column("p_id", pa.array(ids[j])).append_column("d2", pa.array(d2))
        return out.append_column(carry, table.column(carry).take(j)) if carry else out

    kinds = dict(rows.dtypes)
    schema = f"{groups.key_schema(rows, keys)}, q_id {kinds['point_id']}, p_id {kinds['point_id']}, d2 long" + "".join(f", {c} {kinds[c]}" for c in more)
    return groups.in_groups(rows.select(*keys, "point_id", *AXES, *more, "is_query", "is_base"), keys, run, schema)


def knn_join(query: DataFrame, base: DataFrame, k: int, cell: int, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """The k nearest base points of each query point, itself left out: (keys, q_id, p_id, d2, rank).

    Exact: a query is done once its k-th distance is within the cell size, as all closer points are then in
    the cells seen; the others go again with cells twice as large, until the cells span the cloud.
    """
    order = W.partitionBy(*keys, "q_id").orderBy("d2", "p_id")
    box = base.agg(*(F.max(a) - F.min(a) for a in AXES)).first()
    span = max([0, *(x for x in box if x is not None)]) + 1
    out, left = None, query
    while True:
        last = cell > span
        pairs = grid_join(left, base, cell, True, keys=keys, limit=(1 << 62) if last else cell * cell).where("q_id <> p_id")
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        done = ranked if last else ranked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "q_id"))).where(F.col("_n") == k).drop("_n")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        ids = done.select(*keys, F.col("q_id").alias("point_id")).distinct()
        left = left.join(ids, [*keys, "point_id"], "left_anti")
        if left.isEmpty():
            return out
        cell *= 2


def crossings(x: Column, y: Column, e: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses the edge e (x1, y1)-(x2, y2); exact in integers."""
    up = (e["y1"] > y) != (e["y2"] > y)
    dy = e["y2"] - e["y1"]
    side = (x - e["x1"]) * dy - (e["x2"] - e["x1"]) * (y - e["y1"])
    return up & F.when(dy > 0, side < 0).otherwise(side > 0)


def _beside(df: DataFrame, edges: DataFrame, distance: int, x: str, y: str, also: Callable[[Column], Column] | None = None) -> DataFrame:
    """df's rows inside the polygons, or of whose edges (an array) `also` holds; edges are looked at only for rows at most distance from their box."""
    box = edges.agg(F.min("x1").alias("_ax"), F.max("x1").alias("_bx"), F.min("y1").alias("_ay"), F.max("y1").alias("_by"), F.collect_list(F.struct("part", "x1", "y1", "x2", "y2")).alias("_e"))
    near = F.col(x).between(F.col("_ax") - distance, F.col("_bx") + distance) & F.col(y).between(F.col("_ay") - distance, F.col("_by") + distance)
    hit = F.filter("_e", lambda e: crossings(F.col(x), F.col(y), e))["part"]
    odd = F.exists(F.array_distinct(hit), lambda p: F.size(F.filter(hit, lambda o: o == p)) % 2 == 1)
    # Of an And either side may come first; a case keeps its order.
    return df.join(F.broadcast(box), F.when(near, also(F.col("_e")) | odd if also else odd).otherwise(False)).select(*df.columns)


def inside(df: DataFrame, edges: DataFrame, ids: list[str], x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """Rows of df in the union of the polygons (each part by even-odd rule). Edges are a small, broadcast table; rows are read once and stay where they are."""
    return _beside(df, edges, 0, x, y)


def edge_distance2(x: Column, y: Column, e: Column) -> Column:
    """Squared distance from (x, y) to the edge e."""
    dx, dy = (e["x2"] - e["x1"]).cast("double"), (e["y2"] - e["y1"]).cast("double")
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
    return ex * ex + ey * ey


def within_buffer(df: DataFrame, edges: DataFrame, distance: int, ids: list[str]) -> DataFrame:
    """Rows inside the polygons or at most distance (mm) from an edge; rows are read once and stay where they are."""
    return _beside(df, edges, distance, "x_mm", "y_mm", lambda es: F.exists(es, lambda e: edge_distance2(F.col("x_mm"), F.col("y_mm"), e) <= float(distance) ** 2))
