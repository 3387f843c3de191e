"""Crown solids, tree metrics and stem solids. Lengths are metres unless a name ends in _mm.

A crown solid is made of voxels: those that hold a point, and in each column all between the lowest and the highest. It is
closed and encloses every point. Metrics that are undefined are null, each by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest, groups
from .kernels import filled, lookup, member, packed, voxel_surface

#: The voxel edge of crown solids and of porosity, the cap on a crown's extent (m) and voxels, and the thinning of median_gap.
SOLID_MM, FINE_MM, MOST_SPAN, MOST_VOXELS, THIN_MM = 500, 250, 100.0, 20_000_000, 20


def crown_columns(points: DataFrame, keys: tuple[str, ...] = ("gtid",), size: int = SOLID_MM) -> DataFrame:
    """The solid's columns: (keys, i, j, low, high) in voxels, both ends within."""
    cell = [F.floor(F.col(f"{a}_mm") / size).alias(n) for a, n in zip("xyz", "ijk", strict=True)]
    return points.select(*keys, *cell).groupBy(*keys, "i", "j").agg(F.min("k").alias("low"), F.max("k").alias("high"))


def crown_solid(points: DataFrame, keys: tuple[str, ...] = ("gtid",), size: int = SOLID_MM) -> DataFrame:
    """The solid's voxels (keys, i, j, k)."""
    return crown_columns(points, keys, size).select(*keys, "i", "j", F.explode(F.sequence("low", "high")).alias("k"))


def porosity(points: DataFrame, keys: tuple[str, ...] = ("gtid",), size: int = SOLID_MM, fine: int = FINE_MM) -> DataFrame:
    """(keys, interior, occupied, porosity): fine voxels whose lower corner lies in the solid, those of them that hold a point, and one less
    their share, within 0 and 1. Null for crowns wider than MOST_SPAN or of more than MOST_VOXELS. size is a multiple of fine."""
    times = (size // fine) ** 3
    solid = crown_columns(points, keys, size).groupBy(*keys).agg((F.sum(F.col("high") - F.col("low") + 1) * times).alias("interior"))
    span = points.groupBy(*keys).agg(F.greatest(*(F.max(f"{a}_mm") - F.min(f"{a}_mm") for a in "xyz")).alias("span"))
    # A point's fine voxel lies in the voxel of the solid that holds the point, so all occupied voxels are interior.
    held = forest.voxels(points, fine, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("occupied"))
    out = solid.join(held, list(keys)).join(span, list(keys))
    fine_enough = (F.col("span") <= MOST_SPAN * 1000) & (F.col("interior") <= MOST_VOXELS)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("occupied") / F.col("interior")))
    return out.select(*keys, "interior", "occupied", F.when(fine_enough, share).alias("porosity"))


def near_candidates(low: np.ndarray, high: np.ndarray, points: np.ndarray, cell: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (cell, point), sorted by cell, those whose point may be the nearest to some place in its cell's box: it is no farther than
    the farthest corner is from the point for which that is least."""
    near, far = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
    for i in range(3):
        p = points[:, i][point]
        a, b = low[:, i][cell] - p, p - high[:, i][cell]
        side = np.maximum(np.maximum(a, b), 0)
        near += side * side
        side = np.maximum(-a, -b)
        far += side * side
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    keep = near <= np.repeat(np.minimum.reduceat(far, first), np.diff(first, append=len(cell)))
    return cell[keep], point[keep]


def lattice_gaps(voxels: np.ndarray, points: np.ndarray, size: int, step: int, most: int = 100_000) -> Iterator[np.ndarray]:
    """Squared distances (mm2) from each voxel's places, size // step along each edge, to the nearest point: exact, some voxels at a time.
    From large cells down to voxels each passes the points that may be nearest on to those in it, about `most` pairs at once."""
    # From the lowest corner on, cells of all levels are counted from 0.
    voxels, points = voxels - voxels.min(0), points - voxels.min(0) * size
    level, cells = 0, [voxels]
    while len(cells[level]) > 1 and len(cells[level]) * len(points) > most:
        cells.append(np.unique(cells[level] // 2, axis=0))
        level += 1
    box = lambda c, k: (c * (size << k), (c + 1) * (size << k) - step)
    # Narrow numbers where no square in sight is too large for them.
    reach = max(int(voxels.max() + 1) * size, int(points.max())) - min(0, int(points.min()))
    kind = np.int32 if 3 * reach * reach < 1 << 31 else np.int64
    side = np.arange(0, size, step, dtype=kind)
    places = points.T.astype(kind)

    def down(mine: np.ndarray, k: int, counts: np.ndarray, point: np.ndarray) -> Iterator[np.ndarray]:
        # mine: cells of level k, each with its own run of counts points.
        cell, point = near_candidates(*box(mine, k), points, np.repeat(np.arange(len(mine)), counts), point)
        counts = np.bincount(cell, minlength=len(mine))
        first = np.cumsum(counts) - counts
        if k:
            inner = np.unique(np.concatenate([mine[:, None] * 2 + np.array(list(np.ndindex(2, 2, 2)))]).reshape(-1, 3), axis=0)
            inner = inner[member(inner, cells[k - 1])]
            above = lookup(inner // 2, mine)
            yield from parts(inner, k - 1, counts[above], first[above], point)
            return
        for lo, hi in runs(counts, max(most // len(side) ** 3, 1)):
            at = slice(first[lo], first[hi - 1] + counts[hi - 1])
            x, y, z = ((places[i][point[at], None] - (mine[:, i] * size).astype(kind)[cell[at], None] - side) ** 2 for i in range(3))
            xy = (x[:, :, None] + y[:, None, :]).reshape(len(x), -1)
            d2 = (xy[:, :, None] + z[:, None, :]).reshape(len(x), -1)
            yield np.minimum.reduceat(d2, first[lo:hi] - first[lo]).ravel()

    def parts(mine, k, counts, first, point):
        for lo, hi in runs(counts, most):
            n = counts[lo:hi]
            yield from down(mine[lo:hi], k, n, point[np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    top = cells[level]
    yield from parts(top, level, np.full(len(top), len(points)), np.zeros(len(top), np.int64), np.arange(len(points)))


def runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of counts that add up to `most`, or hold one."""
    total, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield lo, hi
        lo = hi


def median_gap(xyz: np.ndarray, order: np.ndarray, size: int = SOLID_MM, step: int = 100, thin: int = THIN_MM) -> float:
    """r50 in metres: the median distance from all of the solid's step-voxels (lower corners) to the nearest point; with `thin`, points are
    thinned to the first by `order` of each thin-voxel. size is a multiple of step."""
    if not len(xyz):
        return math.nan
    p = xyz.astype(np.int64)
    if thin:
        p = p[np.argsort(order, kind="stable")]
        p = p[np.sort(np.unique(p // thin, axis=0, return_index=True)[1])]
    voxels = filled(np.zeros(len(xyz), np.int64), xyz // size)[1]
    # Distances are kept as values and how often each occurs, so that memory goes with their range.
    value, often, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def counted():
        v, at = np.unique(np.concatenate((value, *held)), return_inverse=True)
        return v, np.bincount(at, np.concatenate((often, np.ones(len(at) - len(value), np.int64))), len(v)).astype(np.int64)

    for d2 in lattice_gaps(voxels, p, size, step):
        held.append(d2)
        if sum(map(len, held)) > 4_000_000:
            (value, often), held = counted(), []
    if not len(value):
        return float(np.median(np.sqrt(np.concatenate(held)))) / 1000
    value, often = counted()
    total = np.cumsum(often)
    middle = value[np.searchsorted(total, [(total[-1] - 1) // 2, total[-1] // 2], "right")]
    return float(np.mean(np.sqrt(middle))) / 1000


def r50(points: DataFrame, keys: tuple[str, ...] = ("gtid",), size: int = SOLID_MM, step: int = 100, thin: int = 0) -> DataFrame:
    """(keys, r50) of each tree, over all places of its solid and all its points; a tree is worked on in one task, as many points as it has."""
    names = ["x_mm", "y_mm", "z_mm"]

    def trees(table: pa.Table, first: np.ndarray) -> pa.Table:
        xyz, order = groups.columns(table, names), table.column("point_id").to_numpy()
        gaps = [median_gap(p, o, size, step, thin) for p, o in zip(np.split(xyz, first[1:]), np.split(order, first[1:]), strict=True)]
        return table.select(list(keys)).take(first).append_column("r50", pa.array(gaps, pa.float64()))

    return groups.in_groups(points.select(*keys, "point_id", *names), keys, trees, groups.key_schema(points, keys) + ", r50 double")


def crowns(points: DataFrame, keys: tuple[str, ...] = ("tile_id", "gtid"), with_r50: bool = True, size: int = SOLID_MM, fine: int = FINE_MM) -> DataFrame:
    """(keys, ring, area_m2, cx, cy, median_z in mm, porosity, r50) of each tree, as hulls, porosity and r50 have them, from one reading of the points."""
    names = ["x_mm", "y_mm", "z_mm"]

    def full(xyz: np.ndarray) -> float | None:
        interior = len(filled(np.zeros(len(xyz), np.int64), xyz // size)[1]) * (size // fine) ** 3
        if np.ptp(xyz, axis=0).max() > MOST_SPAN * 1000 or interior > MOST_VOXELS:
            return None
        return max(0.0, min(1.0, 1 - len(np.unique(packed(xyz // fine)[0])) / interior))

    def trees(table: pa.Table, first: np.ndarray) -> pa.Table:
        each = np.split(groups.columns(table, names), first[1:])
        ids = np.split(table.column("point_id").to_numpy(), first[1:])
        out = forest.outlined(table.select(list(keys)).take(first), [forest.outline(p[:, :2]) for p in each])
        gaps = [median_gap(p, o, thin=0) if with_r50 else None for p, o in zip(each, ids, strict=True)]
        for name, values in (("median_z", [float(np.median(p[:, 2])) for p in each]), ("porosity", [full(p) for p in each]), ("r50", gaps)):
            out = out.append_column(name, pa.array(values, pa.float64()))
        return out

    schema = f"{groups.key_schema(points, keys)}, {forest.OUTLINE}, median_z double, porosity double, r50 double"
    return groups.in_groups(points.select(*keys, "point_id", *names), keys, trees, schema)


def bundle(points: DataFrame, dtm: DataFrame, with_r50: bool = True) -> DataFrame:
    """One row per tree (tile_id, gtid) in canonical order: crown width, median height, r50, porosity, stem height, diameter, radius, base.
    What cannot be worked out is null and leaves the others as they are."""
    out = forest.with_trunk_base(crowns(points, with_r50=with_r50), dtm)
    out = out.select("tile_id", "gtid", (F.col("median_z") / 1000).alias("crown_median_z"), forest.crown_width(F.col("area_m2")).alias("crown_width_m"), F.col("porosity").alias("crown_porosity"), F.col("r50").alias("crown_r50_m"), (F.col("base_z_mm") / 1000.0).alias("trunk_base_height_m"))
    h, dbh, radius = forest.allometry(F.col("crown_width_m"), F.col("crown_median_z"), F.col("trunk_base_height_m"))
    return normalized(out.withColumns({"trunk_H_m": h, "trunk_DBH_m": dbh, "trunk_radius_m": radius}))


#: The attributes of a tree in their order.
ATTRIBUTES = ["crown_width_m", "crown_median_z", "crown_r50_m", "crown_porosity", "trunk_H_m", "trunk_DBH_m", "trunk_radius_m", "trunk_base_height_m"]


def normalized(metrics: DataFrame) -> DataFrame:
    """gtid, tile_id and the attributes in their order; NaN and infinite values are null, as are attributes that are not there."""
    have = set(metrics.columns)
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return metrics.select("gtid", "tile_id", *((clean(c) if c in have else F.lit(None).cast("double")).alias(c) for c in ATTRIBUTES))


def localized(points: DataFrame, keys: tuple[str, ...] = ("gtid",)) -> DataFrame:
    """points with x, y, z in metres from the tree's mean, and the mean (ox, oy, oz): what is added back for global coordinates."""
    mean = points.groupBy(*keys).agg(*((F.avg(f"{a}_mm") / 1000).alias(f"o{a}") for a in "xyz"))
    return points.join(mean, list(keys)).withColumns({a: F.col(f"{a}_mm") / 1000.0 - F.col(f"o{a}") for a in "xyz"})


def suspicious(x: Column, y: Column, z: Column, limit: float = 5000.0) -> Column:
    """Whether a local coordinate is implausibly far from the tree's mean (m)."""
    return F.greatest(F.abs(x), F.abs(y), F.abs(z)) > limit


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stem(base: tuple[Column, Column, Column], top: tuple[Column, Column, Column], radius: Column, sections: int = 24) -> Column:
    """Faces (structs a, b, c of x, y, z) of a closed cylinder from base to top, outward; null without a positive radius and length."""
    struct = lambda **values: F.struct(*(v.alias(n) for n, v in values.items()))
    place = lambda v: struct(**dict(zip("xyz", v, strict=True)))
    parts = lambda s: [s[a] for a in "xyz"]
    span = lambda v: F.sqrt(sum((a * a for a in v[1:]), v[0] * v[0]))
    steps = F.sequence(F.lit(0), F.lit(sections - 1))

    def directions(e):
        axis = [t - b for b, t in zip(parts(e["low"]), parts(e["high"]), strict=True)]
        return _bound(struct(axis=place(axis), length=span(axis)), lambda w: place([a / w["length"] for a in parts(w["axis"])]))

    def across(d):
        # Two directions across the axis: the first across it and x, or y where the axis runs along x.
        d = parts(d)
        along_x = F.abs(d[0]) > 0.9
        u = [F.when(along_x, -d[2]).otherwise(F.lit(0.0)), F.when(along_x, F.lit(0.0)).otherwise(d[2]), F.when(along_x, d[0]).otherwise(-d[1])]
        return _bound(struct(u=place(u), n=F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])), lambda w: place([c / w["n"] for c in parts(w["u"])]))

    def third(d, u):
        d, u = parts(d), parts(u)
        return place([d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0]])

    def faces(e, u, v):
        def ring(end):
            angle = lambda i: i * F.lit(2 * math.pi / sections)
            return F.transform(steps, lambda i: place([c + e["r"] * (F.cos(angle(i)) * p + F.sin(angle(i)) * q) for c, p, q in zip(parts(e[end]), parts(u), parts(v), strict=True)]))

        def sides(w, i):
            low, low_next, high, high_next = w["low"][i], w["low"][(i + 1) % sections], w["high"][i], w["high"][(i + 1) % sections]
            face = lambda a, b, c: struct(a=a, b=b, c=c)
            return F.array(face(low, low_next, high_next), face(low, high_next, high), face(e["low"], low_next, low), face(e["high"], high, high_next))

        return _bound(struct(low=ring("low"), high=ring("high")), lambda w: F.flatten(F.transform(steps, lambda i: sides(w, i))))

    double = lambda v: [c.cast("double") for c in v]
    ends = struct(low=place(double(base)), high=place(double(top)), r=radius.cast("double"))
    mesh = _bound(ends, lambda e: _bound(directions(e), lambda d: _bound(across(d), lambda u: _bound(third(d, u), lambda v: faces(e, u, v)))))
    return F.when((radius > 0) & (span([t - b for b, t in zip(base, top, strict=True)]) > 0), mesh)


def stems(metrics: DataFrame, places: DataFrame) -> DataFrame:
    """(tile_id, gtid, faces in mm) of the stem of each tree whose base and radius are known, or null: from the base at places(tile_id, gtid, cx, cy in
    mm) to the crown's median height."""
    rows = metrics.join(places, ["tile_id", "gtid"]).where("trunk_base_height_m is not null and trunk_radius_m is not null")
    low = F.col("cx"), F.col("cy"), F.col("trunk_base_height_m") * 1000
    faces = stem(low, (F.col("cx"), F.col("cy"), F.col("crown_median_z") * 1000), F.col("trunk_radius_m") * 1000)
    return rows.select("tile_id", "gtid", faces.alias("faces"))


def solids(points: DataFrame, metrics: DataFrame, places: DataFrame) -> DataFrame:
    """Faces (tile_id, gtid, role, a, b, c in whole mm) of each tree's crown and stem (see stems). A tree without any solid has no row."""
    keys = ("tile_id", "gtid")
    voxel = forest.voxel_faces(crown_solid(points, keys), keys)
    scaled = lambda c: F.struct(*((F.col(f"{c}.{a}") * SOLID_MM).cast("long").alias(a) for a in "xyz")).alias(c)
    crown = voxel.select(*keys, F.lit("crown").alias("role"), *(scaled(c) for c in "abc"))
    whole = lambda c: F.struct(*(F.bround(F.col(f"f.{c}.{a}")).cast("long").alias(a) for a in "xyz")).alias(c)
    trunk = stems(metrics, places).select(*keys, F.explode("faces").alias("f")).select(*keys, F.lit("trunk").alias("role"), *(whole(c) for c in "abc"))
    return crown.unionByName(trunk)


def solid_checks(points: DataFrame, metrics: DataFrame, places: DataFrame) -> DataFrame:
    """open_edges of all solids, (tile_id, gtid, role) each, made where the points or the stem's row are: no face is shuffled."""
    keys = ("tile_id", "gtid")

    def crown(table: pa.Table, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of, corners = voxel_surface(*filled(solid, groups.columns(table, ["i", "j", "k"])))
        return of, corners * SOLID_MM

    def trunk(table: pa.Table, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("flat").combine_chunks()
        return np.repeat(solid, flat.value_lengths().to_numpy() // 9), flat.flatten().to_numpy().reshape(-1, 3, 3)

    whole = F.transform("faces", lambda f: F.array(*(F.bround(f[c][a]).cast("long") for c in "abc" for a in "xyz")))
    flat = stems(metrics, places).where("faces is not null").select(*keys, F.flatten(whole).alias("flat"))
    parts = [("crown", forest.checked(forest.voxel_of(points, SOLID_MM, keys), keys, crown)), ("trunk", forest.checked(flat, keys, trunk, single=True))]
    crown_rows, trunk_rows = (rows.select(*keys, F.lit(role).alias("role"), *forest.CHECKS) for role, rows in parts)
    return crown_rows.unionByName(trunk_rows)
