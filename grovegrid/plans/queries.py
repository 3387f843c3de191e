"""The engine's queries on the test point cloud and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.points import AOI_SQL, aoi, points, with_points
from ..operators import cityjson, forest, ground, metrics, spatial, vegetation
from ..sources import tables, tiles
from ..streaming.ingest import pending

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_points(sql)
        return f

    return add


def _trees(spark: SparkSession, d: str) -> DataFrame:
    """Each vegetation column of the cloud as a tree: tid and gtid are its number."""
    return points(spark, d).withColumns({"tid": F.col("src_id"), "gtid": F.col("src_id")})


@query("SELECT tile_id, count(*) AS n, sum(x_mm)::BIGINT AS sx, sum(y_mm)::BIGINT AS sy, sum(z_mm)::BIGINT AS sz, sum(classification)::BIGINT AS sc, sum(x_mm * (point_id % 97))::BIGINT AS sxp FROM points GROUP BY tile_id")
def points_view(spark, d):
    s = lambda c, n: F.sum(c).alias(n)
    return points(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), s("x_mm", "sx"), s("y_mm", "sy"), s("z_mm", "sz"), s("classification", "sc"), s(F.col("x_mm") * (F.col("point_id") % 97), "sxp"))


_BRANCH = "CASE WHEN return_number < number_of_returns THEN CASE WHEN number_of_returns = 3 AND return_number <= 2 THEN 'B' WHEN number_of_returns >= 4 AND return_number <= 3 THEN 'C' END END"


@query(f"SELECT tile_id, coalesce({_BRANCH}, '-') AS branch, count(*) AS n, count(*) FILTER (return_number < number_of_returns) AS n_early FROM points GROUP BY ALL")
def echo_mask_counts(spark, d):
    rows = vegetation.echo_branch(points(spark, d)).withColumn("branch", F.coalesce("branch", F.lit("-")))
    return rows.groupBy("tile_id", "branch").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("return_number") < F.col("number_of_returns")).cast("long")).alias("n_early"))


@query("SELECT tile_id, min(x_mm) AS x0, max(x_mm) AS x1, min(y_mm) AS y0, max(y_mm) AS y1, min(z_mm) AS z0, max(z_mm) AS z1 FROM points GROUP BY tile_id")
def tile_bbox(spark, d):
    return points(spark, d).groupBy("tile_id").agg(*(f(f"{a}_mm").alias(f"{a}{n}") for a in "xyz" for n, f in ((0, F.min), (1, F.max))))


@query("SELECT printf('%06d_%06d', x, y) AS tile_id, x AS minx, y AS miny, x + 1000 AS maxx, y + 1000 AS maxy FROM generate_series(85000, 87100, 1000) a(x), generate_series(446000, 448050, 1000) b(y)")
def grid_tiles(spark, d):
    return tiles.grid_tiles(spark, 85250.5, 446900.0, 87100.0, 448050.0)


@query("SELECT 'https://tiles.example.org/laz/' || tile_id || '.laz' AS url, tile_id FROM (SELECT DISTINCT tile_id FROM points)")
def tile_addresses(spark, d):
    return points(spark, d).select("tile_id").distinct().withColumn("url", tiles.address("https://tiles.example.org/laz/{tile}.laz", F.col("tile_id")))


_INSIDE = f"""odd AS (
  SELECT p.point_id, part, sum(CASE WHEN (y1 > y_mm) <> (y2 > y_mm) AND x_mm < x1 + (x2 - x1) * (y_mm - y1) / (y2 - y1)::DOUBLE THEN 1 ELSE 0 END) AS n
  FROM points p, {AOI_SQL} GROUP BY ALL),
ins AS (SELECT DISTINCT point_id FROM odd WHERE n % 2 = 1)"""


@query(f"WITH {_INSIDE} SELECT p.* FROM points p SEMI JOIN ins USING (point_id)")
def aoi_crop(spark, d):
    return spatial.inside(points(spark, d), aoi(spark), ["tile_id", "point_id"])


@query(f"""WITH {_INSIDE}, e AS (
  SELECT point_id, x_mm, y_mm, x1, y1, (x2 - x1)::DOUBLE AS dx, (y2 - y1)::DOUBLE AS dy FROM points, {AOI_SQL}),
t AS (SELECT *, greatest(0.0, least(1.0, ((x_mm - x1) * dx + (y_mm - y1) * dy) / (dx * dx + dy * dy))) AS t FROM e),
n AS (SELECT DISTINCT point_id FROM t WHERE (x_mm - (x1 + t * dx)) ** 2 + (y_mm - (y1 + t * dy)) ** 2 <= 2000.0 ** 2 UNION SELECT point_id FROM ins)
SELECT tile_id, count(*) AS n, sum(x_mm)::BIGINT AS sx FROM points SEMI JOIN n USING (point_id) GROUP BY tile_id""")
def aoi_buffer_select(spark, d):
    near = spatial.within_buffer(points(spark, d), aoi(spark), 2000, ["tile_id", "point_id"])
    return near.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x_mm").alias("sx"))


def _pairs_sql(limit: str) -> str:
    cells = "floor(x_mm / 1600.0)::BIGINT AS cx, floor(y_mm / 1600.0)::BIGINT AS cy, floor(z_mm / 1600.0)::BIGINT AS cz"
    return f"""WITH c AS (SELECT tile_id, point_id, x_mm, y_mm, z_mm, {cells} FROM points),
o AS (SELECT c.*, cx + i AS nx, cy + j AS ny, cz + k AS nz FROM c, generate_series(-1, 1) a(i), generate_series(-1, 1) b(j), generate_series(-1, 1) d(k)),
p AS (SELECT q.tile_id, q.point_id, (q.x_mm - p.x_mm) ** 2 + (q.y_mm - p.y_mm) ** 2 + (q.z_mm - p.z_mm) ** 2 AS d2
  FROM o q JOIN c p ON q.tile_id = p.tile_id AND nx = p.cx AND ny = p.cy AND nz = p.cz WHERE q.point_id <> p.point_id)
SELECT tile_id, count(*) AS n_pairs, sum(d2)::BIGINT AS sum_d2, count(DISTINCT point_id) AS n_points FROM p WHERE {limit} GROUP BY tile_id"""


@query(_pairs_sql("d2 <= 750 * 750"))
def radius_pairs(spark, d):
    return vegetation.radius_pairs(points(spark, d), 750, True)


@query(_pairs_sql("d2 < 2500000"))
def radius_pairs_open_sqrt(spark, d):
    return vegetation.radius_pairs(points(spark, d), 1582, False, 2_500_000)


_SOR = f"""br AS (SELECT *, {_BRANCH} AS branch FROM points WHERE {_BRANCH} IS NOT NULL),
nn AS (
  SELECT q.tile_id, q.branch, q.point_id, min((q.x_mm - p.x_mm) ** 2 + (q.y_mm - p.y_mm) ** 2 + (q.z_mm - p.z_mm) ** 2, CASE q.branch WHEN 'B' THEN 50 ELSE 32 END) AS near
  FROM br q JOIN br p ON q.tile_id = p.tile_id AND q.branch = p.branch AND q.point_id <> p.point_id GROUP BY ALL),
md AS (SELECT br.tile_id, br.branch, br.point_id, list_sum(list_transform(near, lambda v: sqrt(v))) / len(near) / 1000 AS m FROM br LEFT JOIN nn USING (tile_id, branch, point_id)),
st AS (SELECT tile_id, branch, avg(m) AS mu, coalesce(stddev_samp(m), 0) AS sd FROM md GROUP BY ALL),
sor AS (SELECT md.tile_id, point_id, md.branch, m, coalesce(m <= mu + CASE md.branch WHEN 'B' THEN 0.9 ELSE 1.0 END * sd, true) AS keep FROM md JOIN st USING (tile_id, branch))"""


def _components_sql(source: str, radius: int) -> str:
    """Components of the closed radius graph within tiles: cells, edges, and minima passed on until none changes."""
    cell = ", ".join(f"floor({a}_mm / {radius}.0)::BIGINT AS c{a}" for a in "xyz")
    return f"""cv AS (SELECT tile_id, point_id, x_mm, y_mm, z_mm, {cell} FROM {source}),
co AS (SELECT cv.*, cx + i AS nx, cy + j AS ny, cz + k AS nz FROM cv, generate_series(-1, 1) a(i), generate_series(-1, 1) b(j), generate_series(-1, 1) c(k)),
ce AS (SELECT q.point_id AS a, p.point_id AS b FROM co q JOIN cv p ON q.tile_id = p.tile_id AND nx = p.cx AND ny = p.cy AND nz = p.cz
  WHERE q.point_id <> p.point_id AND (q.x_mm - p.x_mm) ** 2 + (q.y_mm - p.y_mm) ** 2 + (q.z_mm - p.z_mm) ** 2 <= {radius} ** 2),
cc(node, label) USING KEY (node) AS (
  SELECT point_id, point_id FROM cv
  UNION SELECT ce.b, min(cc.label) FROM cc JOIN ce ON ce.a = cc.node JOIN recurring.cc r ON r.node = ce.b WHERE cc.label < r.label GROUP BY ce.b),
cs AS (SELECT cv.tile_id, point_id, label AS component, count(*) OVER (PARTITION BY cv.tile_id, label) AS size FROM cc JOIN cv ON point_id = node)"""


@query(f"WITH {_SOR} SELECT tile_id, point_id, branch, round(m, 6) AS mean_distance, keep FROM sor")
def sor_keep(spark, d):
    p = vegetation.echo_branch(points(spark, d)).select("tile_id", "point_id", "x_mm", "y_mm", "z_mm", "branch")
    return vegetation.sor_branches(p, vegetation.BRANCHES).select("tile_id", "point_id", "branch", F.round("mean_distance", 6).alias("mean_distance"), "keep")


@query(f"WITH RECURSIVE br AS (SELECT * FROM points WHERE {_BRANCH} IS NOT NULL), {_components_sql('br', 750)} SELECT tile_id, point_id, component, size FROM cs")
def min_cluster_keep(spark, d):
    p = vegetation.echo_branch(points(spark, d)).where("branch is not null")
    return vegetation.component_sizes(p)


_CORE = f"core AS (SELECT * FROM points WHERE {_BRANCH} = 'C'), rest AS (SELECT * FROM points WHERE return_number < number_of_returns AND point_id NOT IN (SELECT point_id FROM core))"
_DIL = """occ AS (SELECT DISTINCT tile_id, floor(x_mm / 250.0)::BIGINT AS ix, floor(y_mm / 250.0)::BIGINT AS iy FROM core),
dil AS (SELECT DISTINCT tile_id, ix + i AS ix, iy + j AS iy FROM occ, generate_series(-2, 2) a(i), generate_series(-2, 2) b(j) WHERE i * i + j * j <= 5)"""


def _core_c(spark, d):
    return vegetation.echo_branch(points(spark, d)).where("branch = 'C'").drop("branch")


@query(f"WITH {_CORE}, {_DIL} SELECT tile_id, ix, iy FROM dil")
def occupancy_dilate(spark, d):
    return vegetation.dilate(vegetation.cell_of(_core_c(spark, d)))


@query(f"WITH {_CORE}, {_DIL} SELECT r.* FROM rest r SEMI JOIN dil ON dil.tile_id = r.tile_id AND dil.ix = floor(r.x_mm / 250.0)::BIGINT AND dil.iy = floor(r.y_mm / 250.0)::BIGINT")
def dilated_candidates(spark, d):
    return vegetation.candidates_of(points(spark, d), f"return_number < number_of_returns and {vegetation.BRANCHES['C'][0]}")


_NEAR = """k AS (SELECT core.*, floor(x_mm / 600.0)::BIGINT AS cx, floor(y_mm / 600.0)::BIGINT AS cy, floor(z_mm / 600.0)::BIGINT AS cz FROM core),
o AS (SELECT q.*, floor(x_mm / 600.0)::BIGINT + i AS nx, floor(y_mm / 600.0)::BIGINT + j AS ny, floor(z_mm / 600.0)::BIGINT + k AS nz FROM rest q, generate_series(-1, 1) a(i), generate_series(-1, 1) b(j), generate_series(-1, 1) d(k)),
m AS (SELECT o.tile_id, o.point_id AS q_id, k.point_id AS p_id, ((o.x_mm - k.x_mm) ** 2 + (o.y_mm - k.y_mm) ** 2 + (o.z_mm - k.z_mm) ** 2)::BIGINT AS d2
  FROM o JOIN k ON o.tile_id = k.tile_id AND nx = cx AND ny = cy AND nz = cz)"""


@query(f"WITH {_CORE}, {_NEAR} SELECT tile_id, q_id, arg_min(p_id, (d2, p_id)) AS p_id, min(d2) AS d2 FROM m WHERE d2 < 360000 GROUP BY tile_id, q_id")
def bounded_nearest(spark, d):
    early = vegetation.echo_branch(points(spark, d)).where("return_number < number_of_returns")
    core = F.coalesce(F.col("branch") == "C", F.lit(False))
    return spatial.nearest_among(early.withColumns({"is_base": core, "is_query": ~core}), 600)


@query(f"""WITH RECURSIVE {_SOR}, kept AS (SELECT points.* FROM points SEMI JOIN (SELECT * FROM sor WHERE keep) USING (point_id)), {_components_sql('kept', 750)},
core AS (SELECT kept.* FROM kept SEMI JOIN (SELECT * FROM cs WHERE size >= 30) USING (point_id)),
early AS (SELECT * FROM points WHERE return_number < number_of_returns AND point_id NOT IN (SELECT point_id FROM core)), {_DIL},
rest AS (SELECT r.* FROM early r SEMI JOIN dil ON dil.tile_id = r.tile_id AND dil.ix = floor(r.x_mm / 250.0)::BIGINT AND dil.iy = floor(r.y_mm / 250.0)::BIGINT), {_NEAR},
best AS (SELECT q_id, arg_min(p_id, (d2, p_id)) AS p_id FROM m WHERE d2 < 360000 GROUP BY q_id)
SELECT * FROM core UNION ALL SELECT rest.* FROM rest JOIN best ON q_id = rest.point_id JOIN core ON core.point_id = p_id WHERE rest.z_mm - core.z_mm BETWEEN -1200 AND 2500""")
def vegetation_final(spark, d):
    return vegetation.vegetation(points(spark, d))


@query("SELECT tile_id, point_id, ((max(z_mm) OVER (PARTITION BY tile_id) - z_mm) // 1500)::BIGINT AS slab FROM points")
def slab_assign(spark, d):
    top = F.max("z_mm").over(W.partitionBy("tile_id"))
    return points(spark, d).select("tile_id", "point_id", F.floor((top - F.col("z_mm")) / 1500).alias("slab"))


@query()
def tree_segmentation(spark, d):
    return forest.segment(points(spark, d))


@query()
def tree_hull(spark, d):
    return forest.hulls(_trees(spark, d)).select("tile_id", "tid", F.to_json("ring").alias("ring"), "area_m2", "cx", "cy")


@query()
def tree_centroid_in_aoi(spark, d):
    h = forest.hulls(_trees(spark, d)).select("tile_id", "tid", F.bround("cx").cast("long").alias("x_mm"), F.bround("cy").cast("long").alias("y_mm"))
    return spatial.inside(h, aoi(spark), ["tile_id", "tid"])


@query("SELECT tile_id, src_id AS tid, row_number() OVER (ORDER BY tile_id, src_id) AS gtid FROM (SELECT DISTINCT tile_id, src_id FROM points)")
def gtid_map(spark, d):
    return forest.number_trees(_trees(spark, d))


@query("WITH g AS (SELECT tile_id, src_id, row_number() OVER (ORDER BY tile_id, src_id) AS gtid FROM (SELECT DISTINCT tile_id, src_id FROM points)) SELECT p.tile_id, p.point_id, x_mm, y_mm, z_mm, gtid FROM points p JOIN g USING (tile_id, src_id)")
def forest_join(spark, d):
    t = _trees(spark, d).drop("gtid")
    return t.join(forest.number_trees(t), ["tile_id", "tid"]).select("tile_id", "point_id", "x_mm", "y_mm", "z_mm", "gtid")


@query("WITH a AS (SELECT point_id, x_mm, y_mm, z_mm FROM points UNION ALL SELECT -point_id, x_mm, y_mm, z_mm FROM points WHERE point_id % 50 = 0) SELECT a.point_id AS a_id, b.point_id AS b_id FROM a JOIN points b USING (x_mm, y_mm, z_mm)")
def xyz_join(spark, d):
    p = points(spark, d).select("point_id", "x_mm", "y_mm", "z_mm")
    twice = p.unionByName(p.where("point_id % 50 = 0").withColumn("point_id", -F.col("point_id")))
    return twice.withColumnRenamed("point_id", "a_id").join(p.withColumnRenamed("point_id", "b_id"), ["x_mm", "y_mm", "z_mm"]).select("a_id", "b_id")


_DTM = "dtm AS (SELECT tile_id, floor(y_mm / 500.0)::BIGINT AS row, floor(x_mm / 500.0)::BIGINT AS col, min(z_mm) AS z_mm FROM points WHERE classification = 2 GROUP BY ALL)"


@query(f"WITH {_DTM} SELECT * FROM dtm")
def dtm_min_raster(spark, d):
    return forest.min_raster(points(spark, d))


@query("""WITH s AS (SELECT tile_id, floor(y_mm / 500.0)::BIGINT + i AS row, floor(x_mm / 500.0)::BIGINT + j AS col, x_mm, y_mm, z_mm FROM points, generate_series(-2, 2) a(i), generate_series(-2, 2) b(j) WHERE classification = 2)
SELECT tile_id, row, col, min(z_mm) AS z_mm FROM s WHERE (2 * x_mm - (2 * col + 1) * 500) ** 2 + (2 * y_mm - (2 * row + 1) * 500) ** 2 <= 2000000 GROUP BY ALL""")
def dtm_min_raster_spread(spark, d):
    return forest.min_raster(points(spark, d), spread=True)


def _centres(spark, d):
    return _trees(spark, d).groupBy("tile_id", "gtid").agg(F.avg("x_mm").alias("cx"), F.avg("y_mm").alias("cy"))


@query(f"""WITH {_DTM}, t AS (SELECT tile_id, src_id AS gtid, avg(x_mm) AS cx, avg(y_mm) AS cy FROM points GROUP BY ALL),
m AS (SELECT t.tile_id, gtid, row, col, z_mm, (cx - (col * 2 + 1) * 250.0) ** 2 + (cy - (row * 2 + 1) * 250.0) ** 2 AS d2 FROM t JOIN dtm ON t.tile_id = dtm.tile_id)
SELECT tile_id, gtid, arg_min(row, (d2, row, col)) AS row, arg_min(col, (d2, row, col)) AS col, arg_min(z_mm, (d2, row, col)) AS base_z_mm FROM m WHERE d2 <= 4000000 GROUP BY tile_id, gtid""")
def trunk_base(spark, d):
    return forest.trunk_base(_centres(spark, d), forest.min_raster(points(spark, d)))


@query()
def trunk_base_hull(spark, d):
    t = _trees(spark, d)
    crowns = forest.hulls(t, ("tile_id", "gtid"), every=True).drop("area_m2")
    return forest.with_trunk_base(crowns, forest.min_raster(points(spark, d)))


@query("""WITH t AS (SELECT src_id AS gtid, median(z_mm) / 1000 AS mz, min(z_mm) / 1000.0 AS bz, 2 * sqrt((max(x_mm) - min(x_mm)) / 1000.0 * ((max(y_mm) - min(y_mm)) / 1000.0) / pi()) AS cw FROM points GROUP BY src_id)
SELECT gtid, round(mz, 6) AS median_z, round(mz - bz, 6) AS h, CASE WHEN mz > bz THEN round(cw ** 1.1 * (mz - bz) ** 0.7 / 100, 6) END AS dbh, CASE WHEN mz > bz THEN round(cw ** 1.1 * (mz - bz) ** 0.7 / 200, 6) END AS radius FROM t""")
def allometry(spark, d):
    t = _trees(spark, d).groupBy("gtid").agg((F.median("z_mm") / 1000).alias("mz"), (F.min("z_mm") / 1000.0).alias("bz"), *(((F.max(f"{a}_mm") - F.min(f"{a}_mm")) / 1000.0).alias(a) for a in "xy"))
    cw = 2 * F.sqrt(F.col("x") * F.col("y") / F.pi())
    h, dbh, radius = forest.allometry(cw, F.col("mz"), F.col("bz"))
    return t.select("gtid", F.round("mz", 6).alias("median_z"), F.round(h, 6).alias("h"), F.round(dbh, 6).alias("dbh"), F.round(radius, 6).alias("radius"))


@query()
def allometry_hull(spark, d):
    t = _trees(spark, d)
    z = t.groupBy("gtid").agg((F.median("z_mm") / 1000).alias("mz"), (F.min("z_mm") / 1000.0).alias("bz"))
    t = z.join(forest.hulls(t, ("gtid",)).select("gtid", "area_m2"), "gtid", "left")
    h, dbh, radius = forest.allometry(forest.crown_width(F.col("area_m2")), F.col("mz"), F.col("bz"))
    return t.select("gtid", F.round("mz", 6).alias("median_z"), F.round(h, 6).alias("h"), F.round(dbh, 6).alias("dbh"), F.round(radius, 6).alias("radius"))


@query("""WITH v AS (SELECT src_id AS gtid, floor(x_mm / 100.0)::BIGINT AS i, floor(y_mm / 100.0)::BIGINT AS j, floor(z_mm / 100.0)::BIGINT AS k, min(point_id) AS point_id FROM points GROUP BY ALL) SELECT * FROM v""")
def voxel_downsample(spark, d):
    v = _trees(spark, d).groupBy("gtid", *(F.floor(F.col(f"{a}_mm") / 100).alias(n) for a, n in zip("xyz", "ijk", strict=True)))
    return v.agg(F.min("point_id").alias("point_id"))


@query("""WITH b AS (SELECT src_id AS gtid, sqrt(((max(x_mm) - min(x_mm)) / 1000.0) ** 2 + ((max(y_mm) - min(y_mm)) / 1000.0) ** 2 + ((max(z_mm) - min(z_mm)) / 1000.0) ** 2) AS diag FROM points GROUP BY 1)
SELECT gtid, round(diag / 15, 9) AS alpha, round(diag / 15 / 50, 9) AS offset_ FROM b""")
def alpha_params(spark, d):
    b = _trees(spark, d).groupBy("gtid").agg(*((F.max(f"{a}_mm") - F.min(f"{a}_mm")).alias(a) for a in "xyz"))
    diag = F.sqrt(sum((F.pow(F.col(a) / 1000.0, F.lit(2.0)) for a in "xyz"), F.lit(0.0)))
    return b.select("gtid", F.round(diag / 15, 9).alias("alpha"), F.round(diag / 15 / 50, 9).alias("offset_"))


@query("SELECT * FROM (SELECT tile_id, src_id AS gtid, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 50) QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY gtid) <= 5")
def max_trees(spark, d):
    t = _trees(spark, d).groupBy("tile_id", "gtid").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    return t.withColumn("r", F.row_number().over(W.partitionBy("tile_id").orderBy("gtid"))).where("r <= 5").drop("r")


@query("SELECT tile_id, src_id AS gtid, ((row_number() OVER (PARTITION BY tile_id ORDER BY src_id) - 1) // 4)::BIGINT AS chunk FROM (SELECT DISTINCT tile_id, src_id FROM points)")
def tree_chunks(spark, d):
    t = _trees(spark, d).select("tile_id", "gtid").distinct()
    return t.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("tile_id").orderBy("gtid")) - 1) / 4))


@query("SELECT DISTINCT src_id AS gtid FROM points WHERE src_id % 3 <> 0 AND src_id % 7 <> 0")
def pending_trees(spark, d):
    t = _trees(spark, d).select("gtid").distinct()
    return pending(t, t.where("gtid % 3 = 0"), t.where("gtid % 7 = 0"))


@query("SELECT i, round(cos(i * 2 * pi() / 24), 9) + 0.0 AS c, round(sin(i * 2 * pi() / 24), 9) + 0.0 AS s FROM generate_series(0, 23) t(i)")
def trunk_cylinder(spark, d):
    ring = spark.range(1).select(F.explode(forest.trunk_ring()).alias("r"))
    return ring.select(F.col("r.i").cast("long").alias("i"), (F.round("r.c", 9) + 0.0).alias("c"), (F.round("r.s", 9) + 0.0).alias("s"))


@query("SELECT tile_id, src_id AS gtid, x_mm - min(x_mm) OVER w AS qx, y_mm - min(y_mm) OVER w AS qy, z_mm - min(z_mm) OVER w AS qz, point_id FROM points WINDOW w AS (PARTITION BY tile_id)")
def quantize_vertices(spark, d):
    t = _trees(spark, d)
    w = W.partitionBy("tile_id")
    return t.select("tile_id", "gtid", *(cityjson.quantize(F.col(f"{a}_mm") / 1000.0, F.min(f"{a}_mm").over(w) / 1000.0).alias(f"q{a}") for a in "xyz"), "point_id")


@query("""WITH v AS (SELECT DISTINCT tile_id, src_id AS gtid, floor(x_mm / 500.0)::BIGINT AS i, floor(y_mm / 500.0)::BIGINT AS j, floor(z_mm / 500.0)::BIGINT AS k FROM points),
s AS (SELECT v.*, i + a AS ni, j + b AS nj, k + c AS nk FROM v, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c)),
f AS (SELECT tile_id, gtid, count(*) * 2 AS n_faces FROM s ANTI JOIN v t ON s.tile_id = t.tile_id AND s.gtid = t.gtid AND ni = t.i AND nj = t.j AND nk = t.k GROUP BY ALL)
SELECT tile_id, gtid, n_faces, 0::BIGINT AS n_open, (6 * count(*))::BIGINT AS six_volume FROM f JOIN v USING (tile_id, gtid) GROUP BY ALL""")
def mesh_watertight(spark, d):
    keys = ("tile_id", "gtid")
    return forest.voxel_checks(forest.voxel_of(_trees(spark, d), 500, keys), keys).drop("n_edges")


@query("SELECT tile_id, gtid, n, coalesce(sum(n) OVER (PARTITION BY tile_id ORDER BY gtid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT tile_id, src_id AS gtid, count(*) AS n FROM points GROUP BY ALL)")
def vertex_offsets(spark, d):
    t = _trees(spark, d).groupBy("tile_id", "gtid").agg(F.collect_list("point_id").alias("vertices")).withColumn("role", F.lit("crown"))
    return cityjson.vertex_offsets(t).select("tile_id", "gtid", F.size("vertices").cast("long").alias("n"), "base")


@query()
def cityjson_tile(spark, d):
    t = _trees(spark, d)
    at = t.select("tile_id", "gtid").distinct()
    facts = at.withColumn("n_tiles", F.count(F.lit(1)).over(W.partitionBy("gtid")))
    return cityjson.voxel_documents(forest.voxel_of(t, 500, ("tile_id", "gtid")), facts, 500)


_SOLID = "col AS (SELECT tile_id, src_id AS gtid, floor(x_mm / 500.0)::BIGINT AS i, floor(y_mm / 500.0)::BIGINT AS j, min(floor(z_mm / 500.0)::BIGINT) AS low, max(floor(z_mm / 500.0)::BIGINT) AS high FROM points GROUP BY ALL)"


@query(f"""WITH {_SOLID}, fine AS (
  SELECT tile_id, gtid, i * 2 + a AS i, j * 2 + b AS j, unnest(generate_series(low * 2, high * 2 + 1)) AS k FROM col, generate_series(0, 1) u(a), generate_series(0, 1) v(b)),
occ AS (SELECT DISTINCT tile_id, src_id AS gtid, floor(x_mm / 250.0)::BIGINT AS i, floor(y_mm / 250.0)::BIGINT AS j, floor(z_mm / 250.0)::BIGINT AS k FROM points)
SELECT tile_id, gtid, count(*) AS interior, count(occ.k) AS occupied, round(greatest(0.0, least(1.0, 1 - count(occ.k) / count(*))), 9) AS porosity FROM fine LEFT JOIN occ USING (tile_id, gtid, i, j, k) GROUP BY ALL""")
def porosity(spark, d):
    """Occupied interior voxels of each crown's solid against all interior ones."""
    return metrics.porosity(_trees(spark, d), ("tile_id", "gtid")).withColumn("porosity", F.round("porosity", 9))


@query(f"WITH {_SOLID} SELECT tile_id, gtid, i, j, unnest(generate_series(low, high)) AS k FROM col")
def crown_solid(spark, d):
    return metrics.crown_solid(_trees(spark, d), ("tile_id", "gtid"))


@query()
def crown_width(spark, d):
    h = forest.hulls(_trees(spark, d), ("tile_id", "gtid"))
    return h.select("tile_id", "gtid", F.round("area_m2", 6).alias("area_m2"), F.round(forest.crown_width(F.col("area_m2")), 6).alias("crown_width_m"))


@query()
def r50(spark, d):
    return metrics.r50(_trees(spark, d), ("tile_id", "gtid")).withColumn("r50", F.round("r50", 6))


@query()
def tree_metrics(spark, d):
    return metrics.bundle(_trees(spark, d), forest.min_raster(points(spark, d)))


@query()
def tree_solids(spark, d):
    """Crown and stem of each tree: faces, open edges (0: closed) and volume."""
    t = _trees(spark, d)
    m = metrics.bundle(t, forest.min_raster(points(spark, d)), with_r50=False)
    return metrics.solid_checks(t, m, _centres(spark, d))


@query("SELECT src_id AS gtid, point_id, round(x_mm / 1000.0 - avg(x_mm) OVER w / 1000, 9) + 0.0 AS x, round(y_mm / 1000.0 - avg(y_mm) OVER w / 1000, 9) + 0.0 AS y, round(z_mm / 1000.0 - avg(z_mm) OVER w / 1000, 9) + 0.0 AS z FROM points WINDOW w AS (PARTITION BY src_id)")
def localize(spark, d):
    return metrics.localized(_trees(spark, d)).select("gtid", "point_id", *((F.round(a, 9) + 0.0).alias(a) for a in "xyz"))


@query()
def ground_cloth(spark, d):
    """Points of the ground by a cloth of 2 m cells."""
    return ground.classify_ground(points(spark, d), cell=2000).groupBy("tile_id", "classification").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'filter' AS stage, tile_id, CASE WHEN count(*) FILTER (number_of_returns >= 7) >= 1 THEN 'ok' ELSE 'empty_tile' END AS status, count(*) FILTER (number_of_returns >= 7) >= 1 AS did_work, (count(*) FILTER (number_of_returns >= 7)) || ' rows' AS detail FROM points GROUP BY tile_id")
def tile_outcomes(spark, d):
    """A row for every tile, also for those that nothing is left of."""
    p = points(spark, d)
    return tables.outcomes(p, p.where("number_of_returns >= 7"), "filter")


@query("SELECT tile_id, point_id FROM points WHERE classification = 1")
def class_filter(spark, d):
    return vegetation.of_class(points(spark, d), 1).select("tile_id", "point_id")


@query("""WITH RECURSIVE top AS (SELECT * FROM points QUALIFY (max(z_mm) OVER (PARTITION BY tile_id) - z_mm) // 1500 = 0), """ + _components_sql("top", 1582).replace("<= 1582 ** 2", "< 2500000") + """
SELECT tile_id, point_id, component, size FROM cs WHERE size >= 3""")
def slab_cluster_top(spark, d):
    """Clusters of each tile's top slab."""
    top = points(spark, d).withColumn("_top", F.max("z_mm").over(W.partitionBy("tile_id"))).where("_top - z_mm < 1500").drop("_top")
    return vegetation.component_sizes(top, 1582, 2_500_000).where("size >= 3")


_FRONT = """seed AS (SELECT * FROM points WHERE return_number = 1 AND number_of_returns >= 4), left_ AS (SELECT * FROM points WHERE return_number > 1 AND number_of_returns >= 4)"""


@query(f"""WITH {_FRONT},
k AS (SELECT *, floor(x_mm / 2500.0)::BIGINT AS cx, floor(y_mm / 2500.0)::BIGINT AS cy, floor(z_mm / 2500.0)::BIGINT AS cz FROM seed),
o AS (SELECT q.*, floor(x_mm / 2500.0)::BIGINT + i AS nx, floor(y_mm / 2500.0)::BIGINT + j AS ny, floor(z_mm / 2500.0)::BIGINT + l AS nz FROM left_ q, generate_series(-1, 1) a(i), generate_series(-1, 1) b(j), generate_series(-1, 1) c(l)),
m AS (SELECT o.tile_id, o.point_id, k.point_id AS p_id, k.src_id, ((o.x_mm - k.x_mm) ** 2 + (o.y_mm - k.y_mm) ** 2 + (o.z_mm - k.z_mm) ** 2)::BIGINT AS d2 FROM o JOIN k ON o.tile_id = k.tile_id AND nx = cx AND ny = cy AND nz = cz)
SELECT tile_id, point_id, arg_min(src_id, (d2, p_id)) AS tid FROM m WHERE d2 < 6250000 GROUP BY tile_id, point_id""")
def front_propagation(spark, d):
    """One synchronous round: points not yet in a tree join that of the nearest point that is, at less than 2.5 m."""
    p = points(spark, d).where("number_of_returns >= 4")
    first = F.col("return_number") == 1
    rows = p.withColumns({"tid": F.col("src_id"), "is_base": first, "is_query": ~first})
    return spatial.nearest_among(rows, 2500, carry="tid").select("tile_id", F.col("q_id").alias("point_id"), "tid")


@query("SELECT 'segment' AS stage, CASE WHEN n >= 1000 THEN 'ok' ELSE 'small_tile' END AS status, count(*) AS n, sum((n >= 1000)::INT)::BIGINT AS n_worked FROM (SELECT tile_id, count(*) AS n FROM points GROUP BY tile_id) GROUP BY ALL")
def outcome_summary(spark, d):
    t = points(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("c"))
    return tiles.outcome_summary(t.select(F.lit("segment").alias("stage"), F.when(F.col("c") >= 1000, "ok").otherwise("small_tile").alias("status"), (F.col("c") >= 1000).alias("did_work")))


@query("WITH t AS (SELECT DISTINCT tile_id, (split_part(tile_id, '_', 1)::BIGINT) * 24000 - 3000 AS minx, (split_part(tile_id, '_', 2)::BIGINT) * 24000 - 3000 AS miny FROM points) SELECT tile_id, minx, miny, minx + 24000 AS maxx, miny + 24000 AS maxy FROM t WHERE minx <= 27000 AND miny <= 3000 AND minx + 24000 >= -3000 OR minx <= 9000 AND miny <= 15000 AND minx + 24000 >= -3000 AND miny + 24000 >= -3000")
def tile_select(spark, d):
    part = lambda i: F.split("tile_id", "_")[i].cast("long") * 24000 - 3000
    t = points(spark, d).select("tile_id").distinct().select("tile_id", part(0).alias("minx"), part(1).alias("miny"))
    return tiles.touching(t.withColumns({"maxx": F.col("minx") + 24000, "maxy": F.col("miny") + 24000}), aoi(spark))
