import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovegrid.functions.points import points
from grovegrid.operators import forest, kernels, spatial, vegetation
from grovegrid.plans import queries
from grovegrid.sources import formats, tiles


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(same, name):
    same(name)


def cloud(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(100, 300)), int(rng.choice([10, 20, 30])) * 1000
    return np.stack((rng.integers(0, width, n), rng.integers(0, width, n), rng.integers(0, 15000, n)), axis=1)


def plain_trees(p, height=1500, reach=2500, link2=2_500_000, least=3):
    """The sweep point by point."""
    tree, made = np.full(len(p), -1), 0
    slab = (p[:, 2].max() - p[:, 2]) // height
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    for k in range(slab.max() + 1):
        rest = [i for i in range(len(p)) if slab[i] == k]
        while rest:
            parsed = [i for i in range(len(p)) if tree[i] >= 0]
            joined = {}
            for i in rest:
                best = min(((d2[i, j], j) for j in parsed), default=(reach**2, -1))
                if best[0] < reach**2:
                    joined[i] = tree[best[1]]
            if not joined:
                break
            for i, t in joined.items():
                tree[i] = t
            rest = [i for i in rest if i not in joined]
        seen = set()
        for i in rest:
            if i in seen:
                continue
            group, todo = [], [i]
            seen.add(i)
            while todo:
                a = todo.pop()
                group.append(a)
                new = [b for b in rest if b not in seen and d2[a, b] < link2]
                seen.update(new)
                todo += new
            if len(group) >= least:
                tree[group] = made
                made += 1
    return tree


@pytest.mark.parametrize("seed", range(8))
def test_sweep(seed):
    p = cloud(seed)
    assert np.array_equal(kernels.separate_trees(np.arange(len(p)), p), plain_trees(p))


def test_radius_of_clusters_and_open_balls():
    group = np.array([[0, 0, 9000], [500, 0, 9000], [0, 500, 9000]])
    two = np.concatenate((group, group + [2000 + 500, 0, 0]))
    assert kernels.separate_trees(np.arange(6), two).max() == 1
    far = np.concatenate((group, [[500 + 2500, 0, 9000 - 1500]]))
    assert kernels.separate_trees(np.arange(4), far).tolist() == [0, 0, 0, -1]
    a, b, _ = kernels.close_pairs(np.array([[0, 0, 0]]), np.array([[750, 0, 0]]), 750, 750**2, True)
    assert len(a) == 1


def test_empty_slab_and_upward():
    group = np.array([[0, 0, 9000], [500, 0, 9000], [0, 500, 9000]])
    low = group - [0, 0, 6000]
    both = np.concatenate((group, low))
    assert kernels.separate_trees(np.arange(6), both).tolist() == [0, 0, 0, 1, 1, 1]
    assert kernels.separate_trees(np.arange(6), both, upward=True).max() == -1
    assert kernels.slabs(np.array([3000, 1500, 1501]), 1500).tolist() == [0, 1, 0]
    assert len(kernels.separate_trees(np.zeros(0), np.zeros((0, 3)))) == 0


def test_knn_kernel():
    p = cloud(3)
    d = np.sort(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), axis=1)
    assert np.allclose(kernels.mean_knn_distance(p, 7, 500), d[:, 1:8].mean(1))
    assert np.allclose(kernels.mean_knn_distance(p[:5], 50, 500), np.sqrt(((p[:5, None] - p[None, :5]) ** 2).sum(2)).sum(1) / 4)
    assert np.isnan(kernels.mean_knn_distance(p[:1], 3, 500)).all()


def test_hull():
    assert kernels.hull(np.array([[0, 0], [2, 0], [1, 0]])).tolist() == [[0, 0], [2, 0]]
    ring = kernels.hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [2, 0]]))
    assert ring.tolist() == [[0, 0], [4, 0], [4, 4], [0, 4]]


def test_whole_cloud_counts(spark, data):
    """The published cardinalities of the cloud as one tile."""
    from pyspark.sql import functions as F

    p = points(spark, data).withColumn("tile_id", F.lit("all"))
    branch = vegetation.echo_branch(p)
    kept = [vegetation.sor(branch.where(F.col("branch") == b), k, s).where("keep").count() for b, (_, k, s) in vegetation.BRANCHES.items()]
    assert kept == [475, 2150]
    veg = vegetation.vegetation(p)
    assert veg.count() == 3819
    sizes = sorted(r["count"] for r in forest.segment(veg).groupBy("tid").count().collect())
    assert sizes == [341, 351, 360, 366, 384, 385, 394, 407, 412, 419]


def test_trunk_base_under_wide_crowns(spark):
    ring = lambda *p: [{"x_mm": x, "y_mm": y} for x, y in p]
    square, corner = ring((0, 0), (10000, 0), (10000, 10000), (0, 10000)), ring((0, 0), (10000, 0), (0, 10000))
    hulls = spark.createDataFrame([("t", 1, square, 5000.0, 5000.0), ("t", 2, corner, 3333.0, 3333.0), ("u", 3, square, 5000.0, 5000.0)], "tile_id string, gtid long, ring array<struct<x_mm:bigint,y_mm:bigint>>, cx double, cy double")
    trees = hulls.select("tile_id", "gtid").unionByName(spark.createDataFrame([("t", 4)], "tile_id string, gtid long"))
    dtm = spark.createDataFrame([("t", 18, 18, 70), ("t", 19, 0, 60), ("t", 0, 40, 50), ("u", 30, 30, 40)], "tile_id string, row long, col long, z_mm long")
    got = {r.gtid: (r.row, r.col, r.base_z_mm) for r in forest.trunk_base_under(trees, hulls, dtm).collect()}
    none = (None, None, None)
    assert got == {1: (18, 18, 70), 2: (19, 0, 60), 3: none, 4: none}


def scans(df):
    """How often the plan reads lineitem."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_trunk_base_reads_trees_once(spark, data):
    """Rows of all trees, those of under three points too, from one reading of the trees and one of the raster's points."""
    t = queries._trees(spark, data)
    few = t.where("point_id % 100 = 1").limit(2).withColumn("gtid", F.lit(-1).cast("long")).withColumn("tile_id", F.lit("x"))
    t, dtm = t.unionByName(few).localCheckpoint(), forest.min_raster(points(spark, data))
    want = forest.trunk_base_under(t, forest.hulls(t, ("tile_id", "gtid")), dtm).collect()
    got = forest.with_trunk_base(forest.hulls(t, ("tile_id", "gtid"), every=True).drop("area_m2"), dtm).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and ("x", -1) in {(r.tile_id, r.gtid) for r in got}
    assert scans(queries.trunk_base_hull(spark, data)) == 2


def test_trunk_base_and_width_of_hulls(spark, data):
    t = queries._trees(spark, data).toPandas()
    want = {g: 2 * np.sqrt(a / np.pi) for g, a in forest.hulls(queries._trees(spark, data), ("gtid",)).select("gtid", "area_m2").collect()}
    for r in queries.allometry_hull(spark, data).collect():
        assert r.h <= 0 or abs(r.dbh - want[r.gtid] ** 1.1 * r.h**0.7 / 100) < 1e-5
    got = queries.trunk_base_hull(spark, data).collect()
    assert len(got) == len(t[["tile_id", "gtid"]].drop_duplicates())


def test_knn_join(spark):
    p = cloud(5)[:60]
    rows = spark.createDataFrame([("t", i, *map(int, x)) for i, x in enumerate(p)], "tile_id string, point_id long, x_mm long, y_mm long, z_mm long")
    got = {}
    for r in spatial.knn_join(rows, rows, 3, 4000).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.p_id))
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    for i in range(len(p)):
        want = sorted((d2[i, j], j) for j in range(len(p)) if j != i)[:3]
        assert [x for _, x in sorted(got[i])] == [j for _, j in want]


def test_documents_parse(spark, data):
    for r in queries.cityjson_tile(spark, data).collect():
        doc = json.loads(r.doc)
        assert doc["version"] == "2.0" and len(doc["CityObjects"]) == r.n_trees
        used = [i for t in doc["CityObjects"].values() for g in t["geometry"] for shell in g["boundaries"] for ring in shell for face in ring for i in face]
        assert min(used) == 0 and max(used) == len(doc["vertices"]) - 1


def test_documents_where_voxels_are(spark, data):
    """Documents from voxels against those of the faces by tree; a tree without attributes and one in two tiles; no exchange but that of rows by tile."""
    from grovegrid.operators import cityjson

    keys = ("tile_id", "gtid")
    cells = forest.voxel_of(queries._trees(spark, data), 500, keys).where("gtid % 3 = 1").localCheckpoint()
    facts = cells.select("gtid").distinct().where("gtid <> 1").withColumns({"a": F.col("gtid") / 3, "b": F.lit(None).cast("int")})
    faces = cityjson.indexed(forest.voxel_faces(cells.distinct(), keys), list(keys)).withColumn("role", F.lit("crown"))
    faces = faces.withColumn("vertices", F.transform("vertices", lambda v: F.struct(*((v[a] * 500).alias(a) for a in "xyz"))))
    got = cityjson.voxel_documents(cells, facts, 500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cityjson.documents(faces, facts).collect()))
    trees = [t for r in got for t in json.loads(r.doc)["CityObjects"].items()]
    assert len(trees) == cells.select(*keys).distinct().count() and all(("attributes" in t) == (k != "T_1") for k, t in trees) and any(k == "T_1" for k, t in trees)
    with_trunk = faces.unionByName(faces.where("gtid = 4").withColumn("role", F.lit("trunk")))
    docs = [json.loads(r.doc) for r in cityjson.documents(with_trunk, facts).collect()]
    assert {len(t["geometry"]) for doc in docs for k, t in doc["CityObjects"].items() if k == "T_4"} == {2}
    plan = queries.cityjson_tile(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert scans(queries.cityjson_tile(spark, data)) == 2 and "SortMergeJoin" not in plan and plan.count("Exchange ") <= 6


def test_nearest_deals_each_point_out_once(spark, data):
    for f in (queries.bounded_nearest, queries.front_propagation):
        df = f(spark, data)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert scans(df) == 1 and "Join" not in plan and "Generate" not in plan
    p = points(spark, data)
    first, rest = p.where("return_number = 1").withColumn("tid", F.col("src_id")), p.where("return_number > 1")
    got = {(r.tile_id, r.q_id): (r.p_id, r.tid) for r in spatial.nearest_join(rest, first, 900, carry="tid").collect()}
    pairs = spatial.grid_join(rest, first, 900, False).groupBy("tile_id", "q_id").agg(F.min(F.struct("d2", "p_id"))["p_id"].alias("p_id"))
    want = pairs.join(first.select("tile_id", F.col("point_id").alias("p_id"), "tid"), ["tile_id", "p_id"])
    assert got == {(r.tile_id, r.q_id): (r.p_id, r.tid) for r in want.collect()} and got


def test_filters_read_points_once(spark, data):
    """Buffer, outliers and dilation: one reading, no join of points with themselves, and the same rows as the plain steps."""
    for f in (queries.aoi_buffer_select, queries.aoi_crop, queries.sor_keep, queries.dilated_candidates, queries.occupancy_dilate):
        df = f(spark, data)
        assert scans(df) == 1 and "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    p = vegetation.echo_branch(points(spark, data)).localCheckpoint()
    core = p.where("branch = 'C'")
    assert sorted(map(tuple, vegetation.candidates(p, core).collect())) == sorted(map(tuple, vegetation.candidates_of(p, "branch = 'C'").collect()))
    both = {(r.tile_id, r.point_id): (r.mean_distance, r.keep) for r in vegetation.sor_branches(p, vegetation.BRANCHES).collect()}
    for b, (_, k, s) in vegetation.BRANCHES.items():
        for r in vegetation.sor(p.where(F.col("branch") == b), k, s).collect():
            assert both.pop((r.tile_id, r.point_id)) == (r.mean_distance, r.keep)
    assert not both
    ij = np.random.default_rng(1).integers(-9, 9, (30, 2))
    steps = np.array([(0, 0), (1, -2), (-3, 1)])
    assert kernels.spread(np.concatenate((ij, ij)), steps).tolist() == sorted([list(t) for t in {(a + c, b + d) for a, b in ij.tolist() for c, d in steps.tolist()}])


def test_las_round_trip(spark, data, tmp_path):
    p = points(spark, data).limit(500).toPandas()
    (tmp_path / "a.las").write_bytes(formats.write_las_bytes(p))
    back = formats.read_las(spark, str(tmp_path)).toPandas()
    cols = ["x_mm", "y_mm", "z_mm", "return_number", "number_of_returns", "classification"]
    assert np.array_equal(back[cols].to_numpy(), p[cols].to_numpy())


def test_sources(spark, tmp_path):
    area = {"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(area))
    assert formats.read_area(spark, str(tmp_path / "a.geojson")).count() == 3
    with pytest.raises(ValueError):
        tiles.scheme(3)
    (tmp_path / "p.xyz").write_text("1.0 2.0 3.0\nno numbers here\n")
    assert [tuple(r) for r in formats.read_xyz(spark, str(tmp_path / "p.xyz")).collect()] == [(1000, 2000, 3000)]


def test_stream(spark, data, tmp_path):
    from grovegrid.streaming.ingest import echo_counts, process_arrivals

    p = points(spark, data)
    p.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in p.dtypes)
    process_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema, echo_counts).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"n": "sum"}).first()[0] == p.count()


def test_stream_of_two_batches(spark, tmp_path):
    """A tile whose points come in two batches is processed whole."""
    from grovegrid.streaming.ingest import echo_counts, process_arrivals

    schema = "tile_id string, point_id long, number_of_returns int"
    run = lambda: process_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema, echo_counts).awaitTermination(90)
    for rows in ([("000001_000002", i, 1) for i in range(5)] + [("b", 9, 2)], [("000001_000002", i, 1) for i in range(5, 8)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = {(r.tile_id, r.n) for r in spark.read.schema("number_of_returns int, n long, tile_id string").parquet(str(tmp_path / "out")).collect()}
    assert got == {("000001_000002", 8), ("b", 1)}


@pytest.mark.parametrize("seed", range(4))
def test_vegetation_in_one_pass(spark, seed):
    """The kernel of a tile against the steps as joins."""
    rng = np.random.default_rng(seed)
    n = 1500
    xyz = rng.integers(0, 3500, (n, 3))
    nr = rng.integers(1, 6, n)
    rows = [("t" if i % 3 else "u", i, *map(int, xyz[i]), int(rng.integers(1, nr[i] + 1)), int(nr[i]), 1) for i in range(n)]
    p = spark.createDataFrame(rows, "tile_id string, point_id long, x_mm long, y_mm long, z_mm long, return_number int, number_of_returns int, classification int")
    core = vegetation.core_points(p)
    want = sorted(map(tuple, core.unionByName(vegetation.accepted(vegetation.candidates(p, core), core).select(*core.columns)).collect()))
    assert sorted(map(tuple, vegetation.vegetation(p).collect())) == want
    if seed == 0:
        assert 0 < len(want) < n


def test_pairs_in_blocks():
    p = cloud(1) // 8
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    got = sorted((int(a), int(b)) for i, j, _ in kernels.pair_blocks(p, p, 800, 640_000, True, 50) for a, b in zip(i, j, strict=True))
    assert got == sorted(map(tuple, np.argwhere(d2 <= 640_000).tolist()))
    root = kernels.radius_components(p, 800)
    assert all(root[a] == root[b] for a, b in got) and all(root[r] == r <= i for i, r in enumerate(root))


@pytest.mark.parametrize("width, shift", [(1000, 0), (4000, 10**8), (40000, -5000), (2**30 + 2**20, 0)])
def test_nearest_and_dense_pairs(width, shift):
    """Full and empty cells, ties and far coordinates against all pairs."""
    rng = np.random.default_rng(width % 97)
    q, p = (rng.integers(0, width, (n, 3)) // 50 * 50 + shift for n in (150, 500))
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    for cell, bound, closed in ((700, 490_000, True), (701, 480_000, False)):
        i, j, d = kernels.close_pairs(q, p, cell, bound, closed)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(d2 <= bound if closed else d2 < bound).tolist())) and (d == d2[i, j]).all()
    for reach in (3, 600, 2500):
        i, j, d = kernels.nearest(q, p, reach)
        want = [(a, int(d2[a].argmin())) for a in range(len(q)) if d2[a].min() < reach**2]
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want and (d == d2[i, j]).all()
    assert len(kernels.nearest(q[:0], p, 500)[0]) == len(kernels.nearest(q, p[:0], 500)[0]) == 0


def test_r50_and_porosity_by_hand():
    """Against every voxel of the solid and every point, one by one."""
    from grovegrid.operators import metrics

    rng = np.random.default_rng(8)
    p = rng.integers(-1500, 1500, (40, 3))
    solid = {}
    for x, y, z in (p // 500).tolist():
        low, high = solid.get((x, y), (z, z))
        solid[x, y] = min(low, z), max(high, z)
    q = np.array([(x * 500 + a, y * 500 + b, z * 500 + c) for (x, y), (low, high) in solid.items() for z in range(low, high + 1) for a in range(0, 500, 100) for b in range(0, 500, 100) for c in range(0, 500, 100)])
    want = np.median(np.sqrt(((q[:, None] - p[None]) ** 2).sum(2)).min(1)) / 1000
    assert abs(metrics.median_gap(p, np.arange(40)) - want) < 1e-9
    assert np.isnan(metrics.median_gap(p[:0], np.arange(0)))
    close = np.array([[0, 0, 0], [5, 5, 5], [400, 400, 400]])
    assert metrics.median_gap(close, np.array([1, 0, 2])) == metrics.median_gap(close[1:], np.arange(2))


def test_r50_of_a_tall_crown():
    """No place of a solid of 750,000 is left out, and pairs in small parts give the same."""
    from grovegrid.operators import metrics

    p = np.array([[0, 0, 0], [490, 490, 3_000_000 - 1], [10, 20, 700_000], [400, 480, 900_000]])
    x, y, z = np.meshgrid(np.arange(0, 500, 100), np.arange(0, 500, 100), np.arange(0, 3_000_000, 100), indexing="ij")
    q = np.stack((x.ravel(), y.ravel(), z.ravel()), axis=1)
    best = np.min([((q - a) ** 2).sum(1) for a in p], axis=0)
    assert len(q) == 750_000 and abs(metrics.median_gap(p, np.arange(4)) - np.median(np.sqrt(best)) / 1000) < 1e-9
    rng = np.random.default_rng(2)
    p = rng.integers(-2000, 2000, (200, 3))
    voxels = np.unique(p // 500, axis=0)
    want = np.sort(np.concatenate(list(metrics.lattice_gaps(voxels, p, 500, 100, 10**9))))
    assert np.array_equal(np.sort(np.concatenate(list(metrics.lattice_gaps(voxels, p, 500, 100, 500)))), want)
    q = (voxels[:, None] * 500 + np.array(list(np.ndindex(5, 5, 5))) * 100).reshape(-1, 3)
    assert np.array_equal(np.sort(((q[:, None] - p) ** 2).sum(2).min(1)), want)


def test_checks_of_voxels_deal_out_no_faces(spark):
    """As open_edges of the faces, with one exchange; large coordinates and voxels that repeat or touch along an edge included."""
    rows = [("t", g, *map(int, c)) for g in range(7) for c in np.random.default_rng(g).integers(0, 4, (1 + g * 9, 3)) + g * 10**8 * (g > 4)]
    rows += [("u", 1, 0, 0, 0), ("u", 1, 1, 1, 0), ("u", 1, 0, 0, 0)]
    cells = spark.createDataFrame(rows, "tile_id string, gtid long, i long, j long, k long")
    got, small = forest.voxel_checks(cells, ("tile_id", "gtid")), cells.where("i < 100000")
    want = forest.open_edges(forest.voxel_faces(small.distinct(), ("tile_id", "gtid")), ("tile_id", "gtid"))
    assert sorted(map(tuple, got.where("tile_id = 'u' or gtid < 5").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("gtid >= 5").agg({"n_open": "sum"}).first()[0] == 0 and got.count() == 8
    plan = queries.mesh_watertight(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2


def test_metrics_read_points_once(spark, data):
    """One reading for all metrics of a tree and one for the raster; bundle against hulls, porosity and r50 each by itself."""
    from grovegrid.operators import metrics

    assert scans(queries.tree_metrics(spark, data)) == 2 and scans(queries.tree_solids(spark, data)) == 4
    t, keys = queries._trees(spark, data), ("tile_id", "gtid")
    got = {(r.tile_id, r.gtid): r for r in metrics.crowns(t).collect()}
    for r in forest.hulls(t, keys).join(metrics.porosity(t, keys), list(keys)).join(metrics.r50(t, keys), list(keys)).collect():
        x = got[r.tile_id, r.gtid]
        assert (x.ring, x.area_m2, x.cx, x.cy, x.porosity, x.r50) == (r.ring, r.area_m2, r.cx, r.cy, r.porosity, r.r50)


def test_solids_checked_in_place(spark, data):
    """As open_edges of all faces; the stem's expression names each of its inputs a few times only."""
    from grovegrid.operators import metrics

    t, keys = queries._trees(spark, data).where("gtid < 4"), ("tile_id", "gtid", "role")
    m, places = metrics.bundle(t, forest.min_raster(points(spark, data)), False).localCheckpoint(), queries._centres(spark, data)
    want = forest.open_edges(metrics.solids(t, m, places), keys).collect()
    got = metrics.solid_checks(t, m, places).select(*keys, *forest.CHECKS).collect()
    assert {(*(r[k] for k in keys), *(r[c] for c in forest.CHECKS)) for r in got} == {(*(r[k] for k in keys), *(r[c] for c in forest.CHECKS)) for r in want} and len(got) == len(want)
    stems = spark.range(1).select(metrics.stem(*[tuple(F.col("id") + i for i in range(3))] * 2, F.col("id") * 0.5).alias("f"))
    assert stems._jdf.queryExecution().analyzed().toString().count("id#") < 60


def test_metrics_and_solids(spark, data):
    """Every tree has a row; stems and crowns are closed, with the volumes of their shapes."""
    t = queries._trees(spark, data)
    got = queries.tree_metrics(spark, data).collect()
    assert len(got) == t.select("tile_id", "gtid").distinct().count() and got[0].__fields__[2:] == ["crown_width_m", "crown_median_z", "crown_r50_m", "crown_porosity", "trunk_H_m", "trunk_DBH_m", "trunk_radius_m", "trunk_base_height_m"]
    m = {(r.tile_id, r.gtid): r for r in got}
    for r in queries.tree_solids(spark, data).collect():
        assert r.n_open == 0 and r.six_volume > 0
        if r.role == "trunk":
            x = m[r.tile_id, r.gtid]
            prism = 24 / 2 * np.sin(2 * np.pi / 24) * x.trunk_radius_m**2 * x.trunk_H_m
            assert r.n_faces == 96 and abs(r.six_volume / 6e9 - prism) < 0.2 * prism + 1e-3


def test_stem_and_normalized(spark):
    from pyspark.sql import functions as F

    from grovegrid.operators import metrics

    place = lambda *v: tuple(F.lit(float(c)) for c in v)
    for base, top in (((0, 0, 0), (0, 0, 9)), ((1, 2, 3), (8, 2, 3)), ((5, 5, 5), (7, 9, 20))):
        faces = spark.range(1).select("id", F.explode(metrics.stem(place(*base), place(*top), F.lit(2.0))).alias("f")).select("id", *(F.struct(*(F.round(f"f.{c}.{a}", 6).alias(a) for a in "xyz")).alias(c) for c in "abc"))
        r = forest.open_edges(faces, ("id",)).first()
        long = np.sqrt(sum((a - b) ** 2 for a, b in zip(base, top, strict=True)))
        assert r.n_open == 0 and abs(r.six_volume / 6 - 12 * np.sin(np.pi / 12) * 4 * long) < 1e-3
    assert spark.range(1).select(metrics.stem(place(0, 0, 0), place(0, 0, 0), F.lit(2.0)).alias("f"), metrics.stem(place(0, 0, 0), place(0, 0, 1), F.lit(0.0)).alias("g")).first() == (None, None)
    rows = spark.createDataFrame([("t", 1, float("nan"), float("inf"), 2.0)], "tile_id string, gtid long, crown_r50_m double, trunk_H_m double, crown_width_m double")
    r = metrics.normalized(rows).first()
    assert list(r[:3]) == [1, "t", 2.0] and all(v is None for v in r[3:])


def test_ground_by_cloth(spark):
    """A gentle slope with boxes on it: the slope is ground, the boxes' tops are not."""
    from grovegrid.operators import ground

    rng = np.random.default_rng(1)
    xy = rng.integers(0, 30000, (4000, 2))
    box = ((xy // 1000) % 10 < 3).all(1)
    z = xy[:, 0] // 30 + np.where(box, 4000, 0)
    rows = [("t", i, int(x), int(y), int(h), 0, "k") for i, ((x, y), h) in enumerate(zip(xy, z, strict=True))]
    p = spark.createDataFrame(rows, "tile_id string, point_id long, x_mm long, y_mm long, z_mm long, classification int, other string")
    got = ground.classify_ground(p, cell=1000).toPandas().set_index("point_id").sort_index()
    assert list(got.columns) == [c for c in p.columns if c != "point_id"]
    assert (got.classification.to_numpy()[~box] == 2).mean() > 0.9 and (got.classification.to_numpy()[box] == 1).mean() > 0.9


def test_tables_of_a_case(spark, data, tmp_path):
    from grovegrid.sources import tables

    case = tables.Case(spark, str(tmp_path), "town")
    p = points(spark, data)
    case.write(p, "points")
    assert case.read("points").count() == p.count() and case.tiles() == sorted(r[0] for r in p.select("tile_id").distinct().collect())
    case.write(p.limit(5), "points", overwrite=False)
    assert case.read("points").count() == p.count() and not case.exists("dtm")
    with pytest.raises(ValueError):
        case.read("no such table")
    t = queries._trees(spark, data)
    ids = forest.number_trees(t)
    tables.write_gtid_map(ids, str(tmp_path / "map"))
    assert sorted(map(tuple, tables.read_gtid_map(spark, str(tmp_path / "map")).collect())) == sorted(map(tuple, ids.select("tile_id", "tid", "gtid").collect()))
    tables.write_segmentation(t, str(tmp_path / "seg"))
    back = tables.read_segmentation(spark, str(tmp_path / "seg"))
    assert back.count() == t.count() and back.agg({"x_mm": "sum"}).first()[0] == t.agg({"x_mm": "sum"}).first()[0]
    assert back.groupBy("tile_id").agg({"tid": "min"}).select("min(tid)").distinct().collect() == [(0,)]
    tables.write_coloured(t, str(tmp_path / "rgb"))
    assert all(len(r.value.split()) == 6 and all(0 <= int(c) < 256 for c in r.value.split()[3:]) for r in spark.read.text(str(tmp_path / "rgb")).limit(50).collect())
    hulls = forest.hulls(t)
    tables.write_hulls(hulls, str(tmp_path / "hulls"))
    texts = [f.read_text() for f in (tmp_path / "hulls").rglob("*.txt")]
    assert sum(len(json.loads(x)["features"]) for x in texts) == hulls.count() and all(g["geometry"]["coordinates"][0][0] == g["geometry"]["coordinates"][0][-1] for x in texts for g in json.loads(x)["features"])
    dtm = forest.min_raster(p)
    tables.write_raster(dtm, str(tmp_path / "dtm"))
    cells = {(r.tile_id, r.row, r.col): r.z_mm for r in dtm.collect()}
    n = 0
    for f in (tmp_path / "dtm").rglob("*.txt"):
        lines = f.read_text().splitlines()
        head = dict(x.split() for x in lines[:6])
        tile, rows = f.parent.name.split("=")[1], lines[6:]
        assert len(rows) == int(head["nrows"])
        r0, c0 = round(float(head["yllcorner"]) / 0.5), round(float(head["xllcorner"]) / 0.5)
        for i, line in enumerate(rows):
            for j, v in enumerate(line.split()):
                if v != "-9999":
                    n += 1
                    assert cells[tile, r0 + len(rows) - 1 - i, c0 + j] == round(float(v) * 1000)
    assert n == len(cells)
    under = tables.read_raster_under(dtm, forest.hulls(t, ("tile_id", "gtid")))
    assert under.join(dtm, ["tile_id", "row", "col", "z_mm"], "left_anti").isEmpty() and not under.isEmpty()
    tables.write_documents(queries.cityjson_tile(spark, data), str(tmp_path / "city"))
    assert all(json.loads(f.read_text())["type"] == "CityJSON" for f in (tmp_path / "city").rglob("*.txt"))
    (tmp_path / "index.json").write_text(json.dumps({"features": [{"properties": {"GT_AHNSUB": "37EN1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10.5, 0], [10.5, -4], [0, 0]]]}}]}))
    assert [tuple(r) for r in tables.tile_catalog(spark, str(tmp_path / "index.json")).collect()] == [("37EN1", 0.0, -4.0, 10.5, 0.0)]


def test_fetch(spark, tmp_path):
    import io
    import urllib.error

    from grovegrid.sources import tables

    def opener(url, timeout):
        if url.endswith("missing"):
            raise urllib.error.HTTPError(url, 404, "", None, None)
        if url.endswith("broken"):
            raise OSError("reset")
        return io.BytesIO(b"x" * 10)

    target = str(tmp_path / "a" / "b.laz")
    assert tables.fetch("http://h/b.laz", target, opener=opener) == ("ok", True, target)
    assert tables.fetch("http://h/b.laz", target, opener=opener)[:2] == ("exists", False)
    assert tables.fetch("http://h/missing", str(tmp_path / "c"), opener=opener)[:2] == ("not_in_coverage", False)
    assert tables.fetch("http://h/broken", str(tmp_path / "d"), opener=opener) == ("download_failed", False, "reset")
    assert sorted(f.name for f in tmp_path.rglob("*") if f.is_file()) == ["b.laz"]
    source = tmp_path / "src"
    source.mkdir()
    (source / "t1.laz").write_bytes(b"1")
    rows = [("t1", f"file://{source}/t1.laz", True), ("t1", f"file://{source}/t1.lax", False), ("t2", f"file://{source}/t2.laz", True)]
    got = {r.tile_id: (r.status, r.did_work) for r in tables.fetch_tiles(spark.createDataFrame(rows, "tile_id string, url string, required boolean"), str(tmp_path / "tiles")).collect()}
    assert got == {"t1": ("ok", True), "t2": ("download_failed", False)}
