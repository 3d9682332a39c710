"""Edge cases, invariants and independent formulations."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.functions import scalars as S
from orthoweave.operators import cameras as C
from orthoweave.operators import features as P
from orthoweave.operators import graph as G
from orthoweave.operators import knn as K
from orthoweave.operators import matches as M
from orthoweave.operators import patches as T
from orthoweave.operators import raster as R
from orthoweave.operators import tiles as L
from orthoweave.operators import robust as B
from orthoweave.operators import spatial as X
from orthoweave.plans import registry
from orthoweave.sources import files

DATA = "/root/testdata/sf0.001"


def all_pairs(features, pairs, k):
    """The k-NN join with every candidate pair as a row."""
    a = features.select(F.col("iid").alias("iid_i"), F.col("fid").alias("fid_i"), F.col("vec").alias("a"))
    b = features.select(F.col("iid").alias("iid_j"), F.col("fid").alias("fid_j"), F.col("vec").alias("b"))
    scored = pairs.join(a, "iid_i").join(b, "iid_j").select("iid_i", "fid_i", "iid_j", "fid_j", K.l2sq(F.col("a"), F.col("b")).alias("dist"))
    return K.k_best(scored, ["iid_i", "fid_i", "iid_j"], ["dist", "fid_j"], k)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# -- features and neighbours --------------------------------------------------------------------


def test_retain_best_keeps_ties_at_the_boundary(spark):
    f = spark.createDataFrame([(1, k, 0.0, 0.0, v) for k, v in enumerate([5.0, 4.0, 4.0, 3.0])], "iid long, fid long, x double, y double, response double")
    assert rows(P.retain_best(f, 2), "fid") == [(0,), (1,), (2,)]
    assert P.retain_best(f, 0).count() == 0
    assert P.retain_best(f, 9).count() == 4


def test_gridded_retention_of_small_images(spark):
    f = spark.createDataFrame([(1, 0, 1.0, 1.0, 5.0)], "iid long, fid long, x double, y double, response double")
    assert P.retain_best_gridded(f, 10).count() == 1
    many = spark.createDataFrame([(1, k, float(k % 3), 0.0, float(k)) for k in range(9)], "iid long, fid long, x double, y double, response double")
    assert rows(P.retain_best_gridded(many, 2), "fid") == [(8,)]  # cells are five wide at least


def test_ratio_is_strict_and_needs_a_second_neighbour(spark):
    knn = spark.createDataFrame([(0, 1, 1, 5, 0.8, 1), (0, 1, 1, 6, 1.0, 2), (0, 2, 1, 5, 0.0, 1), (0, 2, 1, 6, 0.0, 2), (0, 3, 1, 5, 0.1, 1), (0, 4, 1, 5, 0.7, 1), (0, 4, 1, 6, 1.0, 2)], "iid_i long, fid_i long, iid_j long, fid_j long, dist double, rank int")
    assert rows(K.ratio_test(knn, 0.8), "fid_i") == [(4,)]


def test_knn_blocks_equal_columns_and_clamp(spark):
    rng = np.random.default_rng(0)
    f = spark.createDataFrame([(i, k, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(3) for k in range(1 if i == 2 else 20)], "iid long, fid long, vec array<float>")
    pairs = P.image_pairs(f)
    cols = ["iid_i", "fid_i", "iid_j", "fid_j", "rank"]
    assert rows(K.knn_join(f, pairs, 2, query_block=7), *cols) == rows(all_pairs(f, pairs, 2), *cols)
    assert rows(K.knn_join(f, pairs, 2, query_block=7, train_block=5), *cols) == rows(all_pairs(f, pairs, 2), *cols)
    with pytest.raises(ValueError):
        K.knn_join(f, pairs, 2, "cosine")


def test_ann_recall(spark):
    f = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("label").cast("long").alias("iid"), F.col("vec_id").alias("fid"), F.col("embedding").alias("vec"))
    pairs = P.image_pairs(f)
    true = set(rows(K.knn_join(f, pairs, 1), "fid_i", "iid_j", "fid_j"))
    found = set(rows(K.ann_join(f, pairs, 1), "fid_i", "iid_j", "fid_j"))
    assert len(true & found) / len(true) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 10, 11, 40])
def test_spatial_knn_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    p = rng.integers(0, 30, (n, 2)).astype(float)
    m = spark.createDataFrame([(0, 1, k, float(x), float(y)) for k, (x, y) in enumerate(p)], "iid_i long, iid_j long, fid_i long, x1 double, y1 double")
    want = max(1, n // 2) if n <= 10 else 5
    expected = []
    for k in range(n):
        d = ((p - p[k]) ** 2).sum(1)
        order = sorted(range(n), key=lambda j: (d[j], j != k, j))[:want]
        expected += [(k, j, r) for r, j in enumerate(order, 1)]
    assert rows(K.spatial_knn(m), "fid_i", "nkey", "rank") == sorted(expected)


def test_spatial_knn_of_a_lone_far_point(spark):
    pts = [(0, 1, k, float(k % 10) / 100, float(k // 10) / 100) for k in range(100)] + [(0, 1, 100, 5000.0, 5000.0)]
    m = spark.createDataFrame(pts, "iid_i long, iid_j long, fid_i long, x1 double, y1 double")
    far = [r for r in rows(K.spatial_knn(m), "fid_i", "nkey", "rank") if r[0] == 100]
    assert {r: k for _, k, r in far} == {1: 100, 2: 99, 3: 89, 4: 98, 5: 88}


def test_segments(spark):
    cases = [((0, 0, 10, 0), (5, -5, 5, 5), True), ((0, 0, 0, 10), (0, 5, 0, 20), True), ((0, 0, 10, 10), (10, 10, 20, 0), True), ((0, 0, 1, 1), (0, 0, 1, 1), True), ((0, 0, 1, 0), (0, 1, 1, 1), False), ((0, 0, 1, 0), (2, 0, 3, 0), False)]
    df = spark.createDataFrame([(n, *map(float, a), *map(float, b)) for n, (a, b, _) in enumerate(cases)], "n int, a double, b double, c double, d double, e double, f double, g double, h double")
    got = df.orderBy("n").select(S.segments_touch(*(F.col(c) for c in "abcdefgh")).alias("t")).collect()
    assert [r.t for r in got] == [c[2] for c in cases]


def test_match_filters_only_remove(spark):
    m = registry.QUERIES["J12_attach_ends"](spark, DATA).withColumn("response", F.lit(1.0))
    every = set(rows(m, "iid_i", "fid_i", "fid_j"))
    for part in (M.crossing_filter(m), M.orientation_filter(m), M.max_displacement(m, 500), M.retain_best_matches(m, 3)):
        assert set(rows(part, "iid_i", "fid_i", "fid_j")) <= every
    assert rows(M.sample_n(m, ["iid_i"], ["fid_i"], 5, 1)) == rows(M.sample_n(m, ["iid_i"], ["fid_i"], 5, 1))


# -- graphs -------------------------------------------------------------------------------------


def test_components(spark):
    chain = [(k, k + 1) for k in range(64)]
    star = [(1000, 1000 + k) for k in range(1, 64)]
    edges = spark.createDataFrame([*chain, *star, (5, 4), (5, 5), (7000, 7000), (None, 3)], "u long, v long")
    got = dict(rows(G.connected_components(edges)))
    assert all(got[k] == 0 for k in range(65)) and all(got[k] == 1000 for k in range(1000, 1064)) and got[7000] == 7000 and len(got) == 65 + 64 + 1


def test_components_of_no_edges(spark):
    assert G.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_track_conflicts(spark):
    m = spark.createDataFrame([(0, 1, 7, 8), (0, 1, 9, 8), (2, 3, 1, 1)], "iid_i long, iid_j long, fid_i long, fid_j long")
    one = G.connect_matches(m)
    assert rows(one, "iid", "fid") == [(0, 7), (1, 8), (2, 1), (3, 1)]
    assert rows(G.connect_matches(m, "drop"), "iid", "fid") == [(2, 1), (3, 1)]
    assert G.connect_matches(m, "keep").count() == 5
    with pytest.raises(ValueError):
        G.connect_matches(m, "other")


# -- cameras and models -------------------------------------------------------------------------


def test_point_behind_camera_is_null(spark):
    photo = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "iid long, cid long, cx double, cy double, cz double, " + ", ".join(f"{r} double" for r in C.ROTATION))
    cam = spark.createDataFrame([(1, 100, 100, 50.0, 49.5, 49.5, 0.0, 0.0, 0.0, 0.0, 0.0)], "cid long, width int, height int, f double, u0 double, v0 double, k1 double, k2 double, k3 double, p1 double, p2 double")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, -5.0), (3, 1.0, 0.0, 5.0)], "pid long, x double, y double, z double")
    got = {r.pid: (r.u, r.v) for r in C.project(pts, photo, cam).collect()}
    assert got == {1: (49.5, 49.5), 2: (None, None), 3: (59.5, 49.5)}


def test_affine_inverse_is_identity(spark):
    a = [2.0, 0.3, 5.0, -0.1, 3.0, -7.0]
    x, y = R.to_world(R.invert_affine(a), *R.to_world([F.lit(v) for v in a], F.lit(11.0), F.lit(-4.0)))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert math.isclose(r.x, 11) and math.isclose(r.y, -4)


def _matches(spark, pts):
    return spark.createDataFrame([(0, 1, k, k, *map(float, p)) for k, p in enumerate(pts)], "iid_i long, iid_j long, fid_i long, fid_j long, x1 double, y1 double, x2 double, y2 double")


def test_models_are_recovered(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 1000, (60, 2))
    h = np.array([[1.1, 0.05, 20], [-0.03, 0.95, 10], [1e-5, 2e-5, 1]])
    w = np.c_[xy, np.ones(60)] @ h.T
    m = _matches(spark, np.c_[xy, w[:, :2] / w[:, 2:]])
    hyp = B.fit_minimal(B.sample_hypotheses(m, 4, 16, 1), "homography")
    assert max(np.abs(np.array(r.model) - h.ravel()).max() for r in hyp.collect()) < 1e-3
    assert B.ransac(m, hyp, "homography", 1.0).count() == 60
    aff = np.c_[xy, xy @ np.array([[1.1, 0.1], [-0.2, 0.9]]) + [3, 4]]
    hyp = B.fit_minimal(B.sample_hypotheses(_matches(spark, aff), 3, 8, 1), "affine")
    assert all(np.allclose(r.model, [1.1, -0.2, 3, 0.1, 0.9, 4], atol=1e-5) for r in hyp.collect())
    with pytest.raises(ValueError):
        B.fit_minimal(B.sample_hypotheses(m, 4, 4, 1), "spline")


def test_fundamental_matrix_from_seven_points(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1, 1, (40, 3)) + [0, 0, 5]
    a = p[:, :2] / p[:, 2:]
    c, s = math.cos(0.2), math.sin(0.2)
    q = p @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]) + [0.5, 0.1, 0.2]
    b = q[:, :2] / q[:, 2:]
    m = _matches(spark, np.c_[a, b])
    hyp = B.fit_minimal(B.sample_hypotheses(m, 7, 8, 1), "fundamental")
    scored = B.score(m, hyp, "fundamental").groupBy("draw", "root").agg(F.max("error").alias("e")).groupBy("draw").agg(F.min("e").alias("e")).collect()
    assert scored and max(r.e for r in scored) < 1e-10
    draws = B.sample_hypotheses(m, 7, 8, 1)
    assert draws.groupBy("draw").agg(F.count_distinct("n").alias("n")).filter("n <> 7").count() == 0


def test_a_contrario_rejects_noise_and_keeps_a_model(spark):
    rng = np.random.default_rng(4)
    noise = rng.uniform(0, 1000, (30, 4))
    assert B.ac_ransac(_matches(spark, noise), B.every_translation(_matches(spark, noise)), "translation", 1000, 1000).count() == 0
    good = rng.uniform(0, 900, (30, 2))
    mixed = _matches(spark, np.r_[np.c_[good, good + [12, -7]], noise])
    found = B.ac_ransac(mixed, B.every_translation(mixed), "translation", 1000, 1000)
    assert {r.fid_i for r in found.collect()} >= set(range(30))


def test_homography_through_four_points(spark):
    df = registry.QUERIES["R5_homography4"](spark, DATA).limit(5)
    for r in df.collect():
        assert abs(r.h0 - 1.1) < 1e-6 and abs(r.h4 - 0.9) < 1e-6


def test_patch_normals(spark):
    got = registry.QUERIES["W6_patch_normal"](spark, DATA)
    want = registry.QUERIES["F11_vectors"]  # noqa: F841
    pts = {r.pid: r for r in spark.read.parquet(f"{DATA}/part.parquet").selectExpr("p_partkey as pid", "sin(p_size * 0.02) as nx", "cos(p_size * 0.02) as nz").collect()}
    for r in got.collect():
        assert abs(r.nx - pts[r.pid].nx) < 1e-5 and abs(r.ny) < 1e-5 and abs(r.nz - pts[r.pid].nz) < 1e-5  # rounded to 5 digits


def test_affine_refinement_converges(spark):
    for r in registry.QUERIES["A21_refine_affine"](spark, DATA).collect():
        want = (r.pid % 45 + 8, r.pid * 7 % 45 + 8)
        assert abs(r.x - want[0]) < 0.2 and abs(r.y - want[1]) < 0.2


def test_propagation_finds_the_same_place(spark):
    got = registry.QUERIES["R9_propagate"](spark, DATA)
    wide = got.groupBy("point_id").agg(F.max(F.when(F.col("role") == "ground", F.col("x"))).alias("gx"), F.max(F.when(F.col("role") == "aerials", F.col("x"))).alias("ax"), F.max(F.when(F.col("role") == "ground", F.col("y"))).alias("gy"), F.max(F.when(F.col("role") == "aerials", F.col("y"))).alias("ay"))
    found = wide.collect()
    assert found and all(r.gx == r.ax and r.gy == r.ay for r in found)


# -- rasters ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("rows_", "cols"), [(1, 1), (5, 7), (16, 16), (17, 15)])
def test_tiles_lose_no_pixel(spark, rows_, cols):
    p = R.create_raster(spark, 3, rows_, cols).withColumn("v", F.col("r") * 100.0 + F.col("c"))
    back = L.to_pixels(L.to_tiles(p, 8), 8)
    assert rows(back, "r", "c", "v") == rows(p, "r", "c", "v")


def test_percent_clip_of_a_constant_image(spark):
    p = R.create_raster(spark, 0, 4, 4).withColumn("v", F.lit(7.0))
    r = R.percent_clip(p).first()
    assert (r.lo, r.hi) == (7.0, 7.0)
    assert R.percent_clip(p.withColumn("v", F.lit(None).cast("double"))).filter("lo is not null").count() == 0


def test_stretch_maps_nodata_to_zero(spark):
    p = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, -5.0), (0, 0, 2, 100.0)], "image_id long, r int, c int, v double")
    limits = spark.createDataFrame([(0, 0.0, 50.0)], "image_id long, lo double, hi double")
    assert rows(R.stretch_8u(p, limits), "c", "u8") == [(0, 0), (1, 1), (2, 255)]


def test_pyramid_always_has_level_zero(spark):
    p = R.create_raster(spark, 0, 3, 3, 1.0)
    assert L.build_pyramid(p, 3, 3, 256).select("level").distinct().collect()[0].level == 0


# -- spatial ------------------------------------------------------------------------------------


def test_point_in_polygon_boundaries(spark):
    ring = lambda *p: [dict(x=a, y=b) for a, b in p]
    outer, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))
    polys = spark.createDataFrame([(1, [outer, hole]), (2, [ring((0, 0), (5, 5))])], "poly_id long, rings array<array<struct<x:long,y:long>>>")
    places = {1: (5, 0), 2: (5, 4), 3: (5, 5), 4: (2, 2), 5: (0, 0), 6: (4, 4), 7: (11, 5), 8: (-1, 4)}
    pts = spark.createDataFrame([(k, *v) for k, v in places.items()], "pid long, x long, y long")
    assert rows(X.pip_join(pts, polys, 3)) == [(2, 1), (4, 1), (6, 1)]
    assert rows(X.pip_join(pts, polys, 3, max_cells=1)) == [(2, 1), (4, 1), (6, 1)]


def test_rays(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], "tid long, " + ", ".join(f"{c} double" for c in X.TRI))
    rays = spark.createDataFrame([(1, 0.2, 0.2, 5.0, 0.0, 0.0, -1.0, 0.0, 10.0), (2, 0.2, 0.2, 5.0, 0.0, 0.0, -1.0, 0.0, 4.0), (3, 0.2, 0.2, 5.0, 1.0, 0.0, 0.0, 0.0, 9.0), (4, 0.5, 0.5, 5.0, 0.0, 0.0, -1.0, 0.0, 9.0), (5, 0.2, 0.2, 5.0, 0.0, 0.0, -1.0, 4.5, 9.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tnear double, tfar double")
    assert rows(X.ray_hits(rays, tri, 0.7), "ray_id", "tid", "t") == [(1, 2, 4.0), (2, 2, 4.0), (4, 2, 4.0), (5, 1, 5.0)]
    assert rows(X.occluded(rays, tri, 0.7), "ray_id") == [(1,), (2,), (4,), (5,)]


def test_subdivision_shares_edges(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 4.0, 4.0, 0.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "tid long, v0 long, v1 long, v2 long")
    vs, ts = X.subdivide(v, t, 2.5, 1)
    assert vs.count() == 9 and ts.count() == 8 and ts.select("tid").distinct().count() == 8


# -- files and strings --------------------------------------------------------------------------


def test_binary_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 5
    kp = np.zeros(n, files.KEYPOINT)
    for f in ("x", "y", "size", "angle", "response"):
        kp[f] = rng.uniform(0, 9, n)
    desc = rng.integers(0, 256, (n, 128)).astype(np.uint8)
    for d in ("sift", "feat", "match", "bad"):
        (tmp_path / d).mkdir()
    (tmp_path / "sift/a.sift").write_bytes(np.int32(n).tobytes() + kp.tobytes() + desc.tobytes())
    (tmp_path / "sift/b.sift").write_bytes(np.int32(0).tobytes())
    got = files.load_sift_dir(spark, f"{tmp_path}/sift").orderBy("fid").collect()
    assert len(got) == n and got[3].desc == desc[3].tolist() and abs(got[2].x - float(kp["x"][2])) < 1e-6
    (tmp_path / "feat/a").write_bytes(np.int32([2, 0]).tobytes() + np.float32([1, 2, 3, 4]).tobytes())
    assert [(r.x, r.y, r.desc) for r in files.load_feature_dir(spark, f"{tmp_path}/feat").orderBy("fid").collect()] == [(1, 2, None), (3, 4, None)]
    (tmp_path / "match/a").write_bytes(np.int32(2).tobytes() + np.uint32([1, 2, 3, 4]).tobytes())
    assert rows(files.load_match_dir(spark, f"{tmp_path}/match"), "fid_i", "fid_j", "dist") == [(1, 2, None), (3, 4, None)]
    (tmp_path / "bad/a").write_bytes(np.int32(9).tobytes())
    with pytest.raises(Exception, match="cut short"):
        files.load_match_dir(spark, f"{tmp_path}/bad").collect()


def test_names(spark):
    df = spark.createDataFrame([("/a/b/a.b.jpg",), ("/a/b/",), ("x\\y\\Z.TIF",), ("plain",)], "p string")
    p = F.col("p")
    assert rows(df.select(S.base_name(p).alias("b"), S.extension(p).alias("e"))) == sorted([("a", ".jpg"), ("", ""), ("Z", ".TIF"), ("plain", "")])
    assert df.filter(S.has_extension(p, ".tif")).count() == 1


def test_csv_values(spark):
    df = spark.createDataFrame([(0, "1, 2;3"), (1, ",,"), (2, "1,x"), (3, None)], "n int, s string")
    assert [r.v for r in df.orderBy("n").select(S.csv_values(F.col("s")).alias("v")).collect()] == [[1.0, 2.0, 3.0], [], [], []]


# -- plans --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["J1_knn_join", "J6_radius_join", "J13_pip_join", "J15_ray_hits", "W2_crossing_filter", "W8_assign_oid", "A6_percentile_nearest"])
def test_no_cartesian_product_and_no_global_window(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "SinglePartition" not in plan or "Window" not in plan.split("SinglePartition")[0].splitlines()[-1]


def test_json_is_valid(spark, tmp_path):
    from orthoweave.sources.files import write_polygons

    polys = spark.createDataFrame([(1, [[dict(x=0, y=0), dict(x=1, y=0), dict(x=1, y=1)]])], "poly_id long, rings array<array<struct<x:long,y:long>>>")
    write_polygons(polys, f"{tmp_path}/p")
    line = next(x for f in (tmp_path / "p").glob("part-*") for x in f.read_text().splitlines())
    assert len(json.loads(line)["geometry"]["coordinates"][0]) == 4


def test_bilinear_values_of_repeated_points(spark):
    from orthoweave.operators.raster import sample_bilinear

    pixels = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "image_id long, r int, c int, v double")
    points = spark.createDataFrame([(1, 0, 0.5, 0.5)] * 3 + [(1, 0, 1.0, 1.0), (2, 0, 5.0, 5.0)], "pid long, image_id long, px double, py double")
    got = sorted(tuple(r) for r in sample_bilinear(points, pixels, ["pid"]).collect())
    assert got == [(1, 5.5), (1, 5.5), (1, 5.5), (1, 11.0), (2, 22.0)]


def test_reserved_draws_and_factorials(spark):
    import math

    from pyspark.sql import functions as F

    from orthoweave.operators import robust

    n = [0, 1, 2, 15, 16, 40, 4000]
    got = spark.createDataFrame([(k,) for k in n], "n long").select("n", robust.log10_factorial(F.col("n")).alias("v")).collect()
    assert all(abs(r.v - math.lgamma(r.n + 1) / math.log(10)) < 1e-9 for r in got)
    rows = [(1, 2, k, k, float(7 * k % 400), float(13 * k % 300), float(7 * k % 400) + (20.0 if k % 3 else 91.0 * k % 70), float(13 * k % 300) - (10.0 if k % 3 else 57.0 * k % 60)) for k in range(90)]
    matches = spark.createDataFrame(rows, "iid_i long, iid_j long, fid_i long, fid_j long, x1 double, y1 double, x2 double, y2 double")
    kept = {r.fid_i for r in robust.ac_ransac_reserved(matches, "homography", 400, 300, draws=200).collect()}
    assert {k for k in range(90) if k % 3} <= kept and len(kept) <= 66
