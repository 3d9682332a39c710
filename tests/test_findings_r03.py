"""Small tests of the findings of round 3: work in bounded pieces, spread over tasks."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orthoweave.operators import knn as K
from orthoweave.operators import robust as B
from orthoweave.operators import spatial as X
from orthoweave.operators import tiles as L
from orthoweave.sources import blocks


def test_point_sets_are_read_from_arrow_columns():
    point = lambda k: {"y1": k + 1.0, "x1": float(k), "x2": k + 2.0, "y2": None if k == 3 else k + 3.0}
    lists = pa.array([[point(0)], None, [point(1), point(2)], [], [point(3)], [point(4)]]).slice(1)
    got = {n: (places.tolist(), sets) for n, places, sets in B._stacks(lists)}
    assert set(got) == {0, 1, 2} and got[0][0] == [0, 2] and got[1][0] == [3, 4] and got[2][0] == [1]
    assert np.array_equal(got[2][1], [[[1, 2, 3, 4], [2, 3, 4, 5]]]) and np.isnan(got[1][1][0, 0, 3]) and got[1][1][1, 0].tolist() == [4, 5, 6, 7]


def test_used_vertices_are_kept_in_as_many_tasks_as_a_shuffle_has(spark):
    v = spark.range(1000).coalesce(1).select(F.col("id").alias("vid"), *(F.lit(0.0).alias(c) for c in "xyz"))
    t = spark.range(300).coalesce(1).select(F.col("id").alias("tid"), *((F.col("id") * 3 + k).alias(f"v{k}") for k in range(3)))
    kept = X.drop_isolated(v, t)
    assert sorted(r.vid for r in kept.select("vid").collect()) == list(range(900))
    assert kept.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tie_points_are_written_to_files_of_bounded_size(spark, tmp_path):
    t = spark.range(40).coalesce(1).select(F.col("id").alias("point_id"), F.lit("ground").alias("role"), F.lit(1).cast("long").alias("iid"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    blocks.write_tie_points_xml(t, str(tmp_path / "xml"), per_file=5)
    files = [f for f in os.listdir(tmp_path / "xml") if f.startswith("part-")]
    assert len(files) >= 8 and max((tmp_path / "xml" / f).read_text().count("<Id>") for f in files) <= 5


@pytest.mark.parametrize("few", [1, 1 << 20])
def test_tiles_are_made_a_few_at_a_time(spark, monkeypatch, few):
    monkeypatch.setattr(L, "_PIXELS", few)
    p = spark.range(2000).select(F.lit(1).cast("long").alias("image_id"), F.floor(F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"), F.lit(0).alias("band"), F.col("id").cast("double").alias("v"))
    assert sorted(r.v for r in L.to_pixels(L.to_tiles(p, 8), 8).select("v").collect()) == [float(k) for k in range(2000)]


@pytest.mark.parametrize("metric", ["l2sq", "angle"])
def test_mutual_join_equals_two_joins(spark, metric):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    f = spark.createDataFrame([(k % 3, k, v[k % 120].tolist()) for k in range(150)], "iid long, fid long, vec array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "iid_i long, iid_j long")
    back = pairs.select(F.col("iid_j").alias("iid_i"), F.col("iid_i").alias("iid_j"))
    columns = ["iid_i", "fid_i", "iid_j", "fid_j", "dist"]
    want = K.mutual_best(K.knn_join(f, pairs, 1, metric), K.knn_join(f, back, 1, metric)).select(*columns)
    got = K.mutual_join(f, pairs, metric, block=16).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_stencil_runs_over_batches_of_tiles(spark):
    p = spark.range(400).select(F.lit(1).cast("long").alias("image_id"), F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    made = L.halved(p, 20, 20, tile=6)
    assert "CoGroup" not in made._jdf.queryExecution().executedPlan().toString()
    whole = {(r.r, r.c): r.v for r in L.halved(p, 20, 20, tile=64).collect()}
    assert {(r.r, r.c): r.v for r in made.collect()} == whole and len(whole) == 100


@pytest.mark.parametrize("block", [2, 4096])
def test_radius_join_lets_cells_meet(spark, block):
    rng = np.random.default_rng(5)
    points = [(int(k % 2), int(k), float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-60, 60, (160, 2)) / 2)] + [(0, 1000 + k, 1.5, 1.5) for k in range(9)] + [(1, 2000, None, 1.0), (None, 2001, 1.0, 1.0)]
    f = spark.createDataFrame(points, "iid long, fid long, x double, y double")
    made = K.radius_join(f, f, 5.0, block=block)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    known = [p for p in points if None not in p]
    want = sorted((a[0], a[1], b[1], (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) for a in known for b in known if a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 25)
    assert sorted(map(tuple, made.collect())) == want


def _subdivided(points, triangles, max_len, rounds):
    """Corner coordinates of the parts, and the number of vertices told apart by the edges that they halve."""
    known, tri = dict(points), [tuple(t) for t in triangles]
    for _ in range(rounds):
        out = []
        for t in tri:
            p = [np.array(known[v]) for v in t]
            if np.linalg.norm(np.cross(p[1] - p[0], p[2] - p[0])) / 2 <= max_len * max_len / 2:
                out.append(t)
                continue
            m = []
            for a, b in ((0, 1), (1, 2), (2, 0)):
                name = frozenset((t[a], t[b]))
                known[name] = tuple((p[a] + p[b]) / 2)
                m.append(name)
            out += [(t[0], m[0], m[2]), (m[0], t[1], m[1]), (m[2], m[1], t[2]), (m[0], m[1], m[2])]
        tri = out
    return sorted(tuple(float(x) for v in t for x in known[v]) for t in tri), len(known)


@pytest.mark.parametrize("rounds", [0, 2, 5, 7])
def test_subdivision_meets_given_triangles_once(spark, rounds):
    from orthoweave.session import staging

    # two triangles share an edge and are split unevenly, a third is the back of the first, a fourth is small
    points = {9: (0.0, 0.0, 0.0), 4: (32.0, 0.0, 1.0), 7: (0.0, 32.0, 2.0), 12: (40.0, 40.0, 30.0), 2: (33.0, 0.5, 1.0), 5: (7.0, 7.0, 7.0)}
    triangles = [(9, 4, 7), (4, 12, 7), (9, 7, 4), (4, 2, 9)]
    size = 6.0 if rounds < 7 else 0.7
    v = spark.createDataFrame([(k, *p) for k, p in points.items()], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(3 * n - 2, *c) for n, c in enumerate(triangles)], "tid long, v0 long, v1 long, v2 long")
    with staging() as paths:
        vs, ts = X.subdivide(v, t, size, rounds, with_corners=True)
    assert len(paths) <= {0: 0, 2: 1, 5: 1, 7: 4}[rounds]
    parts, at = ts.collect(), {r.vid: (r.x, r.y, r.z) for r in vs.collect()}
    want, known = _subdivided(points, triangles, size, rounds)
    assert sorted(tuple(r[c] for c in X.TRI) for r in parts) == want
    assert len(at) == known == vs.count() and len({r.tid for r in parts}) == len(parts)
    assert all(at[r.v0] + at[r.v1] + at[r.v2] == tuple(r[c] for c in X.TRI) for r in parts)
