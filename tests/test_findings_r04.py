"""Small tests of the findings of round 4: what is sent between tasks, and results as before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.operators import knn as K


@pytest.mark.parametrize("probes", [1, 3, 6])
def test_vectors_are_not_sent_once_a_cell(spark, probes):
    """F1 F8: the cells that a feature probes are found where blocks meet."""
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, (120, 5)).astype(float)
    f = spark.createDataFrame([*((k % 2, k, v[k].tolist()) for k in range(120)), (1, 999, None)], "iid long, fid long, vec array<float>")
    pairs = spark.createDataFrame([(0, 1), (0, 7)], "iid_i long, iid_j long")
    index = K.Cells(v[[3, 10, 27, 44, 61, 99]] + 0.01, probes, 1.0)
    found = K.ann_join(f, pairs, 2, index=index)
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    near, want = index.nearest(v), []
    for i in range(0, 120, 2):
        inside = [j for j in range(1, 120, 2) if near[j, 0] in near[i, :probes]]
        want += [(0, i, 1, j, d, n + 1) for n, (d, j) in enumerate(sorted((float(((v[i] - v[j]) ** 2).sum()), j) for j in inside)[:2])]
    assert sorted(tuple(r) for r in found.select("iid_i", "fid_i", "iid_j", "fid_j", "dist", "rank").collect()) == sorted(want)


def _bilinear(image, x, y):
    """Value of a dict of cells, None where a cell with weight is missing."""
    r, c, total = int(np.floor(y)), int(np.floor(x)), 0.0
    for dr, dc, w in ((0, 0, (1 - x + c) * (1 - y + r)), (0, 1, (x - c) * (1 - y + r)), (1, 0, (1 - x + c) * (y - r)), (1, 1, (x - c) * (y - r))):
        if w > 0:
            if image.get((r + dr, c + dc)) is None:
                return None
            total += w * image[r + dr, c + dc]
    return total


@pytest.mark.parametrize("border", [True, False])
def test_points_are_sent_once_to_be_sampled(spark, border):
    """a point meets a tile of pixels, not four rows of cells that are put together again."""
    from orthoweave.operators.raster import sample_bilinear

    image = {(r, c): None if (r, c) == (5, 5) else float(r * 37 % 11 + c * c % 7) for r in range(13) for c in range(10) if (r, c) != (8, 2)}
    pixels = spark.createDataFrame([(3, r, c, v) for (r, c), v in image.items()], "image_id long, r int, c int, v double")
    rng = np.random.default_rng(2)
    at = [(float(x), float(y)) for x, y in [*rng.integers(-8, 60, (150, 2)) / 4, (9.0, 12.0), (8.0, 11.5), (3.5, 4.0), (4.0, 7.25)]]
    points = spark.createDataFrame([(k, 3, *p) for k, p in enumerate(at)], "pid long, image_id long, px double, py double")
    got = sample_bilinear(points, pixels, ["pid"], border=border, tile=4)
    assert "keys=[keep" not in got._jdf.queryExecution().executedPlan().toString()
    clipped = [(min(max(x, 0.0), 9.0), min(max(y, 0.0), 12.0)) if border else (x, y) for x, y in at]
    want = {k: _bilinear(image, *p) for k, p in enumerate(clipped)}
    assert {r.pid: r.v for r in got.collect()} == pytest.approx(want) and got.count() == len(at)


@pytest.mark.parametrize(("tile", "reach"), [(256, 17), (8, 6)])
def test_patches_are_refined_beside_their_tile(spark, monkeypatch, tile, reach):
    """All steps of a patch run in one task; a patch that leaves the window goes on beside another, a large one by rows."""
    from orthoweave.operators import patches as P
    from orthoweave.session import staging

    monkeypatch.setattr(P, "_TILE", tile)
    monkeypatch.setattr(P, "_reach", lambda size: reach)
    value = lambda r, c: 100 + 40 * np.sin(0.31 * r + 0.02 * c) + 30 * np.cos(0.27 * c)
    pixels = spark.createDataFrame([(1, r, c, float(value(r, c))) for r in range(48) for c in range(48)], "image_id long, r int, c int, v double")
    # begins beside the place, far beside it, thrice as large, in no image, and at the edge
    places = [(1, 1, 20.0, 22.0, [1.0, 0.0, 20.4, 0.0, 1.0, 21.7]), (2, 1, 23.0, 24.0, [1.0, 0.0, 25.5, 0.0, 1.0, 22.0]), (3, 1, 24.0, 20.0, [3.0, 0.0, 24.0, 0.0, 3.0, 20.0]), (4, 9, 20.0, 20.0, [1.0, 0.0, 20.0, 0.0, 1.0, 20.0]), (5, 1, 2.0, 20.0, [1.0, 0.0, 2.0, 0.0, 1.0, 20.0])]
    points = spark.createDataFrame(places, "pid long, image_id long, x double, y double, a array<double>")
    with staging() as paths:
        squares = {r.pid: r for r in P.refine_places(points, pixels, 9).collect()}
    if tile > 48:
        assert len(paths) == 2  # the tiles and one state; every step wrote one before
    rows = points.filter("pid < 4").join(pixels, "image_id").filter("abs(r - y) <= 4 and abs(c - x) <= 4").select("pid", "image_id", (F.col("c") - F.col("x")).alias("x"), (F.col("r") - F.col("y")).alias("y"), "v")
    listed = {r.pid: r for r in P.refine_affine(rows, pixels, points.select("pid", "a")).collect()}
    assert set(squares) == set(listed) == {1, 2, 3, 4, 5}
    for pid in squares:
        assert squares[pid].a == pytest.approx(listed[pid].a, abs=1e-9) and squares[pid].rms == pytest.approx(listed[pid].rms, abs=1e-9) and squares[pid].settled == listed[pid].settled
    assert squares[1].settled and squares[1].a[2] == pytest.approx(20, abs=0.1) and squares[1].a[5] == pytest.approx(22, abs=0.1)
    assert squares[4].rms is None and squares[5].rms is None and not squares[4].settled and squares[4].a == places[3][4]


@pytest.mark.parametrize("tile", [256, 4])
def test_patches_are_cut_beside_their_tile(spark, monkeypatch, tile):
    """A patch is one row beside a window of pixels, not a row a sample that meets four cells."""
    from orthoweave.operators import patches as P

    monkeypatch.setattr(P, "_TILE", tile)
    image = {(r, c): float(r * 37 % 11 + c * c % 7) for r in range(14) for c in range(11) if (r, c) != (12, 9)}
    pixels = spark.createDataFrame([(3, r, c, v) for (r, c), v in image.items()], "image_id long, r int, c int, v double")
    at = [(x / 2, y / 4) for x in range(-2, 24) for y in range(0, 56, 3)]
    points = spark.createDataFrame([*((k, 3, *p) for k, p in enumerate(at)), (9000, 4, 5.0, 5.0), (9001, None, 5.0, 5.0), (9002, 3, None, 5.0)], "pid long, image_id long, x double, y double")
    made = P.extract_patch(points, pixels, 3)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, (x, y) in enumerate(at):
        cells = {(k, dr, dc): _bilinear(image, x + dc, y + dr) for dr in (-1, 0, 1) for dc in (-1, 0, 1)}
        want |= cells if None not in cells.values() else {}
    got = made.collect()
    assert {(r.pid, r.dr, r.dc): r.v for r in got} == pytest.approx(want) and len(got) == len(want) > 500
    targets = points.filter("pid < 9000").select("pid", F.lit(3).cast("long").alias("target_id"), F.col("x").alias("px"), (F.col("y") + 1).alias("py"))
    found = P.propagate(points, pixels, targets, 3, 3).filter("role = 'aerials'").collect()
    assert found and all((r.x, r.y) == at[r.point_id] for r in found if r.point_id % 4 == 0 and at[r.point_id][1] == int(at[r.point_id][1]))


def test_photos_are_warped_beside_their_tile(spark, monkeypatch):
    """a warped patch and its correlation are one row; a patch that leaves the window of its tile is sampled by rows."""
    from orthoweave.operators import patches as P
    from orthoweave.operators import tiles as L

    pixels = spark.createDataFrame([(3, r, c, float(r * 37 % 11 + c * c % 7)) for r in range(40) for c in range(40) if (r, c) != (30, 30)], "image_id long, r int, c int, v double")
    rng = np.random.default_rng(6)
    models = [[float(v) for v in (s, 0.02, x, -0.01, s, y, 1e-4, -2e-4, 1.0)] for s, x, y in [*((1.0, *rng.uniform(-2, 33, 2)) for _ in range(40)), *((4.0, *rng.uniform(-2, 9, 2)) for _ in range(20)), (1.0, -0.4, 5.0)]]
    solved = spark.createDataFrame([(k, k % 5, 3 if k else 4, m) for k, m in enumerate(models)], "key long, pid long, iid long, model array<double>")
    templates = spark.createDataFrame([(k, rng.uniform(0, 9, 9).tolist()) for k in range(5)], "pid long, template array<double>")
    found = []
    for tile, halo in ((256, 14), (8, 7)):
        monkeypatch.setattr(P, "_TILE", tile)
        made = P.warped_places(solved, templates, pixels, L.windows(pixels, tile, halo), 7, halo, keep=True)
        found.append({r.key: (r.r, r.c, r.score, r.patch) for r in made.collect()})
    image = {(r.r, r.c): r.v for r in pixels.collect()}
    want = {}
    for k, m in enumerate(models[1:], 1):
        at = [(m[0] * c + m[1] * r + m[2], m[3] * c + m[4] * r + m[5], m[6] * c + m[7] * r + m[8]) for r in range(7) for c in range(7)]
        v = [_bilinear(image, x / w, y / w) for x, y, w in at]
        want |= {} if None in v else {k: v}
    assert set(found[0]) == set(found[1]) == set(want) and sum(k > 40 for k in want) > 3
    for k in want:
        assert found[0][k][:2] == found[1][k][:2] and found[0][k][2] == pytest.approx(found[1][k][2]) and found[0][k][3] == pytest.approx(want[k]) and found[1][k][3] == pytest.approx(want[k])


@pytest.mark.parametrize("residuals", [3, 1 << 20])
def test_shifts_meet_the_displacements_near_them(spark, monkeypatch, residuals):
    """Equal shifts are judged once, and a shift with the displacements within the threshold, not with all matches."""
    from orthoweave.operators import robust as B

    monkeypatch.setattr(B, "_RESIDUALS", residuals)
    rng = np.random.default_rng(11)
    shifts, moved = rng.integers(-40, 40, (30, 2)) / 2, rng.integers(-40, 40, (50, 2)) / 2
    got = [(first + o, a, e) for first, _, owner, at, es in B._near_shifts(shifts, moved, 2.5) for o, a, e in zip(owner.tolist(), at.tolist(), es.tolist(), strict=True)]
    every = ((moved[None] - shifts[:, None]) ** 2).sum(2)
    assert {(o, a): e for o, a, e in got} == {(o, a): every[o, a] for o, a in zip(*np.nonzero(every <= 6.25), strict=True)}
    assert [(o, e) for o, _, e in got] == sorted((o, e) for o, _, e in got)
    rows = [(i, i + 1, k, k, float(x), float(y), float(x + (7 + k % 3 if k % 4 else rng.integers(-90, 90))), float(y - (3 if k % 4 else rng.integers(-90, 90)))) for i in range(4) for k, (x, y) in enumerate(rng.integers(0, 400, (40, 2)))]
    rows += [(0, 1, 90, 90, None, 1.0, 2.0, 3.0), (7, 8, 1, 1, 0.0, 0.0, 5.0, 5.0), (8, 9, 1, 1, None, 0.0, 5.0, 5.0)]
    m = spark.createDataFrame(rows, "iid_i long, iid_j long, fid_i long, fid_j long, x1 double, y1 double, x2 double, y2 double")
    h = B.every_translation(m)
    key = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    beside = key(B.ac_ransac(m, h, "translation", 400, 300)), key(B.ransac(m, h, "translation", 2.0))
    monkeypatch.setattr(B, "_MATCHES", 0)  # every pair goes row by row
    assert (key(B.ac_ransac(m, h, "translation", 400, 300)), key(B.ransac(m, h, "translation", 2.0))) == beside and len(beside[0]) >= 4 * 10


def test_pairs_of_many_matches_are_judged_in_tasks(spark):
    """A pair of 200,000 matches is 6 MB; row by row it would be a row for each match and each hypothesis."""
    from orthoweave.operators import robust as B

    m = spark.range(200_000).select(F.lit(1).cast("long").alias("iid_i"), F.lit(2).cast("long").alias("iid_j"), F.col("id").alias("fid_i"), F.col("id").alias("fid_j"))
    few, many = B._by_size(m)
    assert few.count() == 200_000 and many.isEmpty()


@pytest.mark.parametrize("name", ["R3_ac_ransac_homography", "R3_ac_ransac_fundamental", "R3_ac_ransac_translation", "R4_ransac_translation"])
def test_matches_are_made_once(spark, name):
    """The join that makes the matches is written, and not made again for each of its uses."""
    from orthoweave.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


@pytest.mark.parametrize("block", [4, 32768])
def test_neighbours_are_ranked_where_they_are_met(spark, monkeypatch, block):
    """A tile of one block ranks its points' neighbours itself; only what a filter needs of them is written."""
    from orthoweave.operators import matches as M

    rng = np.random.default_rng(8)
    p = [(1, 2, k, k, *map(float, xy)) for k, xy in enumerate(rng.integers(0, 30, (60, 4)))]
    m = spark.createDataFrame(p, "iid_i long, iid_j long, fid_i long, fid_j long, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(K._nearest_in_tiles, "__defaults__", (4096, block))
    near = K.spatial_knn(m, 4, carry=("x1", "x2"), give={"apart": F.abs(F.col("x2") - F.col("nx2"))}, only=F.col("nkey") != F.col("fid_i"))
    if block > 60:
        assert "Window" not in near._jdf.queryExecution().executedPlan().toString()
    want = []
    for a in p:
        order = sorted(p, key=lambda b: ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2, b[2] != a[2], b[2]))[:4]
        want += [(1, 2, a[2], b[2], (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2, n + 1, abs(a[6] - b[6])) for n, b in enumerate(order) if b[2] != a[2]]
    assert sorted(map(tuple, near.collect())) == sorted(want)
    assert {r.fid_i for r in M.orientation_filter(m, 4).collect()} == {a[2] for a in p if sum((a[6] - a[4]) * (p[w[3]][6] - p[w[3]][4]) + (a[7] - a[5]) * (p[w[3]][7] - p[w[3]][5]) for w in want if w[2] == a[2]) > 0}
