"""Queries for cameras, residuals and robust fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cameras as C
from ..operators import robust as R
from ..operators import visibility as V
from ..session import stage
from .base import query

R6 = lambda c, n=None: F.round(c, 6).alias(n or "v")
_DIM = "x1, y1, x2, y2"

# -- cameras ------------------------------------------------------------------------------------


@query("S3_normalize_cameras", """select cid, round(case when cid % 2 = 0 then f else (20.0 + cid) / (36.0 / 4000) end, 6) as f, round(case when cid % 3 = 0 then 1999.5 else u0 + 1 end, 6) as u0, 1499.5 as v0,
    case when cid % 4 = 0 then 0.0 else k1 end as k1, k3 from {v_cameras}""")
def _(i):
    odd = lambda c, m, v: F.when(F.col("cid") % m == 0, F.lit(None).cast("double")).otherwise(v).alias(c)
    cams = i.v_cameras.select("cid", "width", "height", F.when(F.col("cid") % 2 == 0, F.col("f")).alias("f"), (F.lit(20.0) + F.col("cid")).alias("f_mm"), F.lit(36.0).alias("sensor_mm"), odd("u0", 3, F.col("u0") + 1), F.lit(None).cast("double").alias("v0"), odd("k1", 4, F.col("k1")), "k2", F.lit(None).cast("double").alias("k3"), "p1", "p2")
    return C.normalize_cameras(cams).select("cid", R6(F.col("f"), "f"), R6(F.col("u0"), "u0"), "v0", "k1", "k3")


_O = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in C.ORIENTATIONS.items())


@query("S4_apply_orientation", f"""with o(name, o00, o01, o02, o10, o11, o12, o20, o21, o22) as (values {_O}), n as (select name, row_number() over (order by name) - 1 as k from o),
    p as (select p.*, o.* from {{v_photos}} as p join n on p.cid % 8 = n.k join o on o.name = n.name)
    select iid, """ + ", ".join(f"round(o{i}0 * r0{j} + o{i}1 * r1{j} + o{i}2 * r2{j}, 6) as r{i}{j}" for i in range(3) for j in range(3)) + " from p")
def _(i):
    names = i.spark.createDataFrame(list(enumerate(sorted(C.ORIENTATIONS))), "k long, orientation string")
    cams = i.v_cameras.join(names, F.col("cid") % 8 == F.col("k"))
    return C.apply_orientation(i.v_photos, cams).select("iid", *(R6(F.col(c) + 0.0, c) for c in C.ROTATION))


_XC = [f"(r{k}0 * (x - cx) + r{k}1 * (y - cy) + r{k}2 * (z - cz))" for k in range(3)]
_PROJ = f"""proj as (select *, xn * kd + 2 * p1 * xn * yn + p2 * (r2 + 2 * xn * xn) as xd, yn * kd + p1 * (r2 + 2 * yn * yn) + 2 * p2 * xn * yn as yd from (select *, 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2 as kd
    from (select *, xn * xn + yn * yn as r2 from (select p.pid, iid, width, height, f, u0, v0, k1, k2, k3, p1, p2, x, y, z, nx, ny, nz, cx, cy, cz, {_XC[0]} / case when {_XC[2]} > 0 then {_XC[2]} end as xn, {_XC[1]} / case when {_XC[2]} > 0 then {_XC[2]} end as yn
    from {{v_points3d}} as p, {{v_photos}} as h join {{v_cameras}} as c on h.cid = c.cid))))"""


@query("P11_project", f"with {_PROJ} select pid, iid, round(f * xd + u0, 4) as u, round(f * yd + v0, 4) as v from proj")
def _(i):
    return C.project(i.v_points3d, i.v_photos, i.v_cameras).select("pid", "iid", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


_P = [1000.0, 10.0, 500.0, 3.0, -5.0, 990.0, 400.0, 7.0, 0.01, 0.02, 1.0, 60.0]


@query("P12_project_p", "select pid, round((1000 * x + 10 * y + 500 * z + 3) / (0.01 * x + 0.02 * y + z + 60), 6) as u, round((-5 * x + 990 * y + 400 * z + 7) / (0.01 * x + 0.02 * y + z + 60), 6) as v from {v_points3d}")
def _(i):
    return C.project_p(i.v_points3d, _P).select("pid", R6(F.col("u"), "u"), R6(F.col("v"), "v"))


# an axis-angle about z only: R is known in closed form
@query("P13_frame_camera", """with c as (select iid, cx, cy, cz, iid * 0.01 as a, 3000.0 as f from {v_photos}), r as (select *, cos(a) as ca, sin(a) as sa from c)
    select iid, round(f * ca + 0, 6) as p00, round(f * sa, 6) as p01, round(-1999.5, 6) as p02, round(-(f * ca * cx + f * sa * cy - 1999.5 * cz), 6) as p03,
    round(f * sa, 6) as p10, round(-f * ca, 6) as p11, round(-(f * sa * cx - f * ca * cy - 1499.5 * cz), 6) as p13 from r""")
def _(i):
    d = i.v_photos.select("iid", "cx", "cy", "cz", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), (F.col("iid") * 0.01).alias("az"), F.lit(3.0).alias("f"), F.lit(0.001).alias("delta"), F.lit(4000).alias("width"), F.lit(3000).alias("height"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))
    p = F.col("p")
    return C.frame_camera(d).select("iid", *(R6(p[k], n) for k, n in ((0, "p00"), (1, "p01"), (2, "p02"), (3, "p03"), (4, "p10"), (5, "p11"), (7, "p13"))))


@query("P14_view_params", """select iid, r20 as dx, r21 as dy, r22 as dz, round(cx + r20 * 30, 6) as tx, round(cy + r21 * 30, 6) as ty, round(cz + r22 * 30, 6) as tz, round(-r10, 6) as ux, round(-r11, 6) as uy, round(-r12, 6) + 0.0 as uz, round(2 * atan2(1500.0, f), 6) as fov
    from {v_photos} as p join {v_cameras} as c on p.cid = c.cid""")
def _(i):
    v = C.view_params(i.v_photos.withColumn("zmed", F.lit(30.0)), i.v_cameras)
    return v.select("iid", "dx", "dy", "dz", *(R6(F.col(c) + 0.0, c) for c in ("tx", "ty", "tz", "ux", "uy", "uz")), R6(F.col("fov_y"), "fov"))


@query("P15_depth_to_xyz", """select image_id, r, c, round(case when abs(d - 1) > 1e-4 then (2.0 * (2 * (c + 0.5) / 64 - 1) + 1) / (0.5 * (2 * d - 1) + 2) end, 6) as x, round(case when abs(d - 1) > 1e-4 then (3.0 * (1 - 2 * (r + 0.5) / 64)) / (0.5 * (2 * d - 1) + 2) end, 6) as y,
    round(case when abs(d - 1) > 1e-4 then (2 * d - 1) / (0.5 * (2 * d - 1) + 2) end, 6) as z from (select image_id, r, c, case when n % 5 = 0 then 1.0 else dsm / 60.0 end as d from {v_pixels})""")
def _(i):
    m = [2, 0, 0, 1, 0, 3, 0, 0, 0, 0, 1, 0, 0, 0, 0.5, 2]
    mats = i.v_pixels.select("image_id").distinct().select("image_id", *(F.lit(float(x)).alias(f"m{k}") for k, x in enumerate(m)))
    px = i.v_pixels.select("image_id", "r", "c", F.when(F.col("n") % 5 == 0, 1.0).otherwise(F.col("dsm") / 60.0).alias("depth"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    return C.depth_to_xyz(px, mats).select("image_id", "r", "c", *(R6(F.col(k), k) for k in "xyz"))


@query("P16_undistort_block", "select iid, p.cid, 1999.5 as u0, 1499.5 as v0, 0.0 as k1, 'out/img' || iid::varchar || '.jpg' as path from {v_photos} as p join {v_cameras} as c on p.cid = c.cid")
def _(i):
    photos = i.v_photos.withColumn("path", F.concat(F.lit("/a/img"), F.col("iid").cast("string"), F.lit(".x.png")))
    c, p = C.undistort_block(i.v_cameras, photos, "out/")
    return p.join(c, "cid").select("iid", "cid", "u0", "v0", "k1", "path")


@query("P19_bbox_contains", "select pid from {v_points3d} where x >= -10 and x <= 20 and y >= -20 and y <= 15")
def _(i):
    return i.v_points3d.filter(C.bbox_contains(F.col("x"), F.col("y"), -10, -20, 20, 15)).select("pid")


_FLIP = "case when (5 - x) * nx + (7 - y) * ny + (-3 - z) * nz < 0 then -1 else 1 end"


@query("P20_orient_normal", f"select pid, round(nx * {_FLIP}, 6) as nx, round(nz * {_FLIP}, 6) as nz from {{v_points3d}}")
def _(i):
    d = i.v_points3d.withColumns({"cx": F.lit(5.0), "cy": F.lit(7.0), "cz": F.lit(-3.0)})
    return C.orient_normal(d).select("pid", R6(F.col("nx"), "nx"), R6(F.col("nz"), "nz"))


_VIS = "((cx - x) * nx + (cy - y) * ny + (cz - z) * nz) >= cos(radians(60)) * sqrt((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2)"


@query("J7_visible_cameras", f"select pid, iid from {{v_points3d}}, {{v_photos}} where {_VIS}")
def _(i):
    return V.visible_cameras(i.v_points3d, i.v_photos)


@query("J9_not_own", f"select pid, iid from {{v_points3d}}, {{v_photos}} where iid <> pid % 10 + 1 and {_VIS}")
def _(i):
    return V.visible_cameras(i.v_points3d.withColumn("own", F.col("pid") % 10 + 1), i.v_photos, 60.0, "own")


@query("J8_in_frame", f"""with k as (select pid, pid * 4 + q as cid4, x + (q % 2) * 0.5 as x, y + (q // 2) * 0.5 as y, z from {{v_points3d}}, (select unnest(range(4)) as q)),
    v as (select pid, iid from {{v_points3d}}, {{v_photos}} where {_VIS}), {_PROJ.replace("{v_points3d} as p", "(select k.*, 0.0 as nx, 0.0 as ny, 1.0 as nz from k) as p")}
    select pid, iid from proj semi join v using (pid, iid) group by pid, iid having bool_and(coalesce(f * xd + u0 between 0 and width - 1 and f * yd + v0 between 0 and height - 1, false))""")
def _(i):
    q = F.explode(F.sequence(F.lit(0), F.lit(3)))
    k = i.v_points3d.select("pid", q.alias("corner"), "x", "y", "z").withColumn("x", F.col("x") + F.col("corner") % 2 * 0.5).withColumn("y", F.col("y") + F.floor(F.col("corner") / 2) * 0.5)
    return V.visible_in_frame(i.v_points3d, k, i.v_photos, i.v_cameras)


@query("J10_reconcile_names", "select page_id, (select min(m.page_id) from {v_names} as m where m.page_id % 3 <> 0 and m.page_id % 50 = v_names.page_id % 50) as merged_iid from {v_names}")
def _(i):
    n = F.concat(F.lit("/x/Photo"), (F.col("page_id") % 50).cast("string"))
    photos = i.v_names.select("page_id", F.concat(n, F.lit(".jpg")).alias("path"))
    merged = i.v_names.filter("page_id % 3 <> 0").select(F.col("page_id").alias("iid"), F.upper(F.concat(n, F.lit(".tif"))).alias("path"))
    return C.reconcile_names(photos, merged).select("page_id", "merged_iid")


@query("A18_mean_dims", "select round(avg(width + p.cid), 6) as width, round(avg(height), 6) as height from {v_photos} as p join {v_cameras} as c on p.cid = c.cid")
def _(i):
    return C.mean_dims(i.v_photos, i.v_cameras.withColumn("width", F.col("width") + F.col("cid"))).select(R6(F.col("width"), "width"), R6(F.col("height"), "height"))


@query("P25_transform_points", "select pid, round((2 * x + 0.5 * z + 1) / (0.01 * z + 1), 6) as x, round((3 * y - 2) / (0.01 * z + 1), 6) as y, round((x + z) / (0.01 * z + 1), 6) as z from {v_points3d}")
def _(i):
    m = [2, 0, 0.5, 1, 0, 3, 0, -2, 1, 0, 1, 0, 0, 0, 0.01, 1]
    return C.transform_points(i.v_points3d, m).select("pid", *(R6(F.col(k), k) for k in "xyz"))


# -- models and residuals -----------------------------------------------------------------------

_H = [1.05, 0.02, -40.0, -0.01, 0.98, 25.0, 0.00001, -0.00002, 1.0]
_HW = "(0.00001 * x1 - 0.00002 * y1 + 1.0)"
_HX, _HY = f"((1.05 * x1 + 0.02 * y1 - 40) / {_HW})", f"((-0.01 * x1 + 0.98 * y1 + 25) / {_HW})"


@query("P26_apply_models", f"select iid_i, fid_i, round({_HX}, 6) as hx, round({_HY}, 6) as hy, round(1.1 * x1 + 0.2 * y1 + 3, 6) as ax, round(-0.1 * x1 + 0.9 * y1 - 4, 6) as ay from {{v_matches}}")
def _(i):
    x, y = F.col("x1"), F.col("y1")
    h, a = R.apply_homography(_H, x, y), R.apply_affine([1.1, 0.2, 3, -0.1, 0.9, -4], x, y)
    return i.v_matches.select("iid_i", "fid_i", R6(h[0], "hx"), R6(h[1], "hy"), R6(a[0], "ax"), R6(a[1], "ay"))


@query("P27_normalize_points", """select iid_i, fid_i, round((x1 - 2000) / sqrt(12000000), 6) as sx, round(case when var_pop(x1) over w < 1e-8 then x1 - 1 else (x1 - avg(x1) over w) * sqrt(2.0 / var_pop(x1) over w) end, 6) as nx, round(case when var_pop(y1) over w < 1e-8 then y1 - 1 else (y1 - avg(y1) over w) * sqrt(2.0 / var_pop(y1) over w) end, 6) as ny
    from {v_matches} window w as (partition by iid_i, iid_j)""")
def _(i):
    m = i.v_matches.withColumns({"sx": F.col("x1"), "sy": F.col("y1"), "nx": F.col("x1"), "ny": F.col("y1")})
    return R.normalize_points(R.normalize_by_size(m, 4000, 3000, "sx", "sy"), R.PAIR, "nx", "ny").select("iid_i", "fid_i", R6(F.col("sx"), "sx"), R6(F.col("nx"), "nx"), R6(F.col("ny"), "ny"))


_FM = [0.0, -0.000002, 0.004, 0.000003, 0.0, -0.006, -0.005, 0.004, 1.0]
_E = ["(-0.000002 * y1 + 0.004)", "(0.000003 * x1 - 0.006)", "(-0.005 * x1 + 0.004 * y1 + 1.0)", "(0.000003 * y2 - 0.005)", "(-0.000002 * x2 + 0.004)"]
_D2, _A, _B = f"((x2 * {_E[0]} + y2 * {_E[1]} + {_E[2]}) ** 2)", f"({_E[0]} ** 2 + {_E[1]} ** 2)", f"({_E[3]} ** 2 + {_E[4]} ** 2)"


@query("P28_residuals", f"""select iid_i, fid_i, round({_D2} / ({_A} + {_B}), 3) as sampson, round({_D2} / {_A} / 4 + {_D2} / {_B} / 4, 3) as symmetric, round({_D2} / {_A}, 3) as one_sided,
    round((x2 - {_HX}) ** 2 + (y2 - {_HY}) ** 2, 4) as homography, round((x2 - x1 - 30) ** 2 + (y2 - y1 + 20) ** 2, 4) as translation from {{v_matches}}""")
def _(i):
    m = i.v_matches
    for kind, model, name in (("sampson", _FM, "sampson"), ("symmetric_epipolar", _FM, "symmetric"), ("epipolar", _FM, "one_sided"), ("homography", _H, "homography"), ("translation", [30, -20], "translation")):
        m = R.residual(m, model, kind, name)
    return m.select("iid_i", "fid_i", *(F.round(c, 3).alias(c) for c in ("sampson", "symmetric", "one_sided")), *(F.round(c, 4).alias(c) for c in ("homography", "translation")))


# -- robust fitting -----------------------------------------------------------------------------


@query("R1_sample_hypotheses")
def _(i):
    return R.sample_hypotheses(i.v_matches, 4, 64, 3)


@query("R1_draw_counts", "select iid_i, iid_j, 64::bigint as draws, true as distinct_matches from {v_matches} group by iid_i, iid_j having count(*) >= 4")
def _(i):
    draws = R.sample_hypotheses(i.v_matches, 4, 64, 3).groupBy("iid_i", "iid_j", "draw").agg(F.count_distinct("fid_i", "fid_j").alias("n"))
    return draws.groupBy("iid_i", "iid_j").agg(F.count(F.lit(1)).alias("draws"), F.every(F.col("n") == 4).alias("distinct_matches"))


@query("R2_fit_minimal")
def _(i):
    return R.fit_minimal(R.sample_hypotheses(i.v_matches, 7, 64, 3), "fundamental")


# the seven sampled matches lie on every model that is fitted through them, whatever the sample and the root
@query("R2_fit_residuals", "select iid_i, iid_j, true as through_all from {v_matches} group by iid_i, iid_j having count(*) >= 7")
def _(i):
    samples = R.sample_hypotheses(i.v_matches, 7, 64, 3)
    models = R.fit_minimal(samples, "fundamental")
    on = samples.join(models, ["iid_i", "iid_j", "draw"])
    e = R.residual(on, [F.col("model")[k] for k in range(9)], "symmetric_epipolar")
    # squared pixels of images of 4000 x 3000: the greatest of all draws and roots
    return e.groupBy("iid_i", "iid_j").agg((F.max(F.coalesce("error", F.lit(0.0))) < 1e-6).alias("through_all"))


@query("R2_fit_translation", "select iid_i, iid_j, row_number() over (partition by iid_i, iid_j order by fid_i, fid_j) - 1 as draw, round(x2 - x1, 6) as tx, round(y2 - y1, 6) as ty from {v_matches}")
def _(i):
    return R.every_translation(i.v_matches).select("iid_i", "iid_j", F.col("draw").cast("long").alias("draw"), R6(F.col("model")[0], "tx"), R6(F.col("model")[1], "ty"))


def _shifted(i):
    """Matches of which two thirds follow one shift of whole pixels, and the rest do not."""
    good = F.col("fid_i") % 3 != 0
    m = i.v_matches.withColumn("x2", F.when(good, F.col("x1") + 30 + F.col("fid_i") % 4).otherwise(F.col("x2"))).withColumn("y2", F.when(good, F.col("y1") - 20).otherwise(F.col("y2")))
    return stage(m, "matches")  # read several times


_SHIFT = "(select iid_i, iid_j, fid_i, fid_j, x1, y1, case when fid_i % 3 <> 0 then x1 + 30 + fid_i % 4 else x2 end as x2, case when fid_i % 3 <> 0 then y1 - 20 else y2 end as y2 from {v_matches})"
_HYP = f"m as materialized (select *, row_number() over (partition by iid_i, iid_j order by fid_i, fid_j) - 1 as n, count(*) over (partition by iid_i, iid_j) as n_all from {_SHIFT}), s as materialized (select a.iid_i, a.iid_j, a.fid_i, a.fid_j, a.n_all, h.n as draw, (a.x2 - a.x1 - (h.x2 - h.x1)) ** 2 + (a.y2 - a.y1 - (h.y2 - h.y1)) ** 2 as e from m a join m h on a.iid_i = h.iid_i and a.iid_j = h.iid_j)"


@query("R4_ransac_translation", f"""with {_HYP}, d as (select s.iid_i, s.iid_j, s.draw, count(*) as inliers from s where e < 6.25 group by s.iid_i, s.iid_j, s.draw), c as (select *, row_number() over (partition by iid_i, iid_j order by inliers desc, draw) as rank from d)
    select s.iid_i, s.fid_i, s.fid_j, s.draw, inliers from s join c on s.iid_i = c.iid_i and s.draw = c.draw and c.rank = 1 where e < 6.25""")
def _(i):
    m = _shifted(i)
    return R.ransac(m, R.every_translation(m), "translation", 2.5).select("iid_i", "fid_i", "fid_j", F.col("draw").cast("long").alias("draw"), "inliers")


@query("R3_ac_ransac_translation", f"""with {_HYP}, k as materialized (select *, row_number() over (partition by iid_i, draw order by e, fid_i, fid_j) as k from s),
    v as (select *, round(log10(n_all - 1) + (k - 1) * (log10(pi()) + log10(e / 12000000.0 + 1e-30)) + (lgamma(n_all + 1) - lgamma(n_all - k + 1) - lgamma(k)) / ln(10), 6) as nfa from k where k > 1 and e <= 25),
    b as (select iid_i, draw, k as upto, row_number() over (partition by iid_i order by nfa, draw, k) as rank from v where nfa < 0)
    select k.iid_i, k.fid_i, k.fid_j from k join b on k.iid_i = b.iid_i and k.draw = b.draw and b.rank = 1 where k.k <= b.upto""")
def _(i):
    m = _shifted(i)
    return R.ac_ransac(m, R.every_translation(m), "translation", 4000, 3000).select("iid_i", "fid_i", "fid_j")


def _planted(i, x2, y2):
    """Matches of which four fifths follow a model within half a pixel, and the rest are where they were."""
    jitter = lambda m: (F.col("fid_i") * m % 11 - 5) / 12.0
    good = F.col("fid_i") % 5 != 0
    m = i.v_matches.select("iid_i", "iid_j", "fid_i", "fid_j", "x1", "y1", F.when(good, x2 + jitter(7)).otherwise(F.col("x2")).alias("x2"), F.when(good, y2 + jitter(3)).otherwise(F.col("y2")).alias("y2"), good.alias("good"))
    return stage(m, "matches")  # read many times


def _recovered(planted, found):
    """Of each pair: are nine tenths of the planted matches found, and of the others at most a tenth of as many?"""
    hit = planted.join(found.select("iid_i", "iid_j", "fid_i", "fid_j", F.lit(1).alias("hit")), ["iid_i", "iid_j", "fid_i", "fid_j"], "left")
    g = hit.groupBy("iid_i", "iid_j").agg(F.count_if("good").alias("good"), F.count_if(F.col("good") & (F.col("hit") == 1)).alias("right"), F.count_if(~F.col("good") & (F.col("hit") == 1)).alias("wrong")).filter("good >= 24")
    return g.select("iid_i", "iid_j", (F.col("right") >= 0.9 * F.col("good")).alias("nine_tenths_found"), (F.col("wrong") <= 0.1 * F.col("good")).alias("few_others"))


_RECOVERED = "select iid_i, iid_j, true as nine_tenths_found, true as few_others from {v_matches} group by iid_i, iid_j having count(*) filter (fid_i % 5 <> 0) >= 24"


@query("R3_ac_ransac_homography", _RECOVERED)
def _(i):
    w = 0.00002 * F.col("x1") - 0.00001 * F.col("y1") + 1
    p = _planted(i, (1.05 * F.col("x1") + 0.02 * F.col("y1") - 40) / w, (-0.01 * F.col("x1") + 0.98 * F.col("y1") + 25) / w)
    return _recovered(p, R.ac_ransac_reserved(p.drop("good"), "homography", 4000, 3000, draws=256))


# a match lies on a line of the other image: y2 follows from x1 and y1, x2 is free
@query("R3_ac_ransac_fundamental", _RECOVERED)
def _(i):
    p = _planted(i, F.col("x2"), 0.05 * F.col("x1") + 0.98 * F.col("y1") + 12)
    return _recovered(p, R.ac_ransac_reserved(p.drop("good"), "fundamental", 4000, 3000, draws=256))


@query("R5_homography4", "select iid_i, fid_i, 1.1::double as h0, 0.0::double as h1, round(-1.1 * (x1 % 7) + 3 + y1 % 5, 4) as h2, 0.0::double as h3, 0.9::double as h4, -2.0::double as h5, 0.0::double as h6, 0.0::double as h7 from {v_matches}")
def _(i):
    pts = F.array(*(F.struct((F.lit(float(a)) + F.col("x1") % 7).alias("x1"), F.lit(float(b)).alias("y1"), (F.lit(a * 1.1 + 3) + F.col("y1") % 5).alias("x2"), F.lit(b * 0.9 - 2).alias("y2")) for a, b in ((0, 0), (100, 0), (100, 80), (0, 80))))
    return R.homography4(i.v_matches.select("iid_i", "fid_i", pts.alias("pts"))).select("iid_i", "fid_i", *((F.round(F.col("model")[k], 4) + 0.0).alias(f"h{k}") for k in range(8)))


@query("R5_affine3", "select iid_i, fid_i, 1.1e0 as a, round(-1.1 * (x1 % 7) + 3 + y1 % 5, 6) as c from {v_matches}")
def _(i):
    pts = F.array(*(F.struct((F.lit(float(a)) + F.col("x1") % 7).alias("x1"), F.lit(float(b)).alias("y1"), (F.lit(a * 1.1 + 3) + F.col("y1") % 5).alias("x2"), F.lit(b * 0.9 - 2).alias("y2")) for a, b in ((0, 0), (100, 0), (0, 80))))
    return R.affine3(i.v_matches.select("iid_i", "fid_i", pts.alias("pts"))).select("iid_i", "fid_i", R6(F.col("model")[0], "a"), R6(F.col("model")[2], "c"))


@query("W6_patch_normal", "select pid, round(nx, 5) as nx, 0.0::double as ny, round(nz, 5) as nz from {v_points3d}")
def _(i):
    from ..operators.patches import patch_normal

    q = F.explode(F.sequence(F.lit(0), F.lit(3)))
    k = i.v_points3d.select("pid", q.alias("corner"), "x", "y", "z", "nx", "nz").withColumn("dx", F.col("corner") % 2).withColumn("y", F.col("y") + F.floor(F.col("corner") / 2))
    k = k.withColumn("x", F.col("x") + F.col("dx") * F.col("nz")).withColumn("z", F.col("z") - F.col("dx") * F.col("nx"))
    return patch_normal(k.select("pid", "x", "y", "z")).select("pid", *((F.round(c, 5) + 0.0).alias(c) for c in ("nx", "ny", "nz")))
