"""Queries for polygons, boxes, meshes and rays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as X
from .base import query

R6 = lambda c, n: F.round(c, 6).alias(n)


def _polygons(i):
    def square(lo, hi):
        p = lambda a, b: F.struct((F.col("x0") + a).cast("long").alias("x"), (F.col("y0") + b).cast("long").alias("y"))
        return F.array(p(lo, lo), p(hi, lo), p(hi, hi), p(lo, hi))

    zero = F.lit(0)
    return i.v_polygons.select("poly_id", F.array(square(zero, F.col("side")), square(F.col("hole0"), F.col("hole1"))).alias("rings"))


def _points(i):
    return i.v_points3d.select("pid", (F.col("x") * 1000).cast("long").alias("x"), (F.col("y") * 1000).cast("long").alias("y"))


@query("J13_pip_join", """select pid, poly_id from {v_points3d}, {v_polygons} where x * 1000 > x0 and x * 1000 < x0 + side and y * 1000 > y0 and y * 1000 < y0 + side
    and not (x * 1000 > x0 + hole0 and x * 1000 < x0 + hole1 and y * 1000 > y0 + hole0 and y * 1000 < y0 + hole1)""")
def _(i):
    return X.pip_join(_points(i), _polygons(i), 5000)


@query("A14_polygon_area", "select poly_id, (side * side)::double as area, true as ccw, ((hole1 - hole0) * (hole1 - hole0))::double as hole from {v_polygons}")
def _(i):
    p = _polygons(i)
    return p.select("poly_id", X.polygon_area(F.col("rings")[0]).alias("area"), X.orientation(F.col("rings")[0]).alias("ccw"), X.polygon_area(F.col("rings")[1]).alias("hole"))


@query("A13_bbox", "select pid % 7 as g, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from {v_points3d} group by 1")
def _(i):
    return X.bbox(i.v_points3d.withColumn("g", F.col("pid") % 7), ["g"])


_D1, _D2 = [0.6, 0.8, 0.0], [-0.8, 0.6, 0.0]
_OBB = "b as (select pid % 7 as g, min(0.6 * x + 0.8 * y) as l0, max(0.6 * x + 0.8 * y) as u0, min(-0.8 * x + 0.6 * y) as l1, max(-0.8 * x + 0.6 * y) as u1, min(z) as l2, max(z) as u2 from {v_points3d} group by 1)"


def _obb(i):
    return X.obb(i.v_points3d.withColumn("g", F.col("pid") % 7), _D1, _D2, ["g"])


@query("A15_obb", f"with {_OBB} select g, round(0.6 * (l0 + u0) / 2 - 0.8 * (l1 + u1) / 2, 6) as c0, round(0.8 * (l0 + u0) / 2 + 0.6 * (l1 + u1) / 2, 6) as c1, round((l2 + u2) / 2, 6) as c2, round((u0 - l0) / 2, 6) as h0, round((u0 - l0) * (u1 - l1) * (u2 - l2), 4) as vol, round((u0 - l0) * (u1 - l1) * (u2 - l2) * 8, 4) as vol2 from b")
def _(i):
    b = _obb(i)
    return X.obb_scale(b.withColumn("vol", X.obb_volume()), 2.0).select("g", R6(F.col("c0"), "c0"), R6(F.col("c1"), "c1"), R6(F.col("c2"), "c2"), R6(F.col("h0") / 2, "h0"), F.round("vol", 4).alias("vol"), F.round(X.obb_volume(), 4).alias("vol2"))


@query("A15_obb_contains", f"with {_OBB} select pid, g from {{v_points3d}}, b where abs(0.6 * x + 0.8 * y - (l0 + u0) / 2) <= (u0 - l0) * 0.2437 and abs(-0.8 * x + 0.6 * y - (l1 + u1) / 2) <= (u1 - l1) * 0.2437 and abs(z - (l2 + u2) / 2) <= (u2 - l2) * 0.2437")
def _(i):
    return X.points_in_boxes(i.v_points3d, X.obb_scale(_obb(i), 0.4874), [F.col(k) for k in "xyz"], 8.0).select("pid", "g")


@query("A15_obb_edges", f"with {_OBB} select g, count(*) * 12 as n, round(4 * (any_value(u0) - any_value(l0)) + 4 * (any_value(u1) - any_value(l1)) + 4 * (any_value(u2) - any_value(l2)), 4) as total from b group by g")
def _(i):
    e = X.obb_edges(_obb(i), ["g"])
    length = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in "yz"), (F.col("x1") - F.col("x0")) ** 2))
    return e.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length), 4).alias("total"))


_AREA = "sqrt(((by_ - ay) * (cz - az) - (bz - az) * (cy - ay)) ** 2 + ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) ** 2 + ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) ** 2) / 2"


@query("A16_barycenter_area", f"select tid, round((ax + bx + cx) / 3, 6) as x, round((ay + by_ + cy) / 3, 6) as y, round((az + bz + cz) / 3, 6) as z, round({_AREA}, 6) as area from {{v_triangles}}")
def _(i):
    m = X.barycenter()
    return i.v_triangles.select("tid", *(R6(v, n) for v, n in zip(m, "xyz", strict=True)), R6(X.tri_area(), "area"))


@query("J14_clip_mesh", "select tid from {v_triangles} where abs(0.6 * (ax + bx + cx) / 3 + 0.8 * (ay + by_ + cy) / 3 - 1) <= 20.25 and abs(-0.8 * (ax + bx + cx) / 3 + 0.6 * (ay + by_ + cy) / 3 - 2) <= 15.25 and abs((az + bz + cz) / 3 - 5) <= 6.1")
def _(i):
    row = {"c0": 0.6 - 1.6, "c1": 0.8 + 1.2, "c2": 5.0, "h0": 20.25, "h1": 15.25, "h2": 6.1} | {f"a{r}{k}": v for r, d in enumerate((_D1, _D2, [0.0, 0.0, 1.0])) for k, v in enumerate(d)}
    return X.clip_mesh(i.v_triangles, i.spark.createDataFrame([row])).select("tid")


@query("J14_remove_by_bbox", "select tid from {v_triangles} where not ((ax + bx + cx) / 3 between -20 and 10.1 and (ay + by_ + cy) / 3 between -30 and 5.2 and (az + bz + cz) / 3 between 0 and 9.9)")
def _(i):
    return X.remove_by_bbox(i.v_triangles, (-20, -30, 0), (10.1, 5.2, 9.9)).select("tid")


def _indexed(t):
    """Vertices and triangles of separate faces: three vertices each."""
    a, b, c = X.corners()
    three = F.array(*(F.struct((F.col("tid") * 3 + n).alias("vid"), *(v.alias(k) for v, k in zip(p, "xyz", strict=True))) for n, p in enumerate((a, b, c))))
    return t.select(F.explode(three).alias("v")).select("v.*"), t.select("tid", *((F.col("tid") * 3 + n).alias(f"v{n}") for n in range(3)))


@query("U4_mesh_merge", """with a as (select * from {v_triangles} where tid % 2 = 0), b as (select * from {v_triangles} where tid % 2 = 1), m as (select max(tid) * 3 + 3 as v, max(tid) + 1 as t from a)
    select tid, tid * 3 as v0, tid * 3 + 2 as v2 from a union all select tid + m.t, tid * 3 + m.v, tid * 3 + 2 + m.v from b, m""")
def _(i):
    t = i.v_triangles
    v, f = X.mesh_merge(*_indexed(t.filter("tid % 2 = 0")), *_indexed(t.filter("tid % 2 = 1")))
    return f.join(X.drop_isolated(v, f).select(F.col("vid").alias("v0")), "v0", "left_semi").select("tid", "v0", "v2")


# one round on separate faces: large ones become four of a quarter of the area
@query("U7_subdivide", f"select round(area / case when area > 12.5 then 4 else 1 end, 6) as area, count(*) * case when area > 12.5 then 4 else 1 end as n from (select {_AREA} as area from {{v_triangles}}) group by area")
def _(i):
    _, f = X.subdivide(*_indexed(i.v_triangles), 5.0, 1, with_corners=True)
    return f.select(F.round(X.tri_area(), 6).alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n"))


# five rounds on a sheet whose triangles share edges: parts are its vertices, twenty in a row
_SHEET = "v as materialized (select p_partkey as k, ((p_partkey % 20) * 10)::double as x, ((p_partkey // 20) * 10)::double as y, (p_size % 20)::double as z from part)"


@query("U7_five_rounds", f"""with recursive {_SHEET}, q as materialized (select a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, c.x as cx, c.y as cy, c.z as cz, d.x as dx, d.y as dy, d.z as dz from v a join v b on b.k = a.k + 1 and a.k % 20 < 19 join v c on c.k = a.k + 20 join v d on d.k = a.k + 21),
    t(n, ax, ay, az, bx, by_, bz, cx, cy, cz) as (select 0, ax, ay, az, bx, by_, bz, cx, cy, cz from q union all select 0, bx, by_, bz, dx, dy, dz, cx, cy, cz from q
    union all select n + 1, case k when 0 then ax when 1 then (ax + bx) / 2 when 2 then (ax + cx) / 2 else (ax + bx) / 2 end, case k when 0 then ay when 1 then (ay + by_) / 2 when 2 then (ay + cy) / 2 else (ay + by_) / 2 end, case k when 0 then az when 1 then (az + bz) / 2 when 2 then (az + cz) / 2 else (az + bz) / 2 end,
    case k when 0 then (ax + bx) / 2 when 1 then bx when 2 then (bx + cx) / 2 else (bx + cx) / 2 end, case k when 0 then (ay + by_) / 2 when 1 then by_ when 2 then (by_ + cy) / 2 else (by_ + cy) / 2 end, case k when 0 then (az + bz) / 2 when 1 then bz when 2 then (bz + cz) / 2 else (bz + cz) / 2 end,
    case k when 0 then (ax + cx) / 2 when 1 then (bx + cx) / 2 when 2 then cx else (ax + cx) / 2 end, case k when 0 then (ay + cy) / 2 when 1 then (by_ + cy) / 2 when 2 then cy else (ay + cy) / 2 end, case k when 0 then (az + cz) / 2 when 1 then (bz + cz) / 2 when 2 then cz else (az + cz) / 2 end
    from t, (select unnest(range(4)) as k) where n < 5 and {_AREA} > 8), done as materialized (select * from t where n = 5 or {_AREA} <= 8)
    select 'area' as kind, round({_AREA}, 4) as value, count(*) as n from done group by 2 union all select 'vertices', 0, count(*) from (select ax, ay, az from done union select bx, by_, bz from done union select cx, cy, cz from done)""")
def _(i):
    k, row = F.col("p_partkey"), F.floor(F.col("p_partkey") / 20)
    v = i.part.select(k.cast("long").alias("vid"), (k % 20 * 10.0).alias("x"), (row * 10.0).alias("y"), (F.col("p_size") % 20).cast("double").alias("z"))
    ids = v.select("vid")
    has = lambda df, n: df.join(ids.select((F.col("vid") - n).alias("a")), "a", "left_semi")
    cells = has(has(has(ids.select(F.col("vid").alias("a")).filter("a % 20 < 19"), 1), 20), 21)
    two = F.array(*(F.struct(F.lit(m).alias("m"), *((F.col("a") + d).alias(f"v{j}") for j, d in enumerate(way))) for m, way in enumerate(((0, 1, 20), (1, 21, 20)))))
    f = cells.select("a", F.explode(two).alias("t")).select((F.col("a") * 2 + F.col("t.m")).alias("tid"), "t.v0", "t.v1", "t.v2")
    # subdivision leaves no vertex without a triangle, so unused ones are dropped before it
    v, f = X.subdivide(X.drop_isolated(v, f), f, 4.0, 5, with_corners=True)
    areas = f.select(F.lit("area").alias("kind"), F.round(X.tri_area(), 4).alias("value")).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return areas.unionByName(v.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertices").alias("kind"), F.lit(0.0).alias("value"), "n"))


# each point is looked at by one photo
def _rays(i):
    p, h = i.v_points3d, i.v_photos
    n = h.agg(F.count(F.lit(1)).alias("n"), F.min("iid").alias("first"))
    p = p.join(F.broadcast(n), F.lit(True)).withColumn("iid", F.col("pid") % F.col("n") + F.col("first"))
    d = [F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz")]
    return p.join(h, "iid").select(F.col("pid").alias("ray_id"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("cz").alias("oz"), *(v.alias(k) for v, k in zip(d, ("dx", "dy", "dz"), strict=True)), F.lit(0.0).alias("tnear"), F.lit(0.999).alias("tfar"))


_RAYS = """ray as (select pid as ray_id, p.cx as ox, p.cy as oy, p.cz as oz, x - p.cx as dx, y - p.cy as dy, z - p.cz as dz from {v_points3d} as q join {v_photos} as p on p.iid = q.pid % (select count(*) from supplier) + (select min(s_suppkey) from supplier)),
    m as (select ray_id, tid, bx - ax as e1x, by_ - ay as e1y, bz - az as e1z, cx - ax as e2x, cy - ay as e2y, cz - az as e2z, ox - ax as sx, oy - ay as sy, oz - az as sz, dx, dy, dz from ray, {v_triangles}),
    pq as (select *, dy * e2z - dz * e2y as px, dz * e2x - dx * e2z as py, dx * e2y - dy * e2x as pz, sy * e1z - sz * e1y as qx, sz * e1x - sx * e1z as qy, sx * e1y - sy * e1x as qz from m),
    k as (select ray_id, tid, e1x * px + e1y * py + e1z * pz as det, sx * px + sy * py + sz * pz as un, dx * qx + dy * qy + dz * qz as vn, e2x * qx + e2y * qy + e2z * qz as tn from pq),
    hit as (select ray_id, tid, round(tn / det, 9) as t, un / det as u, vn / det as v from k where abs(det) > 1e-12 and un / det >= 0 and vn / det >= 0 and un / det + vn / det <= 1 and tn / det between 0 and 0.999)"""


@query("J15_ray_hits", f"with {_RAYS} select ray_id, tid, round(t, 6) as t, round(u, 6) as u, round(v, 6) as v from (select *, row_number() over (partition by ray_id order by t, tid) as n from hit) where n = 1")
def _(i):
    return X.ray_hits(_rays(i), i.v_triangles, 8.0).select("ray_id", "tid", R6(F.col("t"), "t"), R6(F.col("u"), "u"), R6(F.col("v"), "v"))


@query("J15_occluded", f"with {_RAYS} select distinct ray_id from hit")
def _(i):
    return X.occluded(_rays(i), i.v_triangles, 8.0).select("ray_id")
