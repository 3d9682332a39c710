"""Queries for features, nearest neighbours, match filters and tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as P
from ..operators import graph as G
from ..operators import knn as K
from ..operators import matches as M
from ..operators import robust as R
from ..session import stage
from .base import query

R6 = lambda c: F.round(c, 6)

# -- features -----------------------------------------------------------------------------------

_ABS = "[abs(x::double) for x in vec]"


@query("P1_root_normalize", f"select iid, fid, [greatest(0, least(255, round(sqrt(x / list_sum({_ABS})) * 512)))::int for x in {_ABS}] as d from {{v_desc}}")
def _(i):
    return i.v_desc.select("iid", "fid", P.root_normalize(F.transform("vec", lambda x: F.abs(x.cast("double")))).alias("d"))


@query("P2_scale_normalize", "select iid, fid, [greatest(0, least(255, round(x::double * 512)))::int for x in vec] as d from {v_desc}")
def _(i):
    return i.v_desc.select("iid", "fid", P.scale_normalize(F.col("vec")).alias("d"))


@query("P3_merge_cell_features", "select iid, fid, iid % 4 as cell, x + (iid % 4) * 1000 as x, y + (iid % 2) * 500 as y from {v_features}")
def _(i):
    cells = i.spark.range(4).select(F.col("id").alias("cell"), (F.col("id") * 1000).alias("ox"), (F.col("id") % 2 * 500).alias("oy"))
    return P.merge_cell_features(i.v_features.select("iid", "fid", "x", "y", (F.col("iid") % 4).alias("cell")), cells).select("iid", "fid", "cell", "x", "y")


@query("P4_assign_cell", """with b as (select i, i * 4000 // 4 as lo, (i + 1) * 4000 // 4 as hi from (select unnest(range(4)) as i)), d as (select i, i * 3000 // 3 as lo, (i + 1) * 3000 // 3 as hi from (select unnest(range(3)) as i))
    select iid, fid, d.i::int as cell_r, b.i::int as cell_c from {v_features} join b on x >= b.lo and x < b.hi join d on y >= d.lo and y < d.hi""")
def _(i):
    return P.assign_cell(i.v_features, 4000, 3000, 1024).select("iid", "fid", "cell_r", "cell_c")


@query("P5_filter_by_mask", "select iid, fid from {v_features} where (round(x)::bigint + round(y)::bigint) % 3 <> 0 and round(x) < 2000")
def _(i):
    f = i.v_features
    pixel = f.select("iid", P.half_away(F.col("y")).alias("r"), P.half_away(F.col("x")).alias("c")).distinct().filter("c < 2000")
    return P.filter_by_mask(f, pixel.withColumn("v", ((F.col("r") + F.col("c")) % 3 != 0).cast("int"))).select("iid", "fid")


@query("T1_retain_best", "select iid, fid, response from (select *, rank() over (partition by iid order by response desc) as n from {v_features}) where n <= 100")
def _(i):
    return P.retain_best(i.v_features, 100).select("iid", "fid", "response")


@query("T2_retain_gridded", """with b as (select iid, count(*) as n_all, min(x) as x0, min(y) as y0, greatest(5.0, sqrt(trunc((max(x) - min(x)) * (max(y) - min(y))) / 200.0) * 0.75) as side from {v_features} group by iid),
    c as (select f.*, floor((y - y0) / side) as gr, floor((x - x0) / side) as gc from {v_features} as f join b on f.iid = b.iid where n_all > 200)
    select iid, fid, response from (select *, row_number() over (partition by iid, gr, gc order by response desc, fid) as n from c) where n = 1
    union all select f.iid, fid, response from {v_features} as f join b on f.iid = b.iid where n_all <= 200""")
def _(i):
    return P.retain_best_gridded(i.v_features, 200).select("iid", "fid", "response")


@query("J12_attach_ends", "select m.iid_i, m.fid_i, m.iid_j, m.fid_j, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from {v_matches} as m join {v_keypoints} as a on m.iid_i = a.iid and m.fid_i = a.fid join {v_keypoints} as b on m.iid_j = b.iid and m.fid_j = b.fid")
def _(i):
    m = i.v_matches.select("iid_i", "fid_i", "iid_j", "fid_j")
    return P.attach_ends(m, i.v_keypoints).select("iid_i", "fid_i", "iid_j", "fid_j", "x1", "y1", "x2", "y2")


@query("J20_image_pairs", "select a.iid as iid_i, b.iid as iid_j from (select distinct iid from {v_features}) a join (select distinct iid from {v_features}) b on a.iid < b.iid")
def _(i):
    return P.image_pairs(i.v_features)


@query("A3_list_pairs", "select iid_i, iid_j, count(*) as n_matches, 0::bigint as n_wrong from {v_match_chain} group by 1, 2")
def _(i):
    return G.list_pairs(i.v_match_chain)


# -- nearest neighbours -------------------------------------------------------------------------

_DIST = "list_sum([(a.vec[k]::double - b.vec[k]::double) * (a.vec[k]::double - b.vec[k]::double) for k in range(1, 65)])"
_KNN = f"""knn as materialized (select * from (select a.iid as iid_i, a.fid as fid_i, b.iid as iid_j, b.fid as fid_j, d as dist, row_number() over (partition by a.iid, a.fid, b.iid order by d, b.fid) as rank
    from (select a.iid, a.fid, b.iid as biid, b.fid as bfid, array_distance(a.vec::double[64], b.vec::double[64]) ** 2 as d from {{v_desc}} as a join {{v_desc}} as b on a.iid < b.iid) a, lateral (select a.biid as iid, a.bfid as fid) b) where rank <= 2)"""
_BACK = _KNN.replace("knn as", "back as").replace("a.iid < b.iid", "a.iid > b.iid")


def _knn(i, metric="l2sq"):
    return K.knn_join(i.v_desc, P.image_pairs(i.v_desc), 2, metric)


@query("J1_knn_join", f"with {_KNN} select iid_i, fid_i, iid_j, fid_j, rank, round(dist, 6) as dist from knn")
def _(i):
    return _knn(i).withColumn("dist", R6(F.col("dist")))


@query("W1_best_and_second", f"with {_KNN} select iid_i, fid_i, iid_j, fid_j, rank, round(dist, 6) as dist from knn")
def _(i):
    near = K.knn_join(i.v_desc, P.image_pairs(i.v_desc), 5).drop("rank")
    return K.k_best(near, ["iid_i", "fid_i", "iid_j"], ["dist", "fid_j"], 2).withColumn("dist", R6(F.col("dist")))


@query("J2_ann_join")
def _(i):
    return K.ann_join(i.v_desc, P.image_pairs(i.v_desc), 2)


# the recall is counted against the exact join, over all features
@query("J2_ann_recall", f"with {_KNN} select count(*) as n_exact, true as nine_tenths_found from knn")
def _(i):
    key = ["iid_i", "fid_i", "iid_j", "fid_j"]
    found = K.ann_join(i.v_desc, P.image_pairs(i.v_desc), 2).select(*key, F.lit(1).alias("hit"))
    both = _knn(i).select(*key).join(found, key, "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("hits"))
    return both.select("n_exact", (F.col("hits") >= 0.9 * F.col("n_exact")).alias("nine_tenths_found"))


@query("P6_ratio_test", f"with {_KNN} select iid_i, fid_i, iid_j, fid_j, round(dist, 6) as dist from (select *, lead(dist) over (partition by iid_i, fid_i, iid_j order by rank) as second from knn) where rank = 1 and dist < 0.9 * second")
def _(i):
    return K.ratio_test(_knn(i), 0.9).withColumn("dist", R6(F.col("dist")))


@query("P7_angle_test", f"""with {_KNN}, ang as (select iid_i, fid_i, iid_j, fid_j, rank, acos(greatest(-1, least(1, list_dot_product(p.vec::double[], q.vec::double[])))) as dist from knn join {{v_desc}} as p on p.iid = iid_i and p.fid = fid_i join {{v_desc}} as q on q.iid = iid_j and q.fid = fid_j)
    select a.iid_i, a.fid_i, a.iid_j, a.fid_j, round(a.dist, 5) as dist from ang a join ang b using (iid_i, fid_i, iid_j) where a.rank = 1 and b.rank = 2 and a.dist < 1.2 and a.dist < 0.95 * b.dist""")
def _(i):
    return K.angle_test(_knn(i, "angle"), 1.2, 0.95).withColumn("dist", F.round("dist", 5))


@query("J3_mutual_best", f"with {_KNN}, {_BACK} select a.iid_i, a.fid_i, a.iid_j, a.fid_j, round(a.dist, 6) as dist from knn a join back b on a.iid_i = b.iid_j and a.fid_i = b.fid_j and a.iid_j = b.iid_i and a.fid_j = b.fid_i where a.rank = 1 and b.rank = 1")
def _(i):
    return K.mutual_join(i.v_desc, P.image_pairs(i.v_desc)).withColumn("dist", R6(F.col("dist")))


@query("J6_radius_join", "select a.iid, a.fid as fid_a, b.fid as fid_b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) as d2 from {v_features} as a join {v_features} as b on a.iid = b.iid where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 225")
def _(i):
    # d2 lies in 0 .. 225, where this is the rounding of the SQL; F.round makes a decimal number a row, which takes longer than the join
    return K.radius_join(i.v_features, i.v_features, 15.0).withColumn("d2", F.floor(F.col("d2") * 1e6 + 0.5) / 1e6)


_NEAR = """near as (select * from (select a.iid_i, a.iid_j, a.fid_i, b.fid_i as nkey, (a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2 as d2,
      row_number() over (partition by a.iid_i, a.iid_j, a.fid_i order by (a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2, (a.fid_i <> b.fid_i)::int, b.fid_i) as rank
      , count(*) over (partition by a.iid_i, a.iid_j, a.fid_i) as n
      from {v_matches} as a join {v_matches} as b on a.iid_i = b.iid_i and a.iid_j = b.iid_j) where rank <= case when n <= 10 then greatest(1, n // 2) else 5 end)"""


@query("J5_spatial_knn", f"with {_NEAR} select iid_i, iid_j, fid_i, nkey, round(d2, 4) as d2, rank from near")
def _(i):
    return K.spatial_knn(i.v_matches).withColumn("d2", F.round("d2", 4))


# -- match filters ------------------------------------------------------------------------------


@query("P8_max_displacement", "select iid_i, fid_i, fid_j from {v_matches} where (x1 - x2) ** 2 + (y1 - y2) ** 2 < 800 * 800")
def _(i):
    return M.max_displacement(i.v_matches, 800).select("iid_i", "fid_i", "fid_j")


@query("P9_min_group", "select iid_i, iid_j, fid_i, fid_j from (select *, count(*) over (partition by iid_i, iid_j) as n from {v_match_chain}) where n >= 15")
def _(i):
    return M.min_group(i.v_match_chain, ["iid_i", "iid_j"], 15).select("iid_i", "iid_j", "fid_i", "fid_j")


_NB = "near join {v_matches} as p on p.iid_i = near.iid_i and p.iid_j = near.iid_j and p.fid_i = near.fid_i join {v_matches} as q on q.iid_i = near.iid_i and q.iid_j = near.iid_j and q.fid_i = nkey where nkey <> near.fid_i"
_TURN = "sign(({0}x2 - {0}x1) * ({1}y{2} - {0}y1) - ({0}y2 - {0}y1) * ({1}x{2} - {0}x1))"
_O = [_TURN.format(*t) for t in (("p.", "q.", 1), ("p.", "q.", 2), ("q.", "p.", 1), ("q.", "p.", 2))]


def _on(s, t, e):
    return f"({t}.x{e} between least({s}.x1, {s}.x2) and greatest({s}.x1, {s}.x2) and {t}.y{e} between least({s}.y1, {s}.y2) and greatest({s}.y1, {s}.y2))"


_TOUCH = f"(({_O[0]} <> {_O[1]} and {_O[2]} <> {_O[3]}) or ({_O[0]} = 0 and {_on('p', 'q', 1)}) or ({_O[1]} = 0 and {_on('p', 'q', 2)}) or ({_O[2]} = 0 and {_on('q', 'p', 1)}) or ({_O[3]} = 0 and {_on('q', 'p', 2)}))"


@query("W2_crossing_filter", f"with {_NEAR}, crossed as (select near.iid_i, near.iid_j, near.fid_i, nkey from {_NB} and {_TOUCH}), ends as (select iid_i, iid_j, fid_i from crossed union select iid_i, iid_j, nkey from crossed) select m.iid_i, m.iid_j, m.fid_i, m.fid_j from {{v_matches}} as m anti join ends using (iid_i, iid_j, fid_i)")
def _(i):
    return M.crossing_filter(i.v_matches).select("iid_i", "iid_j", "fid_i", "fid_j")


@query("W3_orientation_filter", f"with {_NEAR} select near.iid_i, near.iid_j, near.fid_i from {_NB} group by near.iid_i, near.iid_j, near.fid_i having sum((p.x2 - p.x1) * (q.x2 - q.x1) + (p.y2 - p.y1) * (q.y2 - q.y1)) > 0")
def _(i):
    return M.orientation_filter(i.v_matches).select("iid_i", "iid_j", "fid_i")


@query("T3_retain_best_matches", "select iid_i, fid_i, fid_j from (select *, row_number() over (partition by iid_i, iid_j order by response desc, fid_i, fid_j) as n from {v_matches}) where n <= 60")
def _(i):
    return M.retain_best_matches(i.v_matches, 60).select("iid_i", "fid_i", "fid_j")


@query("T4_sample_n", "select iid_i, fid_i, fid_j from (select *, row_number() over (partition by iid_i order by md5('7|' || fid_i || '|' || fid_j), fid_i, fid_j) as n from {v_matches}) where n <= 20")
def _(i):
    return M.sample_n(i.v_matches, ["iid_i"], ["fid_i", "fid_j"], 20, 7).select("iid_i", "fid_i", "fid_j")


@query("T5_sort_matches", "select iid_i, fid_i, fid_j from {v_matches}")
def _(i):
    return M.sort_matches(i.v_matches).select("iid_i", "fid_i", "fid_j")


@query("T6_first_n", f"with {_KNN}, {_BACK} select iid_i, fid_i, iid_j, fid_j from (select a.*, row_number() over (partition by a.iid_i, a.iid_j order by a.fid_i) as n from knn a join back b on a.iid_i = b.iid_j and a.fid_i = b.fid_j and a.iid_j = b.iid_i and a.fid_j = b.fid_i where a.rank = 1 and b.rank = 1) where n <= 5")
def _(i):
    from pyspark.sql import Window

    m = K.mutual_join(i.v_desc, P.image_pairs(i.v_desc))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("iid_i", "iid_j").orderBy("fid_i"))).filter("n <= 5").select("iid_i", "fid_i", "iid_j", "fid_j")


_H = [1.05, 0.02, -40.0, -0.01, 0.98, 25.0, 0.00001, -0.00002, 1.0]
_F = [0.0, -0.000002, 0.004, 0.000003, 0.0, -0.006, -0.005, 0.004, 1.0]
_HX, _HY = (f"({a} * x1 + {b} * y1 + {c}) / (0.00001 * x1 - 0.00002 * y1 + 1.0)" for a, b, c in ((1.05, 0.02, -40.0), (-0.01, 0.98, 25.0)))
_L = ["(-0.000002 * y1 + 0.004)", "(0.000003 * x1 - 0.006)", "(-0.005 * x1 + 0.004 * y1 + 1.0)", "(0.000003 * y2 - 0.005)", "(-0.000002 * x2 + 0.004)"]
_SAMPSON = f"(x2 * {_L[0]} + y2 * {_L[1]} + {_L[2]}) ** 2 / ({_L[0]} ** 2 + {_L[1]} ** 2 + {_L[3]} ** 2 + {_L[4]} ** 2)"
_CAND = "(select a.iid_i, a.iid_j, a.fid_i, b.fid_j, a.x1, a.y1, b.x2, b.y2, abs(a.response - b.response) + ((a.fid_i * 7 + b.fid_j * 13) % 101) / 10.0 as dist from {v_matches} as a join {v_matches} as b on a.iid_i = b.iid_i)"


@query("J4_guided_match", f"""with g as (select *, row_number() over (partition by iid_i, iid_j, fid_i order by dist, fid_j) as n from {_CAND} where greatest(abs({_HX} - x2), abs({_HY} - y2)) <= 400 and {_SAMPSON} <= 90000)
    select a.iid_i, a.iid_j, a.fid_i, a.fid_j, round(a.dist, 6) as dist from g a left join g b on a.iid_i = b.iid_i and a.iid_j = b.iid_j and a.fid_i = b.fid_i and b.n = 2 where a.n = 1 and (b.dist is null or a.dist < 0.8 * b.dist)""")
def _(i):
    m = stage(i.v_matches, "matches")
    hx, hy = R.apply_homography(_H, F.col("x1"), F.col("y1"))
    line, back = R.epipolar_line(_F, F.col("x1"), F.col("y1")), R.epipolar_line(_F, F.col("x2"), F.col("y2"), back=True)
    guided = F.lit(True).alias("guided")
    a = m.select("iid_i", "iid_j", "fid_i", guided, hx.alias("hx"), hy.alias("hy"), *(c.alias(f"l{k}") for k, c in enumerate(line)), F.col("response").alias("ra"), (F.col("fid_i") * 7 % 101).alias("ka"))
    b = m.select("iid_i", "fid_j", guided, "x2", "y2", back[0].alias("l3"), back[1].alias("l4"), F.col("response").alias("rb"), (F.col("fid_j") * 13 % 101).alias("kb"))

    def distance(q, t):
        k = q["ka"][:, None] + t["kb"]
        return np.abs(q["ra"][:, None] - t["rb"]) + np.where(k < 101, k, k - 101) / 10.0

    return M.guided_search(a, b, distance, ["iid_i"], 400.0, 90000.0).select("iid_i", "iid_j", "fid_i", "fid_j", R6(F.col("dist")).alias("dist"))


# a homography and a fundamental matrix for each pair of neighbouring images; pairs of images divisible by 5 have no fundamental matrix
_PX, _PY = "((1.05 * a.x + 0.02 * a.y - 40 - a.iid % 7) / (0.00001 * a.x - 0.00002 * a.y + 1))", "((-0.01 * a.x + 0.98 * a.y + 25 + a.iid % 3) / (0.00001 * a.x - 0.00002 * a.y + 1))"
_PL = [s.replace("x1", "a.x").replace("y1", "a.y").replace("x2", "b.x").replace("y2", "b.y") for s in _L]
_PS = f"(b.x * {_PL[0]} + b.y * {_PL[1]} + {_PL[2]}) ** 2 / ({_PL[0]} ** 2 + {_PL[1]} ** 2 + {_PL[3]} ** 2 + {_PL[4]} ** 2)"


@query("J4_guided_join", f"""with k as materialized (select * from {{v_keypoints}}), c as (select a.iid as iid_i, b.iid as iid_j, a.fid as fid_i, b.fid as fid_j, (a.response - b.response) ** 2 + (a.fid % 101 - b.fid % 101) ** 2 as dist from k a join k b on b.iid = a.iid + 1
    where abs({_PX} - b.x) <= 250 and abs({_PY} - b.y) <= 250 and (a.iid % 5 = 0 or {_PS} <= 40000)), g as (select *, row_number() over w as n, lead(dist) over w as second from c window w as (partition by iid_i, iid_j, fid_i order by dist, fid_j))
    select iid_i, iid_j, fid_i, fid_j, round(dist, 6) as dist from g where n = 1 and (second is null or dist < 0.8 * second)""")
def _(i):
    f = i.v_keypoints.select("iid", "fid", "x", "y", F.array(F.col("response").cast("double"), (F.col("fid") % 101).cast("double")).alias("vec"))
    iid = F.col("iid_i")
    h = F.array(F.lit(1.05), F.lit(0.02), -40.0 - iid % 7, F.lit(-0.01), F.lit(0.98), 25.0 + iid % 3, F.lit(0.00001), F.lit(-0.00002), F.lit(1.0))
    models = i.v_keypoints.select(F.col("iid").alias("iid_i")).distinct().select("iid_i", (iid + 1).alias("iid_j"), h.alias("h"), F.when(iid % 5 != 0, F.array(*map(F.lit, _F))).alias("f"))
    return M.guided_join(f, models, 250.0, 40000.0).withColumn("dist", R6(F.col("dist")))


# -- tracks -------------------------------------------------------------------------------------

# a chain of orders is a component: islands of consecutive orders at most 60 days apart
_COMP = """o as (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over w as pd from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
    g as (select o_orderkey, o_custkey, sum(case when pd is not null and cast(o_orderdate as date) <= cast(pd as date) + interval 60 days then 0 else 1 end) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as island from o),
    comp as (select o_orderkey as fid, o_orderkey % 16 as iid, min((o_orderkey % 16) * 4294967296 + o_orderkey) over (partition by o_custkey, island) as oid, count(*) over (partition by o_custkey, island) as n from g),
    obs as (select oid, iid, min(fid) as fid from comp where n > 1 group by oid, iid)"""


@query("U1_connect_matches", f"with {_COMP} select oid, iid, fid from obs")
def _(i):
    return G.connect_matches(i.v_match_chain)


@query("A1_track_stats", f"with {_COMP} select n_views, count(*) as n_tracks from (select oid, count(*) as n_views from obs group by oid) group by n_views")
def _(i):
    return G.track_stats(G.connect_matches(i.v_match_chain))


@query("A2_vertices", "select iid_i as iid, fid_i as fid from {v_match_chain} union select iid_j, fid_j from {v_match_chain}")
def _(i):
    return G.vertices(i.v_match_chain)


@query("J11_attach_xy", f"with {_COMP} select oid, obs.iid, obs.fid, (fid * 3 % 4000)::double as x, (fid * 7 % 3000)::double as y from obs")
def _(i):
    f = G.vertices(i.v_match_chain).select("iid", "fid", (F.col("fid") * 3 % 4000).cast("double").alias("x"), (F.col("fid") * 7 % 3000).cast("double").alias("y"))
    return P.attach_xy(G.connect_matches(i.v_match_chain), f).select("oid", "iid", "fid", "x", "y")


@query("W8_assign_oid", f"with {_COMP} select dense_rank() over (order by oid) - 1 as number, oid, iid, fid from obs")
def _(i):
    return G.assign_oid(G.connect_matches(i.v_match_chain), "oid", "number")


@query("U2_merge_tracks_only_oid", f"""with {_COMP}, a as (select oid, iid, fid from obs where oid % 2 = 0), b as (select oid, iid, fid from obs where oid % 2 = 1)
    select * from a union all select oid + (select max(oid) from a) + 1, iid, fid from b""")
def _(i):
    t = _tracks(i)
    return G.merge_tracks_only_oid(t.filter("oid % 2 = 0"), t.filter("oid % 2 = 1"))


def _tracks(i):
    from ..session import stage

    return stage(G.connect_matches(i.v_match_chain), "tracks")


# tracks cut in two overlapping halves come together again
@query("U3_merge_tracks_with_fid", f"with {_COMP} select oid, iid, min(fid) as fid from comp where n > 1 group by oid, iid")
def _(i):
    m = i.v_match_chain
    return G.merge_tracks_with_fid(G.connect_matches(m.filter("fid_i % 2 = 0"), "keep"), G.connect_matches(m.filter("fid_i % 2 <> 0"), "keep"))


@query("U5_union_all", "select iid_i, fid_i from {v_match_chain} union all select iid_j, fid_j from {v_match_chain}")
def _(i):
    m = i.v_match_chain
    return G.union_all(m.select("iid_i", "fid_i"), m.select(F.col("iid_j").alias("iid_i"), F.col("fid_j").alias("fid_i")))


# tie points: an order is a point, its lines are observations
_TIE = "(select l_orderkey as point_id, case when l_linenumber = 1 then 'ground' when l_linenumber % 2 = 0 then 'grounds' else 'aerials' end as role, l_suppkey as iid, max(l_extendedprice) as x, max(l_quantity) as y from lineitem group by 1, 2, 3)"


def _tie(i):
    role = F.when(F.col("l_linenumber") == 1, "ground").when(F.col("l_linenumber") % 2 == 0, "grounds").otherwise("aerials")
    return i.lineitem.groupBy(F.col("l_orderkey").alias("point_id"), role.alias("role"), F.col("l_suppkey").alias("iid")).agg(F.max("l_extendedprice").alias("x"), F.max("l_quantity").alias("y"))


@query("A17_nest_results", f"select point_id, role, array_to_string(list(iid order by iid, x, y), ',') as iids, round(list_sum(list(x)), 4) as sx from {_TIE} group by 1, 2")
def _(i):
    n = G.nest_results(_tie(i))
    return n.select("point_id", "role", F.array_join(F.transform("obs", lambda o: o["iid"].cast("string")), ",").alias("iids"), F.round(F.aggregate("obs", F.lit(0.0), lambda s, o: s + o["x"]), 4).alias("sx"))


@query("A17b_unnest_results", f"select point_id, role, iid, x, y from {_TIE}")
def _(i):
    return G.unnest_results(G.nest_results(_tie(i)))


@query("P10_require_roles", f"select t.* from {_TIE} t where point_id in (select point_id from {_TIE} group by point_id having count(*) filter (role = 'aerials') > 0 and count(*) filter (role = 'grounds') > 0)")
def _(i):
    return G.require_roles(_tie(i))


@query("J21_pair_matches", f"select g.point_id, g.x as gx, g.y as gy, a.x as ax, a.y as ay from {_TIE} g join {_TIE} a on g.point_id = a.point_id where g.iid = 5 and g.role in ('ground', 'grounds') and a.iid <> 5 and a.iid = 7 and a.role = 'aerials'")
def _(i):
    return G.pair_matches(_tie(i), 5, 7)


@query("J0_match_tracks", f"""with recursive {_KNN}, {_BACK}, m as (select a.iid_i * 4294967296 + a.fid_i as u, a.iid_j * 4294967296 + a.fid_j as v from knn a join knn s using (iid_i, fid_i, iid_j)
      join back b on a.iid_i = b.iid_j and a.fid_i = b.fid_j and a.iid_j = b.iid_i and a.fid_j = b.fid_i where a.rank = 1 and s.rank = 2 and b.rank = 1 and a.dist < 0.9 * s.dist),
    e as (select u, v from m union select v, u from m), reach(x, y) as (select u, u from e union select x, v from reach join e on y = u),
    comp as (select x, min(y) as oid from reach group by x), obs as (select distinct oid, x // 4294967296 as iid from comp)
    select n_views, count(*) as n_tracks from (select oid, count(*) as n_views from obs group by oid) group by n_views""")
def _(i):
    f = i.v_desc
    back = P.image_pairs(f).select(F.col("iid_j").alias("iid_i"), F.col("iid_i").alias("iid_j"))
    good = K.mutual_best(K.ratio_test(_knn(i), 0.9), K.knn_join(f, back, 1))
    return G.track_stats(G.connect_matches(good))
