"""Queries for scalar functions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..streaming import incremental
from .base import query

R6 = lambda c, name: F.round(c, 6).alias(name)


@query("F1_sign_clip_angles", "select k, n, v, sign(d - 0.05e0)::int as s, greatest(10.0, least(w, 40.0)) as clipped, round(radians(w), 6) as rad, round(degrees(d), 6) as deg from {v_numbers}")
def _(i):
    c = F.col
    return i.v_numbers.select("k", "n", "v", S.sign(c("d") - 0.05).alias("s"), S.clip(c("w"), 10.0, 40.0).alias("clipped"), R6(F.radians("w"), "rad"), R6(F.degrees("d"), "deg"))


_NANS = "case when w < 10 then 'nan'::double when w > 45 then 'inf'::double else v end"


@query("F2_nan_inf", f"select k, n, v, isnan({_NANS}) as nan, isinf({_NANS}) as inf, list_bool_or([isnan(x) for x in [{_NANS}, w]]) as any_nan, list_bool_or([isinf(x) for x in [{_NANS}, w]]) as any_inf from {{v_numbers}}")
def _(i):
    x = F.when(F.col("w") < 10, F.lit(float("nan"))).when(F.col("w") > 45, F.lit(float("inf"))).otherwise(F.col("v"))
    return i.v_numbers.select("k", "n", "v", F.isnan(x).alias("nan"), S.is_inf(x).alias("inf"), S.any_nan(F.array(x, F.col("w"))).alias("any_nan"), S.any_inf(F.array(x, F.col("w"))).alias("any_inf"))


@query("F3_almost_zero", "select k, n, v, abs(d * 0.001) < 1e-4 as zero from {v_numbers}")
def _(i):
    return i.v_numbers.select("k", "n", "v", S.almost_zero(F.col("d") * 0.001).alias("zero"))


@query("F4_sigmoid", """select k, n, v, round(1 / (1 + exp(-d * 3)), 6) as sig,
    round((1 / (1 + exp(-(2 * 4.0 * d - 4.0) * 1.5)) - 1 / (1 + exp(4.0 * 1.5))) / (1 / (1 + exp(-4.0 * 1.5)) - 1 / (1 + exp(4.0 * 1.5))), 6) as scaled from {v_numbers}""")
def _(i):
    return i.v_numbers.select("k", "n", "v", R6(S.sigmoid(F.col("d"), 3.0), "sig"), R6(S.scaled_sigmoid(F.col("d"), 1.5, 4.0), "scaled"))


@query("F5_saturate", "select k, n, v, greatest(0, least(v, 255))::double::bigint as u8 from (select k, n, floor(v) as v from {v_numbers})")
def _(i):
    return i.v_numbers.select("k", "n", F.floor("v").cast("double").alias("v")).select("k", "n", "v", S.saturate(F.col("v"), 0, 255, "long").alias("u8"))


@query("F6_choose", "select k, n, w, round(exp(lgamma(w + 1) - lgamma(n + 1) - lgamma(w - n + 1))) as c from (select k, n, floor(w % 20) + 7 as w from {v_numbers})")
def _(i):
    return i.v_numbers.select("k", "n", (F.floor(F.col("w") % 20) + 7).cast("double").alias("w")).select("k", "n", "w", S.choose(F.col("w"), F.col("n")).alias("c"))


@query("F7_strings", """select page_id, replace(url, 'e', 'E') as replaced, starts_with(url, 'https') as secure, false as empty_prefix, ltrim(padded, ' ' || chr(9) || chr(10)) as l,
    rtrim(padded, ' ' || chr(9) || chr(10)) as r, trim(padded, ' ' || chr(9) || chr(10)) as b, lower(upper(url)) as low, page_id::varchar || ':' || url as printed
    from (select page_id, url, ' ' || chr(9) || url || ' ' || chr(10) as padded from {v_names})""")
def _(i):
    url, padded = F.col("url"), F.concat(F.lit(" \t"), F.col("url"), F.lit(" \n"))
    return i.v_names.select("page_id", F.replace(url, F.lit("e"), F.lit("E")).alias("replaced"), S.starts_with(url, F.lit("https")).alias("secure"), S.starts_with(url, F.lit("")).alias("empty_prefix"),
                            S.ltrim(padded).alias("l"), S.rtrim(padded).alias("r"), S.trim(padded).alias("b"), F.lower(F.upper("url")).alias("low"), F.format_string("%d:%s", "page_id", "url").alias("printed"))


@query("F8_split_any", "select page_id, unnest(regexp_split_to_array(url, '[/.?&=]')) as part from {v_names}")
def _(i):
    return i.v_names.select("page_id", F.explode(S.split_any(F.col("url"), "/.?&=")).alias("part"))


@query("F9_csv_values", """select k, n, s, [x::double for x in [trim(y) for y in regexp_split_to_array(s, '[,;]')] if x <> ''] as vals,
    array_to_string([n, n + 1], ', ') as txt from (select k, n, v, case when w > 49 then 'x;1' else n::varchar || ' ; ' || (n * 2)::varchar || ',,' || '7' end as s from {v_numbers}) where s <> 'x;1'
    union all select k, n, 'x;1', []::double[], array_to_string([n, n + 1], ', ') from {v_numbers} where w > 49""")
def _(i):
    s = F.when(F.col("w") > 49, F.lit("x;1")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" ; "), (F.col("n") * 2).cast("string"), F.lit(",,7")))
    return i.v_numbers.select("k", "n", s.alias("s"), S.csv_values(s).alias("vals"), S.csv_text(F.array(F.col("n"), F.col("n") + 1)).alias("txt"))


@query("F10_paths", r"""with p as (select page_id, '/data/' || page_id::varchar || '\sub/im' || (page_id % 7)::varchar || '.tar.JPG' as path from {v_names})
    select page_id, '.JPG' as ext, '/data/' || page_id::varchar || '/sub' as dir, 'im' || (page_id % 7)::varchar || '.tar.JPG' as file, 'im' || (page_id % 7)::varchar as base,
    '/data/' || page_id::varchar || '/sub/im' || (page_id % 7)::varchar || '.tar' as root, true as jpg, '/data/' || page_id::varchar || '/sub/x' as joined, 'a/' as slash from p""")
def _(i):
    path = F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("\\sub/im"), (F.col("page_id") % 7).cast("string"), F.lit(".tar.JPG"))
    return i.v_names.select("page_id", S.extension(path).alias("ext"), S.directory(path).alias("dir"), S.file_name(path).alias("file"), S.base_name(path).alias("base"), S.root_of(path).alias("root"),
                            S.has_extension(path, ".jpg").alias("jpg"), S.join_path(S.with_slash(S.directory(path)), F.lit("x")).alias("joined"), S.with_slash(F.lit("a")).alias("slash"))


@query("F11_vectors", """select pid, round(x * nx + y * ny + z * nz, 6) as dp, round(sqrt(x * x + y * y + z * z), 6) as len, round(y * nz - z * ny, 6) as c0, round(z * nx - x * nz, 6) as c1, round(x * ny - y * nx, 6) as c2,
    round(x / (z + 1), 6) as h0, round(y / (z + 1), 6) as h1, round(2 / (2 * (z + 2) - 1), 6) as i3,
    round(1.0 / (z + 3), 6) as i00 from {v_points3d}""")
def _(i):
    p, n = [F.col(c) for c in ("x", "y", "z")], [F.col(c) for c in ("nx", "ny", "nz")]
    cr, h = S.cross(p, n), S.dehomogenize([p[0], p[1], p[2] + 1])
    one, zero = F.lit(1.0), F.lit(0.0)
    inv2, inv3 = S.inverse2([F.lit(2.0), one, one, p[2] + 2]), S.inverse3([p[2] + 3, zero, zero, zero, one, zero, zero, zero, one])
    return i.v_points3d.select("pid", R6(S.dot(p, n), "dp"), R6(S.norm(p), "len"), R6(cr[0], "c0"), R6(cr[1], "c1"), R6(cr[2], "c2"), R6(h[0], "h0"), R6(h[1], "h1"), R6(inv2[3], "i3"), R6(inv3[0], "i00"))


@query("F12_quantize", "select pid, round((x + nx) * 1000)::bigint as q, round(round((x + nx) * 1000) / 1000.0, 6) as back from {v_points3d}")
def _(i):
    q = S.quantize(F.col("x") + F.col("nx"))
    return i.v_points3d.select("pid", q.alias("q"), R6(q / 1000.0, "back"))


@query("F13_segments", """with s as (select a.iid_i, a.fid_i as f, b.fid_i as g, a.x1 as ax, a.y1 as ay, a.x2 as bx, a.y2 as by_, b.x1 as cx, b.y1 as cy, b.x2 as dx, b.y2 as dy
      from {v_matches} as a join {v_matches} as b on a.iid_i = b.iid_i and b.fid_i = a.fid_i + 1),
    o as (select *, sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) as o1, sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) as o2,
      sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) as o3, sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) as o4 from s)
    select iid_i, f, g, (o1 <> o2 and o3 <> o4) as crossing from o where o1 <> 0 and o2 <> 0 and o3 <> 0 and o4 <> 0""")
def _(i):
    a, b = i.v_matches.alias("a"), i.v_matches.alias("b")
    j = a.join(b, (F.col("a.iid_i") == F.col("b.iid_i")) & (F.col("b.fid_i") == F.col("a.fid_i") + 1))
    c = [F.col(x) for x in ("a.x1", "a.y1", "a.x2", "a.y2", "b.x1", "b.y1", "b.x2", "b.y2")]
    o = [S.turn(*c[:4], *c[4:6]), S.turn(*c[:4], *c[6:]), S.turn(*c[4:], *c[:2]), S.turn(*c[4:], *c[2:4])]
    return j.filter((o[0] != 0) & (o[1] != 0) & (o[2] != 0) & (o[3] != 0)).select(F.col("a.iid_i"), F.col("a.fid_i").alias("f"), F.col("b.fid_i").alias("g"), S.segments_touch(*c).alias("crossing"))


@query("F14_line_distance", "select iid_i, fid_i, round(power((x2 - x1) * (50 - y1) - (y2 - y1) * (70 - x1), 2) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 4) as d2 from {v_matches} where x1 <> x2 or y1 <> y2")
def _(i):
    c = [F.col(x) for x in ("x1", "y1", "x2", "y2")]
    return i.v_matches.filter("x1 <> x2 or y1 <> y2").select("iid_i", "fid_i", F.round(S.line_distance2(F.lit(70.0), F.lit(50.0), *c), 4).alias("d2"))


@query("A4_stats", "select grp, round(avg(w), 6) as mean, round(var_samp(w), 6) as variance, round(stddev_samp(w), 6) as stddev, round(sqrt(avg(w * w)), 6) as rmse from {v_numbers} group by grp")
def _(i):
    s = A.stats(i.v_numbers, "w", ["grp"])
    return s.select("grp", *(R6(F.col(c), c) for c in ("mean", "variance", "stddev", "rmse")))


@query("A5_median", "select grp, n, round(median(v), 6) as median from {v_numbers} group by grp, n")
def _(i):
    return A.median(i.v_numbers, "v", ["grp", "n"]).withColumn("median", F.round("median", 6))


@query("A6_percentile_nearest", """select grp, v as percentile from (select grp, v, row_number() over (partition by grp order by v) - 1 as r, count(*) over (partition by grp) as n from {v_numbers})
    where r = round(0.35 * (n - 1))""")
def _(i):
    return A.percentile_nearest(i.v_numbers, "v", 35, ["grp"])


@query("A7_any", "select grp, n, bool_or(v < 950) as any_less, bool_or(v > 90000) as any_greater from {v_numbers} group by grp, n")
def _(i):
    by = ["grp", "n"]
    return A.any_less_than(i.v_numbers, "v", 950, by).join(A.any_greater_than(i.v_numbers, "v", 90000, by), by)


@query("A19_array_tests", "select k, len(list_distinct(xs)) < len(xs) as dups, list_contains(xs, 3) as has3 from (select k, list(n) as xs from {v_numbers} group by k)")
def _(i):
    g = i.v_numbers.groupBy("k").agg(F.collect_list("n").alias("xs"))
    return g.select("k", (F.size(F.array_distinct("xs")) < F.size("xs")).alias("dups"), F.array_contains("xs", 3).alias("has3"))


@query("U6_erase_if", "select k, n, v from {v_numbers} where not (w > 25)")
def _(i):
    return i.v_numbers.filter(~(F.col("w") > 25)).select("k", "n", "v")


@query("S23_pending", "select iid, fid from {v_features} where fid % 2 = 1")
def _(i):
    f = i.v_features.select("iid", "fid")
    return incremental.pending(f, f.filter("fid % 2 = 0"), ["fid"])


@query("I1_resume", "select iid, count(*) as n from {v_features} where iid % 4 <> 1 group by iid")
def _(i):
    f = i.v_features
    return incremental.pending(f, f.filter("iid % 4 = 1").select("iid").distinct(), ["iid"]).groupBy("iid").agg(F.count(F.lit(1)).alias("n"))
