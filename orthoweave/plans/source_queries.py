"""Queries for sources and sinks: each writes what the tables give to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import shared_folder
from ..sources import blocks, files
from ..streaming.incremental import load_or_compute
from .base import query
from .match_queries import _COMP, _TIE, _tie


def _path(i, name):
    return f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def _observations(i):
    return G.connect_matches(i.v_match_chain).withColumns({"x": (F.col("fid") * 3 % 4000).cast("double"), "y": (F.col("fid") * 7 % 3000).cast("double")})


_OBS = f"with {_COMP} select oid, iid, fid, (fid * 3 % 4000)::double as x, (fid * 7 % 3000)::double as y from obs"


@query("S9_tracks_parquet", _OBS)
def _(i):
    p = _path(i, "tracks")
    blocks.write_tracks(_observations(i), p)
    return blocks.read_tracks(i.spark, p).select("oid", "iid", "fid", "x", "y")


@query("S9_tracks_json", _OBS)
def _(i):
    p = _path(i, "tracks")
    blocks.write_tracks(_observations(i), p, "json")
    return blocks.read_tracks(i.spark, p, "json").select("oid", "iid", "fid", "x", "y")


@query("S10_results", f"select point_id, role, iid, x, y from {_TIE}")
def _(i):
    p = _path(i, "results")
    blocks.write_results(_tie(i), p)
    return blocks.read_results(i.spark, p)


def _names(i):
    return i.supplier.select(F.col("s_suppkey").alias("iid"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") + 1000).alias("merged_iid"))


@query("S11_tie_points_xml", f"select t.point_id, iid + 1000 as iid, x, y from {_TIE} t where iid % 3 <> 0 and iid in (select s_suppkey from supplier)")
def _(i):
    p = _path(i, "tie-points")
    blocks.write_tie_points_xml(blocks.merged_measurements(_tie(i), _names(i)), p)
    back = i.spark.read.format("xml").option("rowTag", "TiePoint").schema("Id bigint, Measurement array<struct<PhotoId: bigint, x: double, y: double>>").load(p)
    return back.select(F.col("Id").alias("point_id"), F.explode("Measurement").alias("m")).select("point_id", F.col("m.PhotoId").alias("iid"), "m.x", "m.y")


@query("S12_merge_tie_points", f"select point_id, role, iid, x, y from {_TIE} t where point_id % 2 = 0 union all select point_id + (select max(point_id) + 1 from {_TIE} m where point_id % 2 = 0), role, iid, x, y from {_TIE} u where point_id % 2 = 1")
def _(i):
    t = _tie(i)
    return blocks.merge_tie_points(t.filter("point_id % 2 = 0"), t.filter("point_id % 2 = 1"))


@query("S15_read_lines", "select doc_id, trim(line, ' ' || chr(9) || chr(10) || chr(13)) as line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(trim(line, ' ' || chr(9) || chr(10) || chr(13))) > 0")
def _(i):
    lines = i.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return files.trimmed_lines(lines, "line")


@query("S13_points", "select x, y, z from {v_points3d}")
def _(i):
    p = _path(i, "points")
    files.write_points(i.v_points3d, p)
    return files.read_points(i.spark, p)


@query("S14_polygons", "select poly_id, 4 as n, x0::double as x0, (y0 + side)::double as y1 from {v_polygons}")
def _(i):
    from .spatial_queries import _polygons

    p = _path(i, "polygons")
    files.write_polygons(_polygons(i), p)
    r = files.read_polygons(i.spark, p)
    return r.select("poly_id", F.size(F.col("rings")[0]).alias("n"), F.array_min(F.col("rings")[0]["x"]).alias("x0"), F.array_max(F.col("rings")[0]["y"]).alias("y1"))


@query("S16_list_files", "select count(*) as n from (select distinct l_returnflag, l_linestatus from lineitem)")
def _(i):
    p = _path(i, "listed")
    i.lineitem.groupBy("l_returnflag", "l_linestatus").count().coalesce(1).write.partitionBy("l_returnflag", "l_linestatus").json(p)
    return files.list_files(i.spark, p, "*.json").agg(F.count(F.lit(1)).alias("n"))


@query("S2_S5_block_json", "select iid, p.cid, round(cx - 10, 6) as cx, round(r00, 6) as r00, round(r11, 6) as r11, f, p1, p2 from {v_photos} as p join {v_cameras} as c on p.cid = c.cid")
def _(i):
    p = _path(i, "block")
    photos = i.v_photos.withColumns({"path": F.concat(F.lit("a/"), F.col("iid").cast("string"), F.lit(".jpg")), "znear": F.lit(1.0), "zmed": F.lit(2.0), "zfar": F.lit(3.0)})
    blocks.write_block_json(i.v_cameras, photos, p)
    cams, back = blocks.read_block_json(i.spark, p, (10.0, 0.0, 0.0))
    return back.join(cams, "cid").select("iid", "cid", F.round("cx", 6).alias("cx"), F.round("r00", 6).alias("r00"), F.round("r11", 6).alias("r11"), "f", "p1", "p2")


@query("S1_block_xml", "select iid, round(cx, 6) as cx, round(r00, 6) as r00, f, -p1 as p1, -p2 as p2 from {v_photos} as p join {v_cameras} as c on p.cid = c.cid")
def _(i):
    p = _path(i, "block")
    photos = i.v_photos.withColumns({"path": F.concat(F.lit("a/"), F.col("iid").cast("string"), F.lit(".jpg")), "znear": F.lit(1.0), "zmed": F.lit(2.0), "zfar": F.lit(3.0)})
    # the given cameras have p1 = -p2, so a swap shows as a change of sign
    blocks.block_rows(i.v_cameras, photos).write.format("xml").option("rootTag", "Photogroups").option("rowTag", "Photogroup").save(p)
    cams, back = blocks.read_block_xml(i.spark, p)
    return back.join(cams, "cid").select("iid", F.round("cx", 6).alias("cx"), F.round("r00", 6).alias("r00"), "f", (F.col("p1") + 0.0).alias("p1"), (F.col("p2") + 0.0).alias("p2"))


@query("I3_load_or_compute", "select iid, count(*) as n from {v_features} group by iid")
def _(i):
    p = _path(i, "cached")
    compute = lambda: i.v_features.groupBy("iid").agg(F.count(F.lit(1)).alias("n"))
    load_or_compute(i.spark, p, compute)
    return load_or_compute(i.spark, p, compute)


# -- feature and match files: written by tasks, scanned again -------------------------------------------------

_BYTES = "[((fid * 7 + k * 13) % 256)::int for k in range(128)]"


def _keypoints(i):
    desc = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: ((F.col("fid") * 7 + k * 13) % 256).cast("int"))
    return i.v_keypoints.select(F.concat(F.lit("image"), F.col("iid").cast("string"), F.lit(".bin")).alias("path"), "fid", "x", "y", (F.col("fid") % 5 + 1.5).alias("size"), (F.col("fid") % 360).cast("double").alias("angle"), F.col("response").cast("double").alias("response"), desc.alias("desc"))


def _named(rows):
    """Rows with the name of their file for its path."""
    return rows.withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


@query("S6_feature_files", f"select 'image' || iid || '.bin' as path, row_number() over (partition by iid order by fid) - 1 as fid, x::float::double as x, y::float::double as y, (fid % 5 + 1.5)::double as size, (fid % 360)::double as angle, response::float::double as response, {_BYTES} as desc from {{v_keypoints}}")
def _(i):
    p = _path(i, "keypoints")
    files.write_files(files.encode_sift(_keypoints(i)), p)
    return _named(files.load_sift_dir(i.spark, p, "*.bin"))


@query("S7_point_files", f"""select 'image' || iid || '.bin' as path, row_number() over (partition by iid order by fid) - 1 as fid, x::float::double as x, y::float::double as y, case when iid % 2 = 0 then {_BYTES} end as desc from {{v_keypoints}}""")
def _(i):
    even = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 2 == 0
    p = _path(i, "points")
    files.write_files(files.encode_features(_keypoints(i).withColumn("desc", F.when(even, F.col("desc")))), p)
    return _named(files.load_feature_dir(i.spark, p))


@query("S8_match_files", "select iid_i || '_' || iid_j as path, fid_i, fid_j, null::double as dist from {v_match_chain} union all select iid_i || '-' || iid_j, fid_i, fid_j, ((fid_i + fid_j) % 97 / 4.0)::double from {v_match_chain}")
def _(i):
    m = i.v_match_chain
    name = lambda sign: F.concat(F.col("iid_i").cast("string"), F.lit(sign), F.col("iid_j").cast("string")).alias("path")
    p = _path(i, "matches")
    files.write_files(files.encode_matches(m.select(name("_"), "fid_i", "fid_j")), p)
    scored = files.encode_matches(m.select(name("-"), "fid_i", "fid_j", ((F.col("fid_i") + F.col("fid_j")) % 97 / 4.0).alias("dist")), scored=True)
    files.write_files(scored, p)
    # two kinds of files in one folder, told apart by their names
    return _named(files.load_match_dir(i.spark, p, pattern="[0-9]*_[0-9]*").unionByName(files.load_match_dir(i.spark, p, scored=True, pattern="[0-9]*-[0-9]*")))
