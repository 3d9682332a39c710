"""Deterministic views over the given tables, as text that Spark SQL and DuckDB both read.

{name} stands for a table or for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import table

VIEWS = {
    "v_desc": "select cast(label as bigint) as iid, vec_id as fid, embedding as vec from {embeddings}",
    "v_features": """select l_orderkey % 8 as iid, l_orderkey * 8 + l_linenumber as fid, min(l_extendedprice) % 4000 as x,
       cast((min(l_partkey) * 37 + l_orderkey * 11) % 3000 as double) as y, min(l_quantity) as response
       from {lineitem} group by l_orderkey, l_linenumber""",
    "v_match_chain": """select least(o_orderkey % 16, nk % 16) as iid_i, case when o_orderkey % 16 <= nk % 16 then o_orderkey else nk end as fid_i,
       greatest(o_orderkey % 16, nk % 16) as iid_j, case when o_orderkey % 16 <= nk % 16 then nk else o_orderkey end as fid_j
       from (select o_custkey, o_orderkey, o_orderdate, lead(o_orderkey) over w as nk, lead(o_orderdate) over w as nd
             from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)) o
       where nk is not null and cast(nd as date) <= cast(o_orderdate as date) + interval 60 days""",
    # the same features over 1024 images
    "v_keypoints": "select cast(floor(fid / 8e0) as bigint) % 1024 as iid, fid, x, y, response from {v_features}",
    # features of two neighbouring images with equal rank along x, as matches with coordinates
    "v_matches": """select a.iid as iid_i, b.iid as iid_j, a.fid as fid_i, b.fid as fid_j, a.x as x1, a.y as y1, b.x as x2, b.y as y2, a.response + b.response as response
       from (select *, row_number() over (partition by iid order by x, fid) as n from {v_keypoints}) a
       join (select *, row_number() over (partition by iid order by x, fid) as n from {v_keypoints}) b on b.iid = a.iid + 1 and a.n = b.n""",
    "v_pixels": """select cast(floor(l_suppkey / 5e0) as bigint) as image_id, cast(l_partkey % 64 as int) as r, cast(l_orderkey % 64 as int) as c, max(l_quantity) as dsm, min(l_quantity) as dem, count(*) as n
       from {lineitem} group by floor(l_suppkey / 5e0), l_partkey % 64, l_orderkey % 64""",
    "v_photos": """select s_suppkey as iid, cast(s_nationkey as bigint) as cid, cast(s_suppkey * 13 % 101 - 50 as double) as cx, cast(s_suppkey * 29 % 101 - 50 as double) as cy,
       40.0e0 + (s_acctbal % 20) as cz, cos(s_suppkey * 0.1e0) as r00, sin(s_suppkey * 0.1e0) as r01, 0.0e0 as r02,
       sin(s_suppkey * 0.1e0) as r10, -cos(s_suppkey * 0.1e0) as r11, 0.0e0 as r12, 0.0e0 as r20, 0.0e0 as r21, -1.0e0 as r22 from {supplier}""",
    "v_cameras": """select cast(n_nationkey as bigint) as cid, 4000 as width, 3000 as height, 3000.0e0 + 10.0e0 * n_nationkey as f, 1999.5e0 as u0, 1499.5e0 as v0,
       -0.01e0 as k1, 0.001e0 as k2, 0.0e0 as k3, 0.0001e0 * n_regionkey as p1, -0.0001e0 * n_regionkey as p2 from {nation}""",
    "v_points3d": """select p_partkey as pid, cast(p_partkey * 7 % 100 - 50 as double) as x, cast(p_partkey * 11 % 100 - 50 as double) as y, cast(p_size % 10 as double) as z,
       sin(p_size * 0.02e0) as nx, 0.0e0 as ny, cos(p_size * 0.02e0) as nz from {part}""",
    "v_polygons": """select cast(n_nationkey as bigint) as poly_id, (n_nationkey % 5) * 20000 - 50000 as x0, cast(floor(n_nationkey / 5.0e0) as int) * 20000 - 50000 as y0,
       18000 as side, 5000 as hole0, 9000 as hole1 from {nation}""",
    "v_triangles": """select p_partkey as tid, cast(p_partkey * 7 % 100 - 50 as double) as ax, cast(p_partkey * 11 % 100 - 50 as double) as ay, cast(p_size % 20 as double) as az,
       cast(p_partkey * 7 % 100 - 50 as double) + 4.0e0 as bx, cast(p_partkey * 11 % 100 - 50 as double) as by_, cast(p_size % 20 as double) as bz,
       cast(p_partkey * 7 % 100 - 50 as double) as cx, cast(p_partkey * 11 % 100 - 50 as double) + 4.0e0 as cy, cast(p_size % 7 as double) as cz from {part}""",
    "v_numbers": "select l_returnflag as grp, l_extendedprice as v, l_quantity as w, l_orderkey as k, l_linenumber as n, l_discount as d from {lineitem}",
    "v_names": "select page_id, url from {pages}",
}


def text(sql: str) -> str:
    """SQL with every view written out, for DuckDB."""

    def put(m: re.Match) -> str:
        name = m[1]
        return f"({text(VIEWS[name])}) as {name}" if name in VIEWS else name

    def nested(m: re.Match) -> str:
        name, alias = m[1], m[2]
        return f"({text(VIEWS[name])}) as {alias}" if name in VIEWS else f"{name} as {alias}"

    sql = re.sub(r"\{(\w+)\} as (\w+)", nested, sql)
    return re.sub(r"\{(\w+)\}", put, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    needed = sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))
    inputs = {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in needed}
    return spark.sql(VIEWS[name], **inputs)
