"""Match graphs: connected components, tracks and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large stars and small stars over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u > v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """vertex, component for every end of an edge; a component is named by its least vertex.

    Alternating large and small stars: rounds grow with the logarithm of the diameter. Each round is
    written to the shared folder, so its lineage stays short and a lost executor repeats one round.
    Edges with a null end are dropped; a self-loop makes its vertex a component. Loops until the edges
    no longer change; more than max_rounds is an error, never a partial answer.
    """
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null")
    pairs = stage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components-edges")
    vertices = pairs.select(F.col("u").alias("vertex")).union(pairs.select("v")).distinct()
    current, mark = pairs.filter("u > v"), None
    for _ in range(max_rounds):
        current = stage(_stars(current), "components-round")
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen.n, seen.x) == mark:
            # each vertex now points at the least vertex of its component
            return vertices.join(current.withColumnRenamed("u", "vertex"), "vertex", "left").select("vertex", F.coalesce("v", "vertex").alias("component"))
        mark = (seen.n, seen.x)
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


# -- tracks -------------------------------------------------------------------------------------


def vertices(matches: DataFrame) -> DataFrame:
    """Distinct (iid, fid) of both ends."""
    ends = matches.select(F.col("iid_i").alias("iid"), F.col("fid_i").alias("fid")).union(matches.select("iid_j", "fid_j"))
    return ends.distinct()


def image_indices(features: DataFrame) -> DataFrame:
    return features.select("iid").distinct().orderBy("iid")


def list_pairs(matches: DataFrame) -> DataFrame:
    """Distinct image pairs with the number of matches, and how many rows break iid_i <= iid_j."""
    return matches.groupBy("iid_i", "iid_j").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(F.col("iid_i") > F.col("iid_j")).alias("n_wrong")).orderBy("iid_i", "iid_j")


def _vertex(iid, fid):
    """One long for (iid, fid): ids are unsigned 32-bit."""
    return F.shiftleft(F.col(iid), 32) + F.col(fid)


def connect_matches(matches: DataFrame, conflict: str = "min_fid") -> DataFrame:
    """Tracks: oid, iid, fid of the connected components of the match graph; oid is the least vertex.

    conflict: what to do where a track has two features of one image. min_fid keeps the least, drop
    leaves the whole track out, keep keeps all.
    """
    edges = matches.select(_vertex("iid_i", "fid_i").alias("u"), _vertex("iid_j", "fid_j").alias("v"))
    members = connected_components(edges).select(F.col("component").alias("oid"), F.shiftright("vertex", 32).alias("iid"), F.col("vertex").bitwiseAND((1 << 32) - 1).alias("fid"))
    if conflict == "keep":
        return members
    one = members.groupBy("oid", "iid").agg(F.min("fid").alias("fid"), F.count(F.lit(1)).alias("n"))
    if conflict == "drop":
        one = one.join(one.filter("n > 1").select("oid").distinct(), "oid", "left_anti")
    elif conflict != "min_fid":
        raise ValueError(f"unknown conflict policy {conflict}")
    return one.select("oid", "iid", "fid")


def track_stats(observations: DataFrame) -> DataFrame:
    """n_views, n_tracks: how many tracks are seen by how many images."""
    per_track = observations.groupBy("oid").agg(F.count(F.lit(1)).alias("n_views"))
    return per_track.groupBy("n_views").agg(F.count(F.lit(1)).alias("n_tracks")).orderBy("n_views")


def assign_oid(df: DataFrame, key: str, into: str = "oid") -> DataFrame:
    """Numbers 0.. for the distinct values of key in ascending order, without a global window.

    Keys are range-partitioned and numbered inside their partition; the counts of the partitions (one
    row each) give the offsets.
    """
    keys = stage(df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), "oid-keys")
    counts = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    offsets = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    numbered = keys.select(key, "part", number.alias("number")).join(F.broadcast(offsets), "part").select(key, (F.col("number") + F.col("offset")).cast("long").alias(into))
    return df.join(numbered, key)


def merge_tracks_only_oid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two track sets; the ids of b start after those of a."""
    top = a.agg(F.coalesce(F.max("oid"), F.lit(-1)).alias("top"))
    moved = b.join(F.broadcast(top), F.lit(True)).withColumn("oid", F.col("oid") + F.col("top") + 1)
    return a.unionByName(moved.select(*a.columns))


def merge_tracks_with_fid(*tracks: DataFrame) -> DataFrame:
    """Tracks that share an (image, feature) become one: each track is a star around its least observation."""
    stars = None
    for n, t in enumerate(tracks):
        seen = t.select("oid", _vertex("iid", "fid").alias("v"))
        hub = seen.groupBy("oid").agg(F.min("v").alias("u"))
        star = seen.join(hub, "oid").select("u", "v")
        stars = star if stars is None else stars.unionByName(star)
    members = connected_components(stars).select(F.col("component").alias("oid"), F.shiftright("vertex", 32).alias("iid"), F.col("vertex").bitwiseAND((1 << 32) - 1).alias("fid"))
    return members.groupBy("oid", "iid").agg(F.min("fid").alias("fid"))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def nest_tracks(observations: DataFrame) -> DataFrame:
    """oid and a map iid -> (fid, x, y)."""
    return observations.groupBy("oid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("iid", F.struct("fid", "x", "y").alias("obs"))))).alias("obs"))


def unnest_tracks(nested: DataFrame) -> DataFrame:
    return nested.select("oid", F.explode("obs").alias("iid", "o")).select("oid", "iid", "o.*")


def nest_results(tie_points: DataFrame) -> DataFrame:
    """point_id with the observations of each role as a sorted array."""
    return tie_points.groupBy("point_id", "role").agg(F.sort_array(F.collect_list(F.struct("iid", "x", "y"))).alias("obs"))


def unnest_results(nested: DataFrame) -> DataFrame:
    return nested.select("point_id", "role", F.explode("obs").alias("o")).select("point_id", "role", "o.*")


def require_roles(tie_points: DataFrame) -> DataFrame:
    """Points with an aerial observation and one of another ground image."""
    good = tie_points.groupBy("point_id").agg(F.count_if(F.col("role") == "aerials").alias("a"), F.count_if(F.col("role") == "grounds").alias("g")).filter("a > 0 and g > 0").select("point_id")
    return tie_points.join(good, "point_id", "left_semi")


def pair_matches(tie_points: DataFrame, ground: int, aerial: int) -> DataFrame:
    """Points seen in both images: x, y in each."""
    g = tie_points.filter((F.col("iid") == ground) & F.col("role").isin("ground", "grounds")).select("point_id", F.col("x").alias("gx"), F.col("y").alias("gy"))
    a = tie_points.filter((F.col("iid") == aerial) & (F.col("role") == "aerials")).select("point_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    return g.join(a, "point_id")
