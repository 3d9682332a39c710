"""Camera blocks as XML and JSON, tracks, match results and tie points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cameras import ROTATION, apply_orientation, normalize_cameras
from ..operators.graph import nest_results, nest_tracks, unnest_results, unnest_tracks

_POINT = "struct<x: double, y: double, z: double>"
_MATRIX = "struct<" + ", ".join(f"M_{i}{j}: double" for i in range(3) for j in range(3)) + ">"
_GROUP = f"""Name string, ImageDimensions struct<Width: int, Height: int>, FocalLength double, FocalLengthPixels double, SensorSize double, CameraOrientation string,
    PrincipalPoint struct<x: double, y: double>, Distortion struct<K1: double, K2: double, K3: double, P1: double, P2: double>,
    Photo array<struct<Id: bigint, ImagePath: string, Pose: struct<Rotation: {_MATRIX}, Center: {_POINT}>, NearDepth: double, MedianDepth: double, FarDepth: double>>"""


def _tables(groups: DataFrame, p1: Column, p2: Column, origin: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    cameras = groups.select(
        "cid", F.col("ImageDimensions.Width").alias("width"), F.col("ImageDimensions.Height").alias("height"), F.col("FocalLengthPixels").alias("f"), F.col("FocalLength").alias("f_mm"), F.col("SensorSize").alias("sensor_mm"),
        F.col("PrincipalPoint.x").alias("u0"), F.col("PrincipalPoint.y").alias("v0"), *(F.col(f"Distortion.{k}").alias(k.lower()) for k in ("K1", "K2", "K3")), p1.alias("p1"), p2.alias("p2"), F.col("CameraOrientation").alias("orientation"),
    )
    photos = groups.select("cid", F.explode("Photo").alias("p"))
    pose, centre = F.col("p.Pose.Rotation"), F.col("p.Pose.Center")
    rotation = [pose[f"M_{r[1]}{r[2]}"].alias(r) for r in ROTATION]
    at = [(centre[k] - o).alias("c" + k) for k, o in zip("xyz", origin, strict=True)]
    photos = photos.select(F.col("p.Id").alias("iid"), "cid", F.col("p.ImagePath").alias("path"), *at, F.col("p.NearDepth").alias("znear"), F.col("p.MedianDepth").alias("zmed"), F.col("p.FarDepth").alias("zfar"), *rotation)
    # only photos with a full pose
    for c in ("cx", "cy", "cz", *ROTATION):
        photos = photos.filter(F.col(c).isNotNull())
    cameras = normalize_cameras(cameras)
    return cameras.drop("f_mm", "sensor_mm", "orientation"), apply_orientation(photos, cameras)


def read_block_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """cameras and photos of a block in XML; cid numbers the photo groups of a file by their order.

    The XML convention names the two tangential coefficients the other way round; they are swapped here, once.
    """
    schema = T._parse_datatype_string(_GROUP)
    groups = spark.read.format("xml").option("rowTag", "Photogroup").schema(schema).load(path)
    groups = groups.withColumn("cid", F.monotonically_increasing_id())
    return _tables(groups, F.col("Distortion.P2"), F.col("Distortion.P1"), (0, 0, 0))


def read_block_json(spark: SparkSession, path: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """cameras and photos of blocks in JSON, moved so that origin is zero; no swap of the tangential coefficients."""
    schema = T._parse_datatype_string(f"cid bigint, {_GROUP}")
    groups = spark.read.schema(T.StructType([T.StructField("Photogroups", T.ArrayType(schema))])).option("multiLine", "true").json(path).select(F.explode("Photogroups").alias("g")).select("g.*")
    return _tables(groups, F.col("Distortion.P1"), F.col("Distortion.P2"), origin)


def block_rows(cameras: DataFrame, photos: DataFrame) -> DataFrame:
    """One nested row a camera, with orientation XRightYDown."""
    pose = F.struct(F.struct(*(F.col(r).alias(f"M_{r[1]}{r[2]}") for r in ROTATION)).alias("Rotation"), F.struct(*(F.col("c" + k).alias(k) for k in "xyz")).alias("Center"))
    photo = F.struct(F.col("iid").alias("Id"), F.col("path").alias("ImagePath"), pose.alias("Pose"), F.col("znear").alias("NearDepth"), F.col("zmed").alias("MedianDepth"), F.col("zfar").alias("FarDepth"))
    listed = photos.groupBy("cid").agg(F.sort_array(F.collect_list(photo)).alias("Photo"))
    return cameras.join(listed, "cid").select(
        "cid", F.struct(F.col("width").alias("Width"), F.col("height").alias("Height")).alias("ImageDimensions"), F.col("f").alias("FocalLengthPixels"), F.lit("XRightYDown").alias("CameraOrientation"), F.lit(1.0).alias("AspectRatio"), F.lit(0.0).alias("Skew"),
        F.struct(F.col("u0").alias("x"), F.col("v0").alias("y")).alias("PrincipalPoint"), F.struct(*(F.col(k.lower()).alias(k) for k in ("K1", "K2", "K3", "P1", "P2"))).alias("Distortion"), "Photo",
    )


def write_block_json(cameras: DataFrame, photos: DataFrame, path: str) -> None:
    """A block for read_block_json: groups are few, and one file holds them."""
    block_rows(cameras, photos).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("Photogroups")).write.json(path)


def write_tracks(observations: DataFrame, path: str, form: str = "parquet") -> None:
    nest_tracks(observations).write.format(form).save(path)


def read_tracks(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    # JSON has text keys only
    key = "string" if form == "json" else "bigint"
    schema = f"oid bigint, obs map<{key}, struct<fid: bigint, x: double, y: double>>"
    return unnest_tracks(spark.read.format(form).schema(schema).load(path)).withColumn("iid", F.col("iid").cast("long"))


def write_results(tie_points: DataFrame, path: str) -> None:
    nest_results(tie_points).write.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return unnest_results(spark.read.parquet(path))


def merged_measurements(tie_points: DataFrame, names: DataFrame) -> DataFrame:
    """Measurements with the merged id of their photo (iid, merged_iid); those without one are dropped."""
    return tie_points.join(names.filter("merged_iid is not null").select("iid", "merged_iid"), "iid").select("point_id", "role", F.col("merged_iid").alias("iid"), "x", "y")


def tie_point_rows(tie_points: DataFrame) -> DataFrame:
    """One nested row a point, as the survey XML has it."""
    m = F.struct(F.col("iid").alias("PhotoId"), "x", "y")
    return tie_points.groupBy(F.col("point_id").alias("Id")).agg(F.sort_array(F.collect_list(m)).alias("Measurement"))


def write_tie_points_xml(tie_points: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Tie points as XML, at most per_file points to a file: a file is read by one task."""
    tie_point_rows(tie_points).write.format("xml").option("maxRecordsPerFile", per_file).option("rootTag", "TiePoints").option("rowTag", "TiePoint").save(path)


def merge_tie_points(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing tie points with new ones after them: ids of new start beyond those that exist."""
    top = F.broadcast(existing.agg(F.coalesce(F.max("point_id") + 1, F.lit(0)).alias("shift")))
    moved = new.join(top, F.lit(True)).withColumn("point_id", F.col("point_id") + F.col("shift"))
    return existing.unionByName(moved.select(*existing.columns), allowMissingColumns=False)
