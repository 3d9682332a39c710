"""Camera tables: defaults, orientation, projection, visibility. photos(iid, cid, cx, cy, cz, r00..r22), cameras(cid, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]

# Axis conventions and the rotation from each to x right, y down.
ORIENTATIONS = {
    "XRightYDown": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "XLeftYDown": (-1, 0, 0, 0, 1, 0, 0, 0, -1),
    "XLeftYUp": (-1, 0, 0, 0, -1, 0, 0, 0, 1),
    "XRightYUp": (1, 0, 0, 0, -1, 0, 0, 0, -1),
    "XDownYRight": (0, 1, 0, 1, 0, 0, 0, 0, -1),
    "XDownYLeft": (0, -1, 0, 1, 0, 0, 0, 0, 1),
    "XUpYLeft": (0, -1, 0, -1, 0, 0, 0, 0, -1),
    "XUpYRight": (0, 1, 0, -1, 0, 0, 0, 0, 1),
}


def small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if Catalyst's bound on its size allows; else as it is, for Spark to choose."""
    from ..session import size_in_bytes

    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def normalize_cameras(cameras: DataFrame) -> DataFrame:
    """Focal length in pixels (from f_mm and sensor_mm where f is null), principal point (image centre), distortion (0)."""
    pixel = F.col("sensor_mm") / F.greatest("width", "height")
    out = cameras.withColumn("f", F.coalesce("f", F.try_divide(F.col("f_mm"), pixel)))
    out = out.withColumn("u0", F.coalesce("u0", (F.col("width") - 1) / 2)).withColumn("v0", F.coalesce("v0", (F.col("height") - 1) / 2))
    for c in ("k1", "k2", "k3", "p1", "p2"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return out


def apply_orientation(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """R <- O R with O by the camera's orientation name; unknown or null names leave R."""
    rows = [(k, *map(float, v)) for k, v in ORIENTATIONS.items()]
    o = [f"o{i}{j}" for i in range(3) for j in range(3)]
    table = photos.sparkSession.createDataFrame(rows, "orientation string, " + ", ".join(f"{c} double" for c in o))
    named = cameras.select("cid", "orientation").join(F.broadcast(table), "orientation", "left").drop("orientation")  # 8 rows
    joined = photos.join(small(named), "cid", "left")
    turned = S.matmul3([F.col(c) for c in o], [F.col(c) for c in ROTATION])
    return joined.select(*(c for c in photos.columns if c not in ROTATION), *(F.coalesce(t, F.col(c)).alias(c) for c, t in zip(ROTATION, turned, strict=True)))


def in_camera(x, y, z, prefix: str = "") -> list[Column]:
    """R (X - C)."""
    c = [F.col(prefix + k) for k in ("cx", "cy", "cz")]
    return S.matvec([F.col(prefix + k) for k in ROTATION], [x - c[0], y - c[1], z - c[2]])


def distort(x: Column, y: Column) -> tuple[Column, Column]:
    """Radial and tangential distortion of normalised coordinates, by columns k1, k2, k3, p1, p2."""
    k1, k2, k3, p1, p2 = (F.col(c) for c in ("k1", "k2", "k3", "p1", "p2"))
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def pixel_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a world point; null where it is not in front of the camera."""
    xc, yc, zc = in_camera(x, y, z)
    front = F.when(zc > 0, zc)
    xd, yd = distort(xc / front, yc / front)
    return F.col("f") * xd + F.col("u0"), F.col("f") * yd + F.col("v0")


def views(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """Photos with the columns of their camera."""
    return photos.join(small(cameras), "cid")


def project(points: DataFrame, photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """pid, iid, u, v of every point in every photo of the list (join points with iid to restrict it)."""
    if "iid" in points.columns:
        seen = points.join(views(photos, cameras), "iid")
    else:
        from ..session import size_in_bytes

        # points come from few files, and every one of them meets all photos; a photo has one camera, so the photos bound their views
        spread = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        seen = views(photos, cameras)
        seen = spread.join(F.broadcast(seen) if size_in_bytes(photos) <= 64 << 20 else seen, F.lit(True))
    # camera coordinates are columns of their own, so that each is computed once
    lens = ["f", "u0", "v0", "k1", "k2", "k3", "p1", "p2"]
    at = seen.select("pid", "iid", *lens, *(v.alias(k) for k, v in zip(("xc", "yc", "zc"), in_camera(F.col("x"), F.col("y"), F.col("z")), strict=True)))
    front = F.when(F.col("zc") > 0, F.col("zc"))
    at = at.select("pid", "iid", *lens, (F.col("xc") / front).alias("xn"), (F.col("yc") / front).alias("yn"))
    xd, yd = distort(F.col("xn"), F.col("yn"))
    return at.select("pid", "iid", (F.col("f") * xd + F.col("u0")).alias("u"), (F.col("f") * yd + F.col("v0")).alias("v"))


def project_p(points: DataFrame, p: list) -> DataFrame:
    """u, v by a 3 x 4 matrix (12 numbers or columns, row-major)."""
    m = [x if isinstance(x, Column) else F.lit(float(x)) for x in p]
    u, v = S.dehomogenize(S.matvec(m, [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]))
    return points.withColumn("u", u).withColumn("v", v)


def frame_camera(df: DataFrame) -> DataFrame:
    """P (12 doubles) from focal length f, pixel size delta, offsets x0, y0, axis-angle (ax, ay, az) and centre.

    R = (Rodrigues(axis, angle) * Rx(pi)) transposed; P = K [R | -R C].
    """
    a = [F.col(c) for c in ("ax", "ay", "az")]
    angle = S.norm(a)
    k = [F.coalesce(F.try_divide(x, angle), F.lit(0.0)) for x in a]
    s, c1 = F.sin(angle), 1 - F.cos(angle)
    cross_terms = {(0, 1): -k[2], (0, 2): k[1], (1, 0): k[2], (1, 2): -k[0], (2, 0): -k[1], (2, 1): k[0]}
    rot = [[(F.lit(1.0) if i == j else F.lit(0.0)) + s * cross_terms.get((i, j), F.lit(0.0)) + c1 * (k[i] * k[j] - (F.lit(1.0) if i == j else F.lit(0.0)) * S.dot(k, k)) for j in range(3)] for i in range(3)]
    flip = (1, -1, -1)
    r = [rot[j][i] * flip[i] for i in range(3) for j in range(3)]  # transpose of rot * diag(1, -1, -1)
    f = F.col("f") / F.col("delta")
    u0, v0 = (F.col("width") - 1) / 2 + F.col("x0") / F.col("delta"), (F.col("height") - 1) / 2 - F.col("y0") / F.col("delta")
    t = [-x for x in S.matvec(r, [F.col("cx"), F.col("cy"), F.col("cz")])]
    rows = [[*r[3 * i : 3 * i + 3], t[i]] for i in range(3)]
    p = [f * rows[0][j] + u0 * rows[2][j] for j in range(4)] + [f * rows[1][j] + v0 * rows[2][j] for j in range(4)] + rows[2]
    return df.withColumn("p", F.array(*p))


def view_params(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """Viewing direction, look-at target at median depth, up vector and vertical field of view."""
    direction = [F.col("r20"), F.col("r21"), F.col("r22")]
    up = [-F.col("r10"), -F.col("r11"), -F.col("r12")]
    out = views(photos, cameras)
    centre = [F.col(c) for c in ("cx", "cy", "cz")]
    return out.select(
        "iid", *(d.alias(n) for d, n in zip(direction, ("dx", "dy", "dz"), strict=True)), *((c + d * F.col("zmed")).alias(n) for c, d, n in zip(centre, direction, ("tx", "ty", "tz"), strict=True)),
        *(u.alias(n) for u, n in zip(up, ("ux", "uy", "uz"), strict=True)), (2 * F.atan2(F.col("height") / 2.0, F.col("f"))).alias("fov_y"),
    )


def depth_to_xyz(pixels: DataFrame, matrices: DataFrame) -> DataFrame:
    """World point of each depth pixel: inverse view-projection (m0..m15) of the pixel centre in device coordinates.

    Depths of 1 (within 1e-4) are background and give null.
    """
    j = pixels.join(small(matrices), "image_id")
    ndc = [2 * (F.col("c") + 0.5) / F.col("width") - 1, 1 - 2 * (F.col("r") + 0.5) / F.col("height"), 2 * F.col("depth") - 1, F.lit(1.0)]
    x, y, z = S.dehomogenize(S.matvec([F.col(f"m{k}") for k in range(16)], ndc))
    seen = F.abs(F.col("depth") - 1) > 1e-4
    return j.select("image_id", "r", "c", F.when(seen, x).alias("x"), F.when(seen, y).alias("y"), F.when(seen, z).alias("z"))


def undistort_block(cameras: DataFrame, photos: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables of the undistorted images: principal point at the centre, no distortion, paths folder/name.jpg."""
    c = cameras.withColumn("u0", (F.col("width") - 1) / 2).withColumn("v0", (F.col("height") - 1) / 2)
    for k in ("k1", "k2", "k3", "p1", "p2"):
        c = c.withColumn(k, F.lit(0.0))
    p = photos if folder is None else photos.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), S.base_name(F.col("path")), F.lit(".jpg")))
    return c, p


def orient_normal(df: DataFrame) -> DataFrame:
    """Normal turned towards the camera centre."""
    away = (F.col("cx") - F.col("x")) * F.col("nx") + (F.col("cy") - F.col("y")) * F.col("ny") + (F.col("cz") - F.col("z")) * F.col("nz") < 0
    return df.withColumns({k: F.when(away, -F.col(k)).otherwise(F.col(k)) for k in ("nx", "ny", "nz")})


def bbox_contains(x, y, x0, y0, x1, y1) -> Column:
    """Closed box."""
    return (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def reconcile_names(photos: DataFrame, merged: DataFrame) -> DataFrame:
    """photos with merged_iid: the least id of merged whose lower-case base name is the same; null if none."""
    key = lambda c: F.lower(S.base_name(F.col(c)))
    first = merged.groupBy(key("path").alias("name_key")).agg(F.min("iid").alias("merged_iid"))
    return photos.join(first, key("path") == F.col("name_key"), "left").drop("name_key")


def mean_dims(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    return views(photos, cameras).agg(F.avg("width").alias("width"), F.avg("height").alias("height"))


def transform_points(points: DataFrame, m: list[float]) -> DataFrame:
    """x, y, z by a 4 x 4 matrix, divided by the fourth coordinate."""
    x, y, z = S.dehomogenize(S.matvec([F.lit(float(v)) for v in m], [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]))
    return points.withColumns({"x": x, "y": y, "z": z})
