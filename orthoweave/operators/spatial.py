"""Polygons, boxes, triangles and rays: containment, measures and joins by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import spread_rows, stage

# -- polygons: rings array<array<struct<x, y>>>, ring 0 outer, integer coordinates -----------------


def _edges(ring: Column) -> Column:
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def place_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """1 strictly inside, 0 on the boundary, -1 outside (even-odd, exact for integers); a ring of fewer than 3 points has no inside."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return (S.turn(a["x"], a["y"], b["x"], b["y"], x, y) == 0) & (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = S.turn(a["x"], a["y"], b["x"], b["y"], x, y)
        return ((a["y"] <= y) & (b["y"] > y) & (t > 0)) | ((a["y"] > y) & (b["y"] <= y) & (t < 0))

    edges = _edges(ring)
    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(F.size(ring) < 3, -1).when(F.exists(edges, on), 0).otherwise(F.when(odd, 1).otherwise(-1))


def polygon_contains(rings: Column, x: Column, y: Column) -> Column:
    """Strictly inside the outer ring and not strictly inside a hole; the edge of a hole counts as inside."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return (place_in_ring(F.get(rings, F.lit(0)), x, y) > 0) & ~F.exists(holes, lambda h: place_in_ring(h, x, y) > 0)


def pip_join(points: DataFrame, polygons: DataFrame, cell: int, max_cells: int = 4096) -> DataFrame:
    """pid, poly_id of points (integer x, y) in polygons.

    Polygons are sent to the grid cells of their box (a box of more than max_cells cells uses a grid twice
    as wide, and so on), points to their cell in each grid in use: an equi-join, then the exact test.
    """
    xs, ys = F.get("rings", F.lit(0))["x"], F.get("rings", F.lit(0))["y"]
    boxed = polygons.filter(F.size(F.get("rings", F.lit(0))) >= 3).select("poly_id", "rings", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    spans = lambda size: (F.floor(F.col("x1") / size) - F.floor(F.col("x0") / size) + 1) * (F.floor(F.col("y1") / size) - F.floor(F.col("y0") / size) + 1)
    widths = [cell * 4**k for k in range(8)]
    size = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        size = F.when(spans(F.lit(w)) <= max_cells, w).otherwise(size)
    sized = boxed.withColumn("size", size.cast("long"))
    put = sized.select("*", F.explode(F.sequence(F.floor(F.col("x0") / F.col("size")), F.floor(F.col("x1") / F.col("size")))).alias("gx")).select("*", F.explode(F.sequence(F.floor(F.col("y0") / F.col("size")), F.floor(F.col("y1") / F.col("size")))).alias("gy"))
    used = F.broadcast(sized.select("size").distinct())  # at most eight grids
    at = points.join(used, F.lit(True)).select("pid", F.col("x").alias("px"), F.col("y").alias("py"), "size", F.floor(F.col("x") / F.col("size")).alias("gx"), F.floor(F.col("y") / F.col("size")).alias("gy"))
    near = at.join(put, ["size", "gx", "gy"]).filter("px >= x0 and px <= x1 and py >= y0 and py <= y1")
    return near.filter(polygon_contains(F.col("rings"), F.col("px"), F.col("py"))).select("pid", "poly_id")


def polygon_area(ring: Column) -> Column:
    """Signed area; positive for counter-clockwise rings."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2.0)


def orientation(ring: Column) -> Column:
    """True for rings with area >= 0."""
    return polygon_area(ring) >= 0


def bbox(points: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return points.groupBy(*by).agg(*(f(a).alias(f"{a}{n}") for a in axes for f, n in ((F.min, "0"), (F.max, "1"))))


# -- oriented boxes: centre c0..c2, half sizes h0..h2, axes a00..a22 (rows) ------------------------


def obb(points: DataFrame, d1: list[float], d2: list[float], by: list[str]) -> DataFrame:
    """Box of each group along unit directions d1, d2 and their cross product."""
    d3 = [d1[1] * d2[2] - d1[2] * d2[1], d1[2] * d2[0] - d1[0] * d2[2], d1[0] * d2[1] - d1[1] * d2[0]]
    axes = [d1, d2, d3]
    along = [S.dot([F.col(k) for k in "xyz"], [F.lit(float(v)) for v in d]) for d in axes]
    spans = points.groupBy(*by).agg(*(f(v).alias(f"{n}{i}") for i, v in enumerate(along) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    middle = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)]
    centre = [sum((middle[i] * float(axes[i][k]) for i in range(1, 3)), middle[0] * float(axes[0][k])) for k in range(3)]
    return spans.select(*by, *(c.alias(f"c{k}") for k, c in enumerate(centre)), *(((F.col(f"hi{i}") - F.col(f"lo{i}")) / 2).alias(f"h{i}") for i in range(3)), *(F.lit(float(axes[i][k])).alias(f"a{i}{k}") for i in range(3) for k in range(3)))


def obb_scale(box: DataFrame, scale: float, about: list | None = None) -> DataFrame:
    """Scaled about its own centre, or about a point (numbers or columns)."""
    out = {f"h{i}": F.col(f"h{i}") * scale for i in range(3)}
    if about is not None:
        out |= {f"c{k}": about[k] + (F.col(f"c{k}") - about[k]) * scale for k in range(3)}
    return box.withColumns(out)


def obb_volume() -> Column:
    return 8 * F.col("h0") * F.col("h1") * F.col("h2")


def obb_contains(x: Column, y: Column, z: Column) -> Column:
    """Closed box test of a point against the columns of obb()."""
    d = [x - F.col("c0"), y - F.col("c1"), z - F.col("c2")]
    inside = F.lit(True)
    for i in range(3):
        inside = inside & (F.abs(S.dot(d, [F.col(f"a{i}{k}") for k in range(3)])) <= F.col(f"h{i}"))
    return inside


def points_in_boxes(points: DataFrame, boxes: DataFrame, at: list[Column], cell: float) -> DataFrame:
    """Rows of points beside the boxes (columns of obb()) that hold the place `at` (three columns of points), closed.

    Voxels are cell * 2^level wide; a box lies at the lowest level at which it meets at most eight of them, and a point
    asks one voxel of each level that holds a box: an equi-join.
    """
    reach = [sum((F.abs(F.col(f"a{i}{k}")) * F.col(f"h{i}") for i in range(1, 3)), F.abs(F.col(f"a0{k}")) * F.col("h0")) * (1 + 1e-12) + 1e-12 for k in range(3)]
    levelled = stage(boxes.withColumn("_level", _voxel_level([(F.col(f"c{k}") - reach[k], F.col(f"c{k}") + reach[k]) for k in range(3)], cell)), "voxel-levels")
    present = sorted(r._level for r in levelled.select("_level").distinct().collect())  # 63 at most
    wide = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    voxel = lambda v: F.floor(v / wide).cast("long")
    put = levelled
    for k in range(3):
        put = put.withColumn(f"_g{k}", F.explode(F.sequence(voxel(F.col(f"c{k}") - reach[k]), voxel(F.col(f"c{k}") + reach[k]))))
    asked = points.withColumns({f"_p{k}": v for k, v in enumerate(at)}).withColumn("_level", F.explode(F.array(*(F.lit(n) for n in present)).cast("array<int>")))
    asked = asked.withColumns({f"_g{k}": voxel(F.col(f"_p{k}")) for k in range(3)})
    key = ["_level", "_g0", "_g1", "_g2"]
    return asked.join(put, key).filter(obb_contains(*(F.col(f"_p{k}") for k in range(3)))).drop(*key, "_p0", "_p1", "_p2")


def obb_edges(box: DataFrame, by: list[str]) -> DataFrame:
    """The twelve edges of each box: edge, x0, y0, z0, x1, y1, z1."""
    signs = [(1 if n & 4 else -1, 1 if n & 2 else -1, 1 if n & 1 else -1) for n in range(8)]
    corner = lambda s, k: F.col(f"c{k}") + sum((F.col(f"h{i}") * F.col(f"a{i}{k}") * s[i] for i in range(1, 3)), F.col("h0") * F.col(f"a0{k}") * s[0])
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8) if bin(a ^ b).count("1") == 1]
    rows = F.array(*(F.struct(F.lit(n).alias("edge"), *(corner(signs[a], k).alias(f"{'xyz'[k]}0") for k in range(3)), *(corner(signs[b], k).alias(f"{'xyz'[k]}1") for k in range(3))) for n, (a, b) in enumerate(pairs)))
    return box.select(*by, F.explode(rows).alias("e")).select(*by, "e.*")


# -- triangles: tid and ax, ay, az, bx, by_, bz, cx, cy, cz ----------------------------------------

TRI = ["ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz"]


def corners() -> tuple[list[Column], list[Column], list[Column]]:
    c = [F.col(k) for k in TRI]
    return c[:3], c[3:6], c[6:]


def barycenter() -> list[Column]:
    a, b, c = corners()
    return [(x + y + z) / 3 for x, y, z in zip(a, b, c, strict=True)]


def tri_area() -> Column:
    a, b, c = corners()
    minus = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    return S.norm(S.cross(minus(b, a), minus(c, a))) / 2


def clip_mesh(triangles: DataFrame, box: DataFrame, cell: float = 8.0) -> DataFrame:
    """Triangles (tid and corners) whose barycentre lies in one of the boxes (obb() columns)."""
    inside = points_in_boxes(triangles.select("tid", *(m.alias(f"m{k}") for k, m in enumerate(barycenter()))), box, [F.col(f"m{k}") for k in range(3)], cell)
    return triangles.join(inside.select("tid").distinct(), "tid", "left_semi")


def remove_by_bbox(triangles: DataFrame, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    """Triangles whose barycentre is not in the closed box."""
    inside = F.lit(True)
    for m, a, b in zip(barycenter(), lo, hi, strict=True):
        inside = inside & (m >= a) & (m <= b)
    return triangles.filter(~inside)


def mesh_merge(a_vertices: DataFrame, a_tri: DataFrame, b_vertices: DataFrame, b_tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One mesh: vertex ids of b start after those of a (vid; v0, v1, v2), triangle ids too."""
    top = F.broadcast(a_vertices.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("shift")))
    tops = F.broadcast(a_tri.agg(F.coalesce(F.max("tid") + 1, F.lit(0)).alias("t_shift")))
    v = b_vertices.join(top, F.lit(True)).withColumn("vid", F.col("vid") + F.col("shift")).select(*a_vertices.columns)
    t = b_tri.join(top, F.lit(True)).join(tops, F.lit(True)).withColumns({k: F.col(k) + F.col("shift") for k in ("v0", "v1", "v2")} | {"tid": F.col("tid") + F.col("t_shift")}).select(*a_tri.columns)
    return a_vertices.unionByName(v), a_tri.unionByName(t)


def drop_isolated(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """Vertices that a triangle uses."""
    # both sides are dealt by id over a fixed number of tasks before ids are made distinct: ids pack so well in a shuffle that adaptive execution would put many in one task
    used = spread_rows(tri.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")), "vid").distinct()
    return spread_rows(vertices, "vid").join(used, "vid", "left_semi")


#: rounds of a subdivision that run without meeting other triangles
_ROUNDS = 5


def subdivide(vertices: DataFrame, tri: DataFrame, max_len: float, iterations: int = 5, with_corners: bool = False) -> tuple[DataFrame, DataFrame]:
    """Triangles larger than max_len^2 / 2 become four at their edge middles, until none is or the iterations end.

    Shared edges share the new vertex (its id follows from the edge); neighbours that stay keep a T-junction.
    Whether a triangle is split follows from its own corners, so up to five rounds run on each triangle by
    itself. A new vertex lies in the grid of a given triangle: on its edge, which is named by the least
    triangle that has it, or inside, which belongs to the triangles of the same three vertices. So given
    triangles meet given vertices and each other once, and only new vertices are met again, to be told once.
    with_corners: the triangles carry the coordinates of their corners, as TRI.
    """
    places = [(c, n) for n in "012" for c in "xyz"]
    for done in range(0, iterations, _ROUNDS):
        rounds = min(_ROUNDS, iterations - done)
        full = stage(_with_corners(vertices, tri).withColumn("large", _larger([[F.col(c + n) for c in "xyz"] for n in "012"], max_len)).filter("large is not null"), "subdivide")
        nodes = _split(_with_owners(vertices, full, rounds), max_len, rounds)
        leaves = nodes.filter("not split")
        made = nodes.filter("split").select(F.explode(F.array(*_middles(1 << rounds))).alias("m")).select("m.vid", "m.x", "m.y", "m.z")
        # dealt before they are made distinct, so that no task holds more than its share
        made = spread_rows(made, "vid").groupBy("vid").agg(*(F.min(c).alias(c) for c in "xyz"))
        vertices = vertices.select("vid", "x", "y", "z").unionByName(made)
        tri = leaves.select("tid", *(F.col(f"c{n}.vid").alias(f"v{n}") for n in "012"), *(F.col(f"c{n}.{c}").alias(c + n) for c, n in places))
        if done + rounds < iterations:
            if leaves.filter(_larger([[F.col(f"c{n}.{c}") for c in "xyz"] for n in "012"], max_len)).isEmpty():
                break
            vertices, tri = stage(vertices, "subdivide-vertices"), stage(tri.select("tid", "v0", "v1", "v2"), "subdivide-triangles")
    if not with_corners:
        return vertices, tri.select("tid", "v0", "v1", "v2")
    if iterations < 1:
        tri = _with_corners(vertices, tri)
    return vertices, tri.select("tid", "v0", "v1", "v2", *(F.col(c + n).alias(name) for (c, n), name in zip(places, TRI, strict=True)))


def _with_corners(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    at = lambda k, n: vertices.select(F.col("vid").alias(k), *(F.col(c).alias(c + n) for c in "xyz"))
    return tri.select("tid", "v0", "v1", "v2").join(at("v0", "0"), "v0").join(at("v1", "1"), "v1").join(at("v2", "2"), "v2")


def _larger(p: list[list[Column]], max_len: float) -> Column:
    minus = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
    return S.norm(S.cross(minus(p[1], p[0]), minus(p[2], p[0]))) / 2 > max_len * max_len / 2


def _with_owners(vertices: DataFrame, full: DataFrame, rounds: int) -> DataFrame:
    """Triangles with the first ids of the new vertices on their edges (lo to mid, mid to hi, lo to hi of the sorted corners) and inside, and of their parts."""
    block = 4**rounds
    top = vertices.agg(F.max("vid")).first()[0]
    first, last = full.agg(F.min("tid"), F.max("tid")).first()
    top, first, last = (top or 0) + 1, first or 0, (last or 0) + 1
    lo, mid, hi = (F.sort_array(F.array("v0", "v1", "v2"))[k] for k in range(3))
    key = lambda side, a, b, c: F.struct(F.lit(side).alias("side"), a.alias("a"), b.alias("b"), c.alias("c"))
    keys = F.array(key(0, lo, mid, mid), key(1, mid, hi, hi), key(2, lo, hi, hi), key(3, lo, mid, hi))
    owned = full.filter("large").select("tid", F.explode(keys).alias("k")).select("tid", "k.*")
    # an edge repeats its end, so that edges and faces are one kind of key
    face = F.when(F.col("side") == 3, 1).otherwise(0).alias("face")
    owned = owned.withColumn("owner", F.min((F.col("tid") - first) * 4 + F.col("side")).over(Window.partitionBy("a", "b", "c", face)))
    ids = owned.groupBy("tid").agg(*(F.max(F.when(F.col("side") == k, F.col("owner") * block + top)).alias(f"e{k}") for k in range(4)))
    # a split triangle's parts take ids beyond all old ones
    return full.join(ids, "tid", "left").withColumn("parts", (F.col("tid") - first) * ((4 ** (rounds + 1) - 4) // 3) + last)


def _middle(a: str, b: str, steps: int) -> Column:
    """The vertex in the middle of two corners of a part; i and j are its places from the least vertex of the given triangle to the middle and the greatest one."""
    i, j = ((F.col(f"{a}.{k}") + F.col(f"{b}.{k}")).cast("long") / 2 for k in "ij")
    i, j = i.cast("long"), j.cast("long")
    vid = F.when(j == 0, F.col("e0") + i).when(i + j == steps, F.col("e1") + j).when(i == 0, F.col("e2") + j).otherwise(F.col("e3") + i * steps + j)
    return F.struct(vid.alias("vid"), i.alias("i"), j.alias("j"), *(((F.col(f"{a}.{c}") + F.col(f"{b}.{c}")) / 2).alias(c) for c in "xyz"))


def _middles(steps: int) -> list[Column]:
    return [_middle("c0", "c1", steps), _middle("c1", "c2", steps), _middle("c2", "c0", steps)]


def _split(full: DataFrame, max_len: float, rounds: int) -> DataFrame:
    """Parts of each triangle (split: false) and the triangles that were split on the way; nothing leaves a task."""
    steps = 1 << rounds
    v = [F.col(f"v{n}") for n in range(3)]
    # place of a corner among the three, equal ones in order
    before = lambda n: sum((F.when((v[k] < v[n]) if k > n else (v[k] <= v[n]), 1).otherwise(0) for k in range(3) if k != n), F.lit(0))
    corner = lambda n: F.struct(v[n].cast("long").alias("vid"), *(F.when(before(n) == k, steps).otherwise(0).cast("long").alias(c) for k, c in ((1, "i"), (2, "j"))), *(F.col(f"{c}{n}").cast("double").alias(c) for c in "xyz"))
    kept = ["parts", "e0", "e1", "e2", "e3"]
    nodes = full.select(F.col("tid").cast("long").alias("tid"), *kept, F.lit(False).alias("split"), F.lit(-1).cast("long").alias("at"), *(corner(n).alias(f"c{n}") for n in range(3)))
    for _ in range(rounds):
        large = ~F.col("split") & _larger([[F.col(f"c{n}.{c}") for c in "xyz"] for n in "012"], max_len)
        nodes = nodes.select("*", large.alias("large"), *(m.alias(f"m{n}") for n, m in enumerate(_middles(steps))))
        node = lambda split, tid, at, a, b, c: F.struct(split.alias("split"), tid.alias("tid"), at.alias("at"), F.col(a).alias("c0"), F.col(b).alias("c1"), F.col(c).alias("c2"))
        same = lambda split: node(split, F.col("tid"), F.col("at"), "c0", "c1", "c2")
        # parts are numbered in the tree of parts of their given triangle
        part = lambda n, a, b, c: node(F.lit(False), F.col("parts") + (F.col("at") + 1) * 4 + n, (F.col("at") + 1) * 4 + n, a, b, c)
        four = [part(n, *of) for n, of in enumerate((("c0", "m0", "m2"), ("m0", "c1", "m1"), ("m2", "m1", "c2"), ("m0", "m1", "m2")))]
        nodes = nodes.select(*kept, F.explode(F.when(F.col("large"), F.array(*four, same(F.lit(True)))).otherwise(F.array(same(F.col("split"))))).alias("q")).select(*kept, "q.*")
    return nodes


# -- rays ---------------------------------------------------------------------------------------


RAY = ["ray_id", "ox", "oy", "oz", "dx", "dy", "dz", "tnear", "tfar"]


def _voxel_level(spans: list[tuple[Column, Column]], cell: float) -> Column:
    """The lowest level, voxels being cell * 2^level wide, at which a box meets at most eight voxels.

    Where voxels are as wide as the box it meets two at most along each axis; up to four levels below are tried.
    """
    size = F.greatest(*(hi - lo for lo, hi in spans))
    wide = F.least(F.lit(62), F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(size / cell)), F.lit(0)))).cast("int")

    def met(level: Column) -> Column:
        w = F.lit(float(cell)) * F.pow(F.lit(2.0), level)
        n = [F.floor(hi / w) - F.floor(lo / w) + 1 for lo, hi in spans]
        return n[0].cast("double") * n[1] * n[2]

    lower = [F.when((wide >= k) & (met(wide - k) <= 8), wide - k) for k in (4, 3, 2, 1)]
    return F.coalesce(*lower, wide)


def _candidates(rays: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """Rays and triangles that share a voxel, with their geometry; once for each voxel and piece they share.

    Voxels are cell * 2^level wide. A triangle lies at the lowest level at which its box meets at most eight of
    them, whatever its size. A ray [tnear, tfar] visits the levels that hold a triangle: there it is cut into
    pieces no longer than a voxel in each axis, and the voxels of the box of each piece are a cover of
    the segment, so no hit is lost. Wider levels have fewer pieces, so that all levels together have at
    most about twice those of the finest.
    """
    tri_spans = [(F.least(*p), F.greatest(*p)) for p in (("ax", "bx", "cx"), ("ay", "by_", "cy"), ("az", "bz", "cz"))]
    # of triangles with the same corners, in the same order, a ray meets all at one place or none: the least tid stands for them
    distinct = triangles.groupBy(*TRI).agg(F.min("tid").alias("tid"))
    # written once: the levels are read from it, and then the triangles
    levelled = stage(distinct.select("tid", *TRI, _voxel_level(tri_spans, cell).alias("level")), "voxel-levels")
    present = sorted(r.level for r in levelled.select("level").distinct().collect())  # 63 at most
    wide = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    longest = F.greatest(*(F.abs(c) for c in ("dx", "dy", "dz"))) * (F.col("tfar") - F.col("tnear"))
    # a ray becomes many rows: rays are dealt over tasks first, also where they come from one small file
    visits = spread_rows(rays.select(*RAY), "ray_id").select(*RAY, F.explode(F.array(*(F.lit(n) for n in present)).cast("array<int>")).alias("level"))
    pieces = visits.withColumn("k", F.greatest(F.lit(1), F.ceil(longest / wide)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    end = lambda o, d, n: F.col(o) + F.col(d) * (F.col("tnear") + (F.col("tfar") - F.col("tnear")) * (F.col("i") + n) / F.col("k"))

    def cells(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / wide).cast("long"), F.floor(hi / wide).cast("long"))

    def spread(df: DataFrame, keep: list[str], spans: list[tuple[Column, Column]]) -> DataFrame:
        keep = [*keep, "level"]
        return df.select(*keep, *(cells(*s).alias(f"s{n}") for n, s in enumerate(spans))).select(*keep, F.explode("s0").alias("gx"), "s1", "s2").select(*keep, "gx", F.explode("s1").alias("gy"), "s2").select(*keep, "gx", "gy", F.explode("s2").alias("gz"))

    eps = 1e-9
    ray_spans = [(F.least(end(o, d, 0), end(o, d, 1)) - eps, F.greatest(end(o, d, 0), end(o, d, 1)) + eps) for o, d in (("ox", "dx"), ("oy", "dy"), ("oz", "dz"))]
    r = spread(pieces, RAY, ray_spans)
    t = spread(levelled, ["tid", *TRI], tri_spans)
    return r.join(t, ["level", "gx", "gy", "gz"])


def _met(candidates: DataFrame) -> DataFrame:
    """ray_id, tid, t, u, v of the candidates that meet (Moeller-Trumbore), each part a column of its own and so computed once."""
    from .visibility import kept

    a, b, c = corners()
    minus = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    named = lambda name, v: [x.alias(f"{name}{k}") for k, x in enumerate(v)]
    col = lambda name: [F.col(f"{name}{k}") for k in range(3)]
    d = [F.col(k) for k in ("dx", "dy", "dz")]
    base = ["ray_id", "tid", "tnear", "tfar"]
    parts = candidates.select(*base, *named("d", d), *named("e", minus(b, a)), *named("f", minus(c, a)), *named("s", minus([F.col(k) for k in ("ox", "oy", "oz")], a)))
    parts = parts.select(*base, *(x for k in "defs" for x in col(k)), *named("p", S.cross(col("d"), col("f"))), *named("q", S.cross(col("s"), col("e"))))
    parts = parts.select(*base, S.dot(col("e"), col("p")).alias("det"), S.dot(col("s"), col("p")).alias("un"), S.dot(col("d"), col("q")).alias("vn"), S.dot(col("f"), col("q")).alias("tn"))
    det = F.when(F.abs("det") > 1e-12, F.col("det"))
    parts = parts.select(*base, *((F.col(k + "n") / det).alias(k) for k in "uvt"))
    hit = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") + F.col("v") <= 1) & (F.col("t") >= F.col("tnear")) & (F.col("t") <= F.col("tfar"))
    return kept(parts, F.coalesce(hit, F.lit(False)), "ray_id", "tid", "t", "u", "v")


def ray_hits(rays: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """ray_id, tid, t, u, v: the nearest triangle that each ray meets within [tnear, tfar]; ties to the smaller tid."""
    met = _met(_candidates(rays, triangles, cell)).select("ray_id", F.struct(F.round("t", 9).alias("t"), "tid", "u", "v").alias("h"))
    return met.groupBy("ray_id").agg(F.min("h").alias("h")).select("ray_id", "h.tid", "h.t", "h.u", "h.v")


def occluded(rays: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """Rays that meet any triangle."""
    return rays.join(_met(_candidates(rays, triangles, cell)).select("ray_id").distinct(), "ray_id", "left_semi")
