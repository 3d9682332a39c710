"""Robust fitting of two-view models: residuals as columns, hypotheses scored by joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import matvec

PAIR = ["iid_i", "iid_j"]
_XY = ["x1", "y1", "x2", "y2"]

# -- models applied to points -------------------------------------------------------------------


def _columns(m) -> list[Column]:
    return [x if isinstance(x, Column) else F.lit(float(x)) for x in m]


def apply_homography(h, x: Column, y: Column) -> tuple[Column, Column]:
    u, v, w = matvec(_columns(h), [x, y, F.lit(1.0)])
    return F.try_divide(u, w), F.try_divide(v, w)


def apply_affine(a, x: Column, y: Column) -> tuple[Column, Column]:
    """a: 2 x 3, row-major."""
    u, v = matvec(_columns(a), [x, y, F.lit(1.0)])
    return u, v


def epipolar_line(f, x: Column, y: Column, back: bool = False) -> list[Column]:
    """The line of the other image on which a point's match lies; back: f read from the second image to the first."""
    f = _columns(f)
    return matvec([f[0], f[3], f[6], f[1], f[4], f[7], f[2], f[5], f[8]] if back else f, [x, y, F.lit(1.0)])


def _epipolar(f, x1, y1, x2, y2):
    fx, ft = epipolar_line(f, x1, y1), epipolar_line(f, x2, y2, back=True)
    d = x2 * fx[0] + y2 * fx[1] + fx[2]
    return d * d, fx[0] * fx[0] + fx[1] * fx[1], ft[0] * ft[0] + ft[1] * ft[1]


def sampson(f, x1, y1, x2, y2) -> Column:
    d2, a, b = _epipolar(f, x1, y1, x2, y2)
    return F.try_divide(d2, a + b)


def symmetric_epipolar(f, x1, y1, x2, y2) -> Column:
    """A quarter of the two squared line distances, which matches the Sampson error."""
    d2, a, b = _epipolar(f, x1, y1, x2, y2)
    return F.try_divide(d2, a) / 4 + F.try_divide(d2, b) / 4


def epipolar(f, x1, y1, x2, y2) -> Column:
    d2, a, _ = _epipolar(f, x1, y1, x2, y2)
    return F.try_divide(d2, a)


def homography_transfer(h, x1, y1, x2, y2) -> Column:
    u, v = apply_homography(h, x1, y1)
    return (x2 - u) ** 2 + (y2 - v) ** 2


def translation_error(t, x1, y1, x2, y2) -> Column:
    t = _columns(t)
    return (x2 - x1 - t[0]) ** 2 + (y2 - y1 - t[1]) ** 2


RESIDUALS = {"sampson": sampson, "symmetric_epipolar": symmetric_epipolar, "epipolar": epipolar, "homography": homography_transfer, "translation": translation_error}


def residual(df: DataFrame, model, kind: str, into: str = "error") -> DataFrame:
    """Adds the squared residual of each match; model: numbers or columns."""
    if kind not in RESIDUALS:
        raise ValueError(f"unknown residual {kind}")
    return df.withColumn(into, RESIDUALS[kind](model, *(F.col(c) for c in _XY)))


# -- conditioning -------------------------------------------------------------------------------


def normalize_by_size(df: DataFrame, width: int, height: int, x: str, y: str) -> DataFrame:
    """Centre of the image to the origin, area to one."""
    s = 1 / math.sqrt(width * height)
    return df.withColumn(x, (F.col(x) - 0.5 * width) * s).withColumn(y, (F.col(y) - 0.5 * height) * s)


def normalize_points(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mean to the origin, population variance to two; an axis without variance is moved by -1 only, unscaled."""
    w = Window.partitionBy(*by)
    out = df
    for c in (x, y):
        mean, var = F.avg(c).over(w), F.var_pop(c).over(w)
        out = out.withColumn("_" + c, F.when(var < 1e-8, F.col(c) - 1).otherwise((F.col(c) - mean) * F.sqrt(F.try_divide(F.lit(2.0), var))))
    return out.drop(x, y).withColumnsRenamed({"_" + x: x, "_" + y: y})


# -- hypotheses ---------------------------------------------------------------------------------

SAMPLE = {"translation": 1, "affine": 3, "homography": 4, "fundamental": 7}


def numbered(matches: DataFrame) -> DataFrame:
    """n: 0.. within the pair by feature ids; n_all: matches of the pair. A detector and a match cap bound a pair."""
    w = Window.partitionBy(*PAIR)
    return matches.withColumn("n", F.row_number().over(w.orderBy("fid_i", "fid_j")) - 1).withColumn("n_all", F.count(F.lit(1)).over(w))


def sample_hypotheses(matches: DataFrame, m: int, draws: int = 1024, seed: int = 0) -> DataFrame:
    """iid_i, iid_j, draw, slot and the match of each slot: m distinct matches a draw, fixed by the seed.

    Pairs with fewer than m matches have none.
    """
    rows = numbered(matches)
    sizes = rows.groupBy(*PAIR).agg(F.max("n_all").alias("n_all")).filter(F.col("n_all") >= m)
    drawn = sizes.select(*PAIR, "n_all", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    first = F.pmod(F.xxhash64(*PAIR, "draw", F.lit(seed)), F.col("n_all"))
    # slots lie in disjoint stretches of n_all / m places, so the matches of a draw differ
    pick = drawn.select(*PAIR, "draw", "n_all", first.alias("first"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot"))
    spaced = F.pmod(F.col("first") + F.col("slot") * F.greatest(F.lit(1), F.floor(F.col("n_all") / m)) + F.when(F.col("n_all") >= 2 * m, F.pmod(F.xxhash64(*PAIR, "draw", "slot", F.lit(seed + 1)), F.floor(F.col("n_all") / m))).otherwise(0), F.col("n_all"))
    return pick.withColumn("n", spaced).drop("first", "n_all").join(rows.select(*PAIR, "n", "fid_i", "fid_j", *_XY), [*PAIR, "n"])


def _conditioned(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Point sets (sets, points, 2) moved and scaled to mean 0 and mean distance sqrt 2, and the 3 x 3 maps that do it."""
    mean = xy.mean(axis=1, keepdims=True)
    spread = np.linalg.norm(xy - mean, axis=2).mean(axis=1)
    scale = math.sqrt(2) / np.where(spread > 0, spread, 1.0)
    t = np.zeros((len(xy), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = scale
    t[:, :2, 2] = -scale[:, None] * mean[:, 0]
    t[:, 2, 2] = 1
    return (xy - mean) * scale[:, None, None], t


def homographies(p: np.ndarray) -> np.ndarray:
    """3 x 3 matrices (flat, last entry 1) of point sets (sets, points >= 4, x1 y1 x2 y2), by one stacked SVD; NaN where degenerate."""
    (a, ta), (b, tb) = _conditioned(p[:, :, :2]), _conditioned(p[:, :, 2:])
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate((np.stack((x, y, one, zero, zero, zero, -u * x, -u * y, -u), -1), np.stack((zero, zero, zero, x, y, one, -v * x, -v * y, -v), -1)), axis=1)
    _, s, vt = np.linalg.svd(rows)
    h = np.linalg.solve(tb, vt[:, -1].reshape(-1, 3, 3)) @ ta
    last = h[:, 2, 2]
    sound = (s[:, 7] > 1e-10 * s[:, 0]) & (np.abs(last) > 1e-14 * np.abs(h).max(axis=(1, 2)))
    return np.where(sound[:, None], h.reshape(-1, 9) / np.where(sound, last, 1.0)[:, None], np.nan)


def affines(p: np.ndarray) -> np.ndarray:
    """2 x 3 matrices (flat) of point sets (sets, points >= 3, 4), least squares by stacked normal equations; NaN where degenerate."""
    a, t = _conditioned(p[:, :, :2])
    left = np.concatenate((a, np.ones((*a.shape[:2], 1))), axis=2)
    normal = left.transpose(0, 2, 1) @ left
    sound = np.linalg.cond(normal) < 1e18
    m = np.linalg.solve(np.where(sound[:, None, None], normal, np.eye(3)), left.transpose(0, 2, 1) @ p[:, :, 2:]).transpose(0, 2, 1) @ t
    return np.where(sound[:, None], m.reshape(-1, 6), np.nan)


def _cubic_roots(c: np.ndarray) -> np.ndarray:
    """Real roots, rising and then NaN, of c0 + c1 t + c2 t^2 + c3 t^3, by stacked companion matrices."""
    out = np.full((len(c), 3), np.nan)
    size = np.abs(c).max(axis=1)
    full = np.abs(c[:, 3]) > 1e-12 * size
    companion = np.zeros((int(full.sum()), 3, 3))
    companion[:, 1, 0] = companion[:, 2, 1] = 1
    companion[:, :, 2] = -c[full, :3] / c[full, 3:]
    roots = np.linalg.eigvals(companion)
    out[full] = np.sort(np.where(np.abs(roots.imag) < 1e-9 * (1 + np.abs(roots)), roots.real, np.nan), axis=1)
    for i in np.flatnonzero(~full):  # the cubic term vanishes: a rare sample
        found = np.polynomial.Polynomial(c[i]).trim(1e-12 * size[i]).roots() if size[i] > 0 else np.zeros(0)
        real = np.sort(found[np.abs(np.imag(found)) < 1e-9].real)
        out[i, : len(real)] = real
    return out


def fundamentals(p: np.ndarray) -> np.ndarray:
    """(sets, 3, 9): up to three matrices of each set of 7 matches (det = 0 along the null pencil), one of rank 2 of 8 or more; the rest NaN."""
    (a, ta), (b, tb) = _conditioned(p[:, :, :2]), _conditioned(p[:, :, 2:])
    x1, y1, x2, y2 = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    _, _, vt = np.linalg.svd(np.stack((x2 * x1, x2 * y1, x2, y2 * x1, y2 * y1, y2, x1, y1, np.ones_like(x1)), -1))
    back = lambda f: tb.transpose(0, 2, 1) @ f @ ta
    out = np.full((len(p), 3, 9), np.nan)
    if p.shape[1] >= 8:
        u, s, v = np.linalg.svd(vt[:, -1].reshape(-1, 3, 3))
        s[:, 2] = 0
        out[:, 0] = back(u * s[:, None, :] @ v).reshape(-1, 9)
        return out
    f, g = vt[:, -1].reshape(-1, 3, 3), vt[:, -2].reshape(-1, 3, 3)
    at = np.array([0.0, 1.0, -1.0, 2.0])
    values = np.stack([np.linalg.det(t * f + (1 - t) * g) for t in at], axis=1)
    roots = _cubic_roots(np.linalg.solve(np.vander(at, 4, increasing=True), values.T).T)
    for k in range(3):
        r = roots[:, k, None, None]
        m = back(r * f + (1 - r) * g).reshape(-1, 9)
        out[:, k] = m / np.linalg.norm(m, axis=1, keepdims=True)
    return out


SOLVERS = {"homography": homographies, "affine": affines, "fundamental": fundamentals}


def _stacks(points: pa.Array):
    """(size, places, array of their point sets) for the sets of equal size among lists of points (structs of x1, y1, x2, y2)."""
    sizes = pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, flat = np.cumsum(sizes) - sizes, points.flatten()
    columns = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    xy = np.stack([columns[c].to_numpy(zero_copy_only=False).astype(float) for c in _XY], axis=1)
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        yield n, places, xy[begin[places, None] + np.arange(n)]


def _lists(models: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Rows of numbers as an Arrow list each; null where not known."""
    ends = np.arange(len(models) + 1, dtype=np.int32) * models.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(models.ravel()), mask=None if known is None else pa.array(~known))


def fit_minimal(samples: DataFrame, model: str) -> DataFrame:
    """iid_i, iid_j, draw, root and the model as array<double> of each draw; degenerate draws give none."""
    groups = samples.groupBy(*PAIR, "draw").agg(F.sort_array(F.collect_list(F.struct("slot", *_XY))).alias("pts"))
    if model == "translation":
        p = F.element_at("pts", 1)
        return groups.select(*PAIR, "draw", F.lit(0).alias("root"), F.array(p["x2"] - p["x1"], p["y2"] - p["y1"]).alias("model"))
    if model not in SAMPLE:
        raise ValueError(f"unknown model {model}")

    def solve(batches):
        for f in batches:
            for n, places, sets in _stacks(f.column("pts")):
                if n < SAMPLE[model]:
                    continue
                found = SOLVERS[model](sets).reshape(len(sets), -1, 9 if model != "affine" else 6)
                row, root = np.nonzero(np.isfinite(found).all(axis=2))
                own = [f.column(c).take(pa.array(places[row])) for c in (*PAIR, "draw")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(root.astype(np.int32)), _lists(found[row, root])], names=[*PAIR, "draw", "root", "model"])

    return groups.mapInArrow(solve, "iid_i long, iid_j long, draw int, root int, model array<double>")


def every_translation(matches: DataFrame) -> DataFrame:
    """Each match as the hypothesis of its own displacement."""
    return numbered(matches).select(*PAIR, F.col("n").alias("draw"), F.lit(0).alias("root"), F.array(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("model"))


def score(matches: DataFrame, hypotheses: DataFrame, model: str) -> DataFrame:
    """Every match of a pair under every hypothesis of the pair, with its squared residual."""
    kind = {"fundamental": "symmetric_epipolar", "affine": None}.get(model, model)
    joined = matches.select(*PAIR, "fid_i", "fid_j", *_XY).join(hypotheses, PAIR)
    size = {"translation": 2, "affine": 6}.get(model, 9)
    m = [F.col("model")[k] for k in range(size)]
    if kind is None:
        u, v = apply_affine(m, F.col("x1"), F.col("y1"))
        return joined.withColumn("error", (F.col("x2") - u) ** 2 + (F.col("y2") - v) ** 2)
    return residual(joined, m, kind)


#: hypotheses in one task; matches of a pair that are scored there (8 MB), beyond them a pair is scored row by row
_HYPOTHESES, _MATCHES = 8192, 1 << 18
#: hypotheses in one task where a pair's are translations, which meet only the displacements near them
_SHIFTS = 1 << 18
#: residuals that a task holds at a time
_RESIDUALS = 1 << 20


def squared_errors(model: str, h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Squared residuals of matches m (n, 4) under models h (k, size): k x n, infinite where undefined."""
    x1, y1, x2, y2 = m.T
    one = np.ones_like(x1)
    with np.errstate(all="ignore"):
        if model == "translation":
            e = (x2 - x1 - h[:, :1]) ** 2 + (y2 - y1 - h[:, 1:2]) ** 2
        elif model == "affine":
            u, v = h[:, :3] @ np.stack((x1, y1, one)), h[:, 3:6] @ np.stack((x1, y1, one))
            e = (x2 - u) ** 2 + (y2 - v) ** 2
        elif model == "homography":
            u, v, w = (h[:, k : k + 3] @ np.stack((x1, y1, one)) for k in (0, 3, 6))
            e = (x2 - u / w) ** 2 + (y2 - v / w) ** 2
        else:
            a, b, c = (h[:, k : k + 3] @ np.stack((x1, y1, one)) for k in (0, 3, 6))
            ta, tb = h[:, [0, 3, 6]] @ np.stack((x2, y2, one)), h[:, [1, 4, 7]] @ np.stack((x2, y2, one))
            d = (x2 * a + y2 * b + c) ** 2
            e = d / (a * a + b * b) / 4 + d / (ta * ta + tb * tb) / 4
    return np.where(np.isfinite(e), e, np.inf)


def _best_in_blocks(matches: DataFrame, hypotheses: DataFrame, model: str, judge) -> DataFrame:
    """PAIR, draw, root, value double, upto long: of each pair the hypothesis of least (value, draw, root).

    A task holds the matches of one pair and a block of its hypotheses and returns the best of the block; blocks are
    large, since every block is sent all matches of its pair, and are scored a few hypotheses at a time. judge(errors)
    gives for each hypothesis (row) its value and upto; infinite values are no candidates. matches are of pairs
    of at most _MATCHES.
    """
    n = F.count(F.lit(1))
    blocks = hypotheses.groupBy(*PAIR).agg(F.ceil(n / _HYPOTHESES).cast("int").alias("blocks"))
    given = hypotheses.join(blocks, PAIR).select(*PAIR, "draw", "root", "model", F.pmod(F.xxhash64("draw", "root"), F.col("blocks")).cast("int").alias("block"))
    sent = matches.join(blocks, PAIR).select(*PAIR, *_XY, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = lambda df, side: df.withColumnsRenamed({c: c + side for c in (*PAIR, "block")})
    given, sent = own(given, "_h"), own(sent, "_m")
    schema = "iid_i long, iid_j long, draw int, root int, value double, upto long"

    def run(key, h: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        if not len(h) or not len(m):
            return none
        h = h.sort_values(["draw", "root"], kind="stable")
        models, points = np.stack(h["model"].to_list()), m[_XY].to_numpy(dtype=float)
        step = max(1, _RESIDUALS // len(points))
        judged = [judge(squared_errors(model, models[a : a + step], points)) for a in range(0, len(models), step)]
        value, upto = (np.concatenate([j[k] for j in judged]) for k in range(2))
        at = int(np.argmin(np.round(value, 9)))  # ties: the first, which has the least draw and root
        if not np.isfinite(value[at]):
            return none
        return pd.DataFrame({"iid_i": [key[0]], "iid_j": [key[1]], "draw": [h["draw"].iloc[at]], "root": [h["root"].iloc[at]], "value": [round(float(value[at]), 9)], "upto": [int(upto[at])]})

    found = given.groupBy("iid_i_h", "iid_j_h", "block_h").cogroup(sent.groupBy("iid_i_m", "iid_j_m", "block_m")).applyInPandas(run, schema)
    best = found.groupBy(*PAIR).agg(F.min(F.struct("value", "draw", "root", "upto")).alias("b"))
    return best.select(*PAIR, "b.draw", "b.root", "b.value", "b.upto")


def _near_shifts(shifts: np.ndarray, moved: np.ndarray, reach: float):
    """(first, last, owner, at, e): for a stretch of shifts at a time the displacements within reach, by shift and then by squared distance e.

    shifts and moved: (n, 2); owner counts from first, at is the row of moved.
    """
    wide, ways = reach * (1 + 1e-9) + 1e-9, []
    for axis in range(2):
        along = np.argsort(moved[:, axis], kind="stable")
        lo, hi = (np.searchsorted(moved[along, axis], shifts[:, axis] + d, side=side) for d, side in ((-wide, "left"), (wide, "right")))
        ways.append((int((hi - lo).sum()), axis, along, lo, hi - lo))
    _, _, along, lo, n = min(ways, key=lambda w: w[:2])  # the axis along which fewer are near
    ends = np.cumsum(n)
    first = 0
    while first < len(shifts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _RESIDUALS, side="right")))
        own = n[first:last]
        owner = np.repeat(np.arange(last - first), own)
        at = along[np.repeat(lo[first:last] - (np.cumsum(own) - own), own) + np.arange(len(owner))]
        e = ((moved[at] - shifts[first + owner]) ** 2).sum(axis=1)
        near = np.flatnonzero(e <= reach * reach)
        near = near[np.lexsort((e[near], owner[near]))]
        yield first, last, owner[near], at[near], e[near]
        first = last


def _best_shifts(matches: DataFrame, hypotheses: DataFrame, reach: float, judge) -> DataFrame:
    """_best_in_blocks() of translations. Equal shifts are judged once, and only with the displacements within reach of them.

    judge(first, last, owner, e, times, n): value and upto of the shifts first..last; owner, e and times tell the near
    displacements by shift and distance and how many matches have each, n is the number of matches.
    """
    blocks = hypotheses.groupBy(*PAIR).agg(F.ceil(F.count(F.lit(1)) / _SHIFTS).cast("int").alias("blocks"))
    shift = [F.col("model")[k].cast("double").alias(c) for k, c in enumerate(("tx", "ty"))]
    own = lambda side: [F.col(c).alias(c + side) for c in (*PAIR, "block")]
    # equal shifts fall into one block
    given = hypotheses.join(blocks, PAIR).select(*PAIR, "draw", "root", *shift, "blocks").withColumn("block", F.pmod(F.xxhash64("tx", "ty"), F.col("blocks")).cast("int")).select(*own("_h"), "draw", "root", "tx", "ty")
    sent = matches.join(blocks, PAIR).select(*PAIR, (F.col("x2") - F.col("x1")).cast("double").alias("dx"), (F.col("y2") - F.col("y1")).cast("double").alias("dy"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(*own("_m"), "dx", "dy")
    kinds = dict(zip((*PAIR, "draw", "root", "value", "upto"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True))

    def run(key, h: pa.Table, m: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], t) for c, t in kinds.items()})
        number = lambda t, c: t.column(c).to_numpy().astype(float)
        shifts, moved = np.stack((number(h, "tx"), number(h, "ty")), axis=1), np.stack((number(m, "dx"), number(m, "dy")), axis=1)
        known = np.flatnonzero(np.isfinite(shifts).all(axis=1))
        moved = moved[np.isfinite(moved).all(axis=1)]
        if not len(known) or not len(moved):
            return none
        draw, root = (h.column(c).to_numpy()[known].astype(np.int64) for c in ("draw", "root"))
        order = np.lexsort((root, draw))  # of equal shifts the least draw and root counts
        draw, root = draw[order], root[order]
        shifts, at = np.unique(shifts[known][order], axis=0, return_index=True)
        draw, root = draw[at], root[at]
        moved, times = np.unique(moved, axis=0, return_counts=True)
        judged = [judge(first, last, owner, e, times[at], m.num_rows) for first, last, owner, at, e in _near_shifts(shifts, moved, reach)]
        value, upto = (np.concatenate([j[k] for j in judged]) for k in range(2))
        best = np.lexsort((root, draw, np.round(value, 9)))[0]
        if not np.isfinite(value[best]):
            return none
        found = (key[0].as_py(), key[1].as_py(), draw[best], root[best], round(float(value[best]), 9), upto[best])
        return pa.table({c: pa.array([v], t) for (c, t), v in zip(kinds.items(), found, strict=True)})

    found = given.groupBy("iid_i_h", "iid_j_h", "block_h").cogroup(sent.groupBy("iid_i_m", "iid_j_m", "block_m")).applyInArrow(run, "iid_i long, iid_j long, draw int, root int, value double, upto long")
    best = found.groupBy(*PAIR).agg(F.min(F.struct("value", "draw", "root", "upto")).alias("b"))
    return best.select(*PAIR, "b.draw", "b.root", "b.value", "b.upto")


def _by_size(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches of pairs that fit a task, and those of larger pairs."""
    sizes = matches.groupBy(*PAIR).agg((F.count(F.lit(1)) > _MATCHES).alias("large"))
    marked = matches.join(sizes, PAIR)
    return marked.filter("not large").drop("large"), marked.filter("large").drop("large")


def ransac(matches: DataFrame, hypotheses: DataFrame, model: str, threshold: float) -> DataFrame:
    """Matches of each pair within the threshold of the hypothesis that has the most; ties to the least draw."""
    few, many = _by_size(matches)

    def counted(errors: np.ndarray):
        inliers = (errors < threshold * threshold).sum(axis=1)
        return np.where(inliers > 0, -inliers.astype(float), np.inf), inliers

    def shifts(first, last, owner, e, times, n):
        inliers = np.bincount(owner, np.where(e < threshold * threshold, times, 0), last - first)
        return np.where(inliers > 0, -inliers, np.inf), inliers.astype(np.int64)

    best = _best_shifts(few, hypotheses, threshold, shifts) if model == "translation" else _best_in_blocks(few, hypotheses, model, counted)
    best = best.select(*PAIR, "draw", "root", F.col("upto").alias("inliers"))
    counts = score(many, hypotheses, model).filter(F.col("error") < threshold * threshold).groupBy(*PAIR, "draw", "root").agg(F.count(F.lit(1)).alias("inliers"))
    most = counts.groupBy(*PAIR).agg(F.min(F.struct((-F.col("inliers")).alias("minus"), "draw", "root", "inliers")).alias("b"))
    best = best.unionByName(most.select(*PAIR, "b.draw", "b.root", "b.inliers"))
    chosen = hypotheses.join(best, [*PAIR, "draw", "root"])
    return score(matches, chosen, model).filter(F.col("error") < threshold * threshold).select(*PAIR, "fid_i", "fid_j", "draw", "inliers")


def log10_factorial(n: Column) -> Column:
    """log10(n!) of a whole number: exact below 16, beyond it Stirling's series to within 1e-11."""
    exact = F.array(*(F.lit(math.log10(math.factorial(k))) for k in range(16)))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, F.get(exact, n.cast("int"))).otherwise(series / math.log(10))


def ac_ransac(matches: DataFrame, hypotheses: DataFrame, model: str, width: int, height: int, threshold: float = 5.0) -> DataFrame:
    """A-contrario selection: the inliers of the hypothesis and error bound with the least log10 NFA, if below 0.

    For the k-th least error e_k of a hypothesis on n matches with sample size s:
    log10(M (n - s)) + (k - s) (log alpha0 + mult log10 e_k) + log10 C(n, k) + log10 C(k, s),
    over k > s with e_k <= threshold^2; errors in units of the conditioned image. M is 3 for fundamental, else 1.
    """
    s = SAMPLE[model]
    roots, line = (3, True) if model == "fundamental" else (1, False)
    unit = 1 / (width * height)  # squared scale of the conditioning
    alpha = math.log10(2.0 * math.hypot(width, height) / (width * height) * math.sqrt(width * height)) if line else math.log10(math.pi)
    mult = 0.5 if line else 1.0
    log_s = sum(math.log10(x) for x in range(1, s + 1))
    few, many = _by_size(matches)

    def least(errors: np.ndarray):
        n = errors.shape[1]
        if n <= s:
            return np.full(len(errors), np.inf), np.zeros(len(errors), dtype=int)
        logs = np.concatenate(([0.0], np.cumsum(np.log10(np.arange(1, n + 1)))))  # log10 of factorials
        k = np.arange(s + 1, n + 1)
        choices = logs[n] - logs[n - k] - log_s - logs[k - s]
        # residuals beyond the threshold are in no selection: only the others are put in order, at the front
        errors = np.where(errors <= threshold * threshold, errors, np.inf)
        within = int(np.isfinite(errors).sum(axis=1).max())
        if within <= s:
            return np.full(len(errors), np.inf), np.zeros(len(errors), dtype=int)
        if within < n // 2:
            errors = np.partition(errors, within - 1, axis=1)[:, :within]
        errors = np.sort(errors, axis=1)[:, :within]
        k = k[: within - s]
        choices = choices[: within - s]
        e = errors[:, s:]
        nfa = math.log10(roots * (n - s)) + (k - s) * (alpha + mult * np.log10(e * unit + 1e-30)) + choices
        nfa = np.where(e <= threshold * threshold, nfa, np.inf)
        at = np.round(nfa, 9).argmin(axis=1)
        value = nfa[np.arange(len(nfa)), at]
        return np.where(value < 0, value, np.inf), k[at]

    def shifts(first, last, owner, e, times, n):
        value, upto = np.full(last - first, np.inf), np.zeros(last - first, dtype=np.int64)
        if n <= s or not len(owner):
            return value, upto
        logs = np.concatenate(([0.0], np.cumsum(np.log10(np.arange(1, n + 1)))))
        begin = np.searchsorted(owner, owner)  # place of the first of the same shift
        total = np.cumsum(times)
        end = total - (total - times)[begin]  # matches up to and with these
        # among matches of equal distance the NFA is concave in k, so the least is at the first or the last of them
        k = np.stack((np.maximum(end - times + 1, s + 1), end), axis=1)
        usable = (k > s) & (k <= end[:, None])
        kk = np.where(usable, k, s + 1)
        nfa = math.log10(roots * (n - s)) + (kk - s) * (alpha + mult * np.log10(e * unit + 1e-30))[:, None] + (logs[n] - logs[n - kk] - log_s - logs[kk - s])
        nfa, kk, who = np.where(usable, nfa, np.inf).ravel(), kk.ravel(), np.repeat(owner, 2)
        order = np.lexsort((kk, np.round(nfa, 9), who))
        one = order[np.unique(who[order], return_index=True)[1]]
        value[who[one]], upto[who[one]] = np.where(nfa[one] < 0, nfa[one], np.inf), kk[one]
        return value, upto

    best = _best_shifts(few, hypotheses, threshold, shifts) if model == "translation" else _best_in_blocks(few, hypotheses, model, least)
    best = best.select(*PAIR, "draw", "root", F.col("value").alias("nfa"), "upto")
    ranked = _ranked(score(many, hypotheses, model), unit)
    usable = ranked.filter((F.col("k") > s) & (F.col("n") > s) & (F.col("error") <= threshold * threshold))
    n, k = F.col("n"), F.col("k")
    choices = log10_factorial(n) - log10_factorial(n - k) - F.lit(log_s) - log10_factorial(k - s)
    nfa = F.log10(roots * (n - s)) + (k - s) * (alpha + mult * F.log10(F.col("e") + 1e-30)) + choices
    least_of = usable.withColumn("nfa", nfa).groupBy(*PAIR).agg(F.min(F.struct(F.round("nfa", 9).alias("nfa"), "draw", "root", F.col("k").alias("upto"))).alias("b")).filter("b.nfa < 0")
    best = best.unionByName(least_of.select(*PAIR, "b.draw", "b.root", "b.nfa", "b.upto"))
    chosen = hypotheses.join(best, [*PAIR, "draw", "root"])
    return _ranked(score(matches, chosen, model), unit).filter(F.col("k") <= F.col("upto")).select(*PAIR, "fid_i", "fid_j", "draw", "nfa")


def _ranked(scored: DataFrame, unit: float) -> DataFrame:
    """Scored matches with e, their place k by it under their hypothesis, and the number n of matches there."""
    w = Window.partitionBy(*PAIR, "draw", "root")
    with_e = scored.withColumn("e", F.col("error") * unit)
    return with_e.withColumn("k", F.row_number().over(w.orderBy(F.expr("coalesce(e, double('infinity'))"), "fid_i", "fid_j")).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def ac_ransac_reserved(matches: DataFrame, model: str, width: int, height: int, threshold: float = 5.0, draws: int = 1024, reserve: float = 0.1, seed: int = 0) -> DataFrame:
    """ac_ransac() on sampled hypotheses, a share `reserve` of the draws kept for samples among the inliers of the best.

    The first draws are spread over all matches; the reserved ones are taken from the inliers they
    select, pair by pair, and compete with the best first one. Pairs without inliers have none.
    """
    from ..session import stage

    m, later = SAMPLE[model], int(draws * reserve)
    first = stage(fit_minimal(sample_hypotheses(matches, m, draws - later, seed), model), "ransac-hypotheses")
    chosen = stage(ac_ransac(matches, first, model, width, height, threshold), "ransac-inliers")
    inliers = matches.join(chosen.select(*PAIR, "fid_i", "fid_j"), [*PAIR, "fid_i", "fid_j"], "left_semi")
    more = fit_minimal(sample_hypotheses(inliers, m, later, seed + 1), model).withColumn("draw", F.col("draw") + draws)
    winners = first.join(chosen.select(*PAIR, "draw").distinct(), [*PAIR, "draw"], "left_semi")
    return ac_ransac(matches, stage(winners.unionByName(more), "ransac-reserve"), model, width, height, threshold)


# -- exact solves -------------------------------------------------------------------------------


def _solved(df: DataFrame, model: str) -> DataFrame:
    """Adds model, solved from the array column pts of (x1, y1, x2, y2), all sets of a batch at once; null where degenerate or too few."""
    from pyspark.sql import types as T

    names = [c for c in df.columns if c != "pts"]

    def run(batches):
        for f in batches:
            models = np.full((f.num_rows, 9 if model != "affine" else 6), np.nan)
            for n, places, sets in _stacks(f.column("pts")):
                if n >= SAMPLE[model]:
                    models[places] = SOLVERS[model](sets)
            yield pa.RecordBatch.from_arrays([*(f.column(c) for c in names), _lists(models, np.isfinite(models).all(axis=1))], names=[*names, "model"])

    schema = T.StructType([*(x for x in df.schema.fields if x.name != "pts"), T.StructField("model", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def homography4(df: DataFrame) -> DataFrame:
    """Homography through four point pairs."""
    return _solved(df, "homography")


def affine3(df: DataFrame) -> DataFrame:
    """Affine map through three point pairs."""
    return _solved(df, "affine")
