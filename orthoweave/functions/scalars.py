"""Column functions: numbers, strings, paths, vectors and predicates. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- numbers ------------------------------------------------------------------------------------


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def clip(x: Column, low, high) -> Column:
    """low <= result <= high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def is_inf(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) == float("inf"))


def any_nan(values: Column) -> Column:
    return F.exists(values, F.isnan)


def any_inf(values: Column) -> Column:
    return F.exists(values, is_inf)


def almost_zero(x: Column) -> Column:
    return F.abs(x) < 1e-4


def sigmoid(x: Column, alpha: float) -> Column:
    return 1 / (1 + F.exp(-x * alpha))


def scaled_sigmoid(x: Column, alpha: float, x0: float) -> Column:
    """Sigmoid over [-x0, x0], moved and stretched so that 0 -> 0 and 1 -> 1."""
    low, high = sigmoid(F.lit(-x0), alpha), sigmoid(F.lit(x0), alpha)
    return (sigmoid(2 * x0 * x - x0, alpha) - low) / (high - low)


def saturate(x: Column, low: int, high: int, kind: str) -> Column:
    """Cast with values beyond the type's range set to its ends."""
    return clip(x, low, high).cast(kind)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as double; 0 unless 0 <= k <= n."""
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long")))
    product = F.aggregate(steps, F.lit(1.0), lambda s, i: s * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.round(product))


# -- strings ------------------------------------------------------------------------------------

BLANKS = " \n\r\t"


def starts_with(text: Column, prefix: Column) -> Column:
    """False for an empty prefix."""
    return (F.length(prefix) > 0) & F.startswith(text, prefix)


def ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def split_any(text: Column, delimiters: str) -> Column:
    """Split at any of the delimiter characters."""
    return F.split(text, "[" + "".join("\\" + c for c in delimiters) + "]")


def csv_values(text: Column) -> Column:
    """Numbers of a `,` or `;` list; blanks are trimmed and empty fields skipped; any bad field gives an empty list."""
    fields = F.filter(F.transform(F.split(text, "[,;]"), trim), lambda x: x != "")
    numbers = F.transform(fields, lambda x: x.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers).otherwise(F.array().cast("array<double>"))


def csv_text(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ", ")


# -- paths --------------------------------------------------------------------------------------


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(forward(path), "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(forward(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the last dot of the file name, with the dot; empty without one."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    """File name before its first dot."""
    return F.regexp_extract(file_name(path), r"^([^.]*)", 1)


def root_of(path: Column) -> Column:
    """The path without its extension."""
    return F.regexp_replace(forward(path), r"\.[^./]*$", "")


def has_extension(path: Column, ext: str) -> Column:
    return F.lower(extension(path)) == ext.lower()


def with_slash(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))


def join_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "/+", "/")


# -- vectors: a vector is a sequence of columns --------------------------------------------------


def dot(a, b) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(a, b, strict=True)))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> list[Column]:
    n = norm(a)
    return [F.try_divide(x, n) for x in a]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def matvec(m, v) -> list[Column]:
    """Rows of m times v; m is a flat row-major sequence."""
    n = len(v)
    return [dot(m[i : i + n], v) for i in range(0, len(m), n)]


def matmul3(a, b) -> list[Column]:
    return [dot(a[3 * i : 3 * i + 3], [b[j], b[j + 3], b[j + 6]]) for i in range(3) for j in range(3)]


def det3(m) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse2(m) -> list[Column]:
    d = m[0] * m[3] - m[1] * m[2]
    return [F.try_divide(x, d) for x in (m[3], -m[1], -m[2], m[0])]


def inverse3(m) -> list[Column]:
    d = det3(m)
    adjugate = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    return [F.try_divide(x, d) for x in adjugate]


def dehomogenize(v) -> list[Column]:
    return [F.try_divide(x, v[-1]) for x in v[:-1]]


# -- planar geometry ----------------------------------------------------------------------------


def quantize(x: Column, scale: int = 1000) -> Column:
    return F.round(x * scale).cast("long")


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Orientation of c against the line a-b: 1 left, -1 right, 0 on it."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_touch(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Closed segments ab and cd have a common point."""
    on = lambda px, py, qx, qy, rx, ry: (rx >= F.least(px, qx)) & (rx <= F.greatest(px, qx)) & (ry >= F.least(py, qy)) & (ry <= F.greatest(py, qy))
    o1, o2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    o3, o4 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & on(ax, ay, bx, by, cx, cy))
        | ((o2 == 0) & on(ax, ay, bx, by, dx, dy))
        | ((o3 == 0) & on(cx, cy, dx, dy, ax, ay))
        | ((o4 == 0) & on(cx, cy, dx, dy, bx, by))
    )


def line_distance2(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of p from the infinite line through a and b."""
    c = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return F.try_divide(c * c, (bx - ax) * (bx - ax) + (by - ay) * (by - ay))
