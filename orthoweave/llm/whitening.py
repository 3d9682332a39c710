"""Whitening of embeddings by principal components from an exact characteristic polynomial.

1. Entries c become whole numbers x = floor(64 c) + 1000000. The scatter M = n * sum(x x') - S S' (n vectors,
   sums S) is n^2 times their covariance and does not change when x is shifted, so floor(64 c) is summed.
   Tasks multiply blocks in double where no partial sum can leave 2^53, by limbs where one could; the sums
   of all tasks are added as decimals. M is exact.
2. Its characteristic polynomial is found modulo many primes below 2^31, each by reduction to Hessenberg
   form, in tasks; the Chinese remainders give its whole coefficients. Enough primes are taken for the
   bound C(d, k) (trace / d)^k of coefficient k (Maclaurin, as all roots are real and not negative).
3. All roots are real, so the sign changes of p(x + a) are exactly the number of roots above a, counted
   with multiplicity. Bisection by that count isolates the greatest roots, quadratic interval refinement
   by the sign of p carries them to 120 digits. Zero roots are the trailing zero coefficients.
4. A component is the null vector of M - e by inverse iteration in decimals of 120 digits, one task a root.
   Roots that agree in 60 digits are one root of higher multiplicity and get orthonormal vectors together.

The driver holds d^2 sums and the polynomial, whatever the number of rows.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
_DIGITS = 120
#: roots whose relative distance is below 10^-_SAME are one
_SAME = 60
#: entries beyond this have no whole number x in a long
_LARGEST = float(1 << 56)
_LIMB = 40


# -- rows and the exact scatter -----------------------------------------------------------------


def valid(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec array<double> of the rows that take part.

    Null vectors, empty ones and those with null, NaN or infinite entries are left out, and so are entries of
    2^56 and more in size, whose x is no long. Rows with null or repeated ids stay, each for itself.
    """
    entry = F.col("vec")
    usable = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < _LARGEST), F.lit(False)))
    return embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec")).filter(usable)


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length (ties: the greatest), and that length; 0 if there is no row."""
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return (rows.filter(F.size("vec") == first[0].dim), first[0].dim) if first else (rows, 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) as int64: x without its shift."""
    return np.floor(vectors * SCALE).astype(np.int64)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers. Doubles hold every partial sum where it stays below 2^53; else limbs of 16 bits."""
    integers = np.vectorize(int, otypes=[object])
    top = int(max(y.max(), -y.min())) if y.size else 0
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return integers(f.T @ f)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a in range(0, len(y), 1 << 20):  # products of limbs stay below 2^33, sums of 2^20 of them below 2^53
        rows = y[a : a + (1 << 20)]
        limbs = [((rows >> 16 * k) & 0xFFFF if k < 3 else rows >> 48).astype(np.float64) for k in range(4)]
        for i, u in enumerate(limbs):
            for j, v in enumerate(limbs):
                total += integers(u.T @ v) << (16 * (i + j))
    return total


@dataclass(frozen=True)
class Scatter:
    n: int
    #: sums of floor(64 c)
    sums: list[int]
    #: n * sum(y y') - sums sums', whole numbers
    matrix: list[list[int]]


def scatter(rows: DataFrame, dim: int) -> Scatter:
    """The exact scatter of the rows. Each task sends d (d + 3) / 2 + 1 numbers, as limbs of 40 bits."""
    upper = np.triu_indices(dim)

    def partial(batches):
        gram, sums, n = np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object), 0
        for batch in batches:
            y = whole(_matrix(batch.column(0), dim))
            gram += exact_gram(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
            n += len(y)
        values = [n, *sums.tolist(), *gram[upper].tolist()]
        limbs = [[(v >> (_LIMB * k)) & ((1 << _LIMB) - 1) for v in values] for k in range(3)] + [[v >> (3 * _LIMB) for v in values]]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], names=["place", "l0", "l1", "l2", "l3"])

    parts = rows.select("vec").mapInArrow(partial, "place int, l0 long, l1 long, l2 long, l3 long")
    added = parts.groupBy("place").agg(*(F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(4)))
    values = [0] * (1 + dim + len(upper[0]))
    for r in added.collect():  # d (d + 3) / 2 + 1 rows
        values[r.place] = sum(int(r[f"l{k}"]) << (_LIMB * k) for k in range(4))
    n, sums = values[0], values[1 : dim + 1]
    m = [[0] * dim for _ in range(dim)]
    for i, j, g in zip(*(u.tolist() for u in upper), values[dim + 1 :], strict=True):
        m[i][j] = m[j][i] = n * g - sums[i] * sums[j]
    return Scatter(n, sums, m)


# -- the characteristic polynomial --------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide all numbers below 3.4e14."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        x = pow(a, odd, n)
        if a % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, from the greatest down, whose product exceeds 2^bits."""
    found, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits:
        if _is_prime(p):
            found.append(p)
            have += math.log2(p)
        p -= 2
    return found


def hessenberg_polynomial(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from x^d down, of det(x - m) modulo the prime p (below 2^31); m: residues as int64."""
    h, d = m.copy(), len(m)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:  # a row exchange, and the same of the columns
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1][None, :] % p) % p
        # the column gains the sum of the columns times the factors, by halves of the factors
        high, low = factors >> 16, factors & 0xFFFF
        added = ((h[:, k + 2 :] * high % p).sum(axis=1) % p * (1 << 16) + (h[:, k + 2 :] * low % p).sum(axis=1)) % p
        h[:, k + 1] = (h[:, k + 1] + added) % p
    # polys[k]: of the leading k x k block, from x^0 up
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, dtype=np.int64)
        new[1:] = polys[k - 1, :-1]
        new = (new - polys[k - 1] * int(h[k - 1, k - 1])) % p
        weight = 1
        for i in range(k - 2, -1, -1):
            weight = weight * int(h[i + 1, i]) % p
            if not weight:
                break
            new = (new - polys[i] * (int(h[i, k - 1]) * weight % p)) % p
        polys[k] = new
    return polys[d][::-1]


def characteristic_polynomial(spark, m: list[list[int]], primes_a_task: int = 16) -> list[int]:
    """Whole coefficients, from x^d down, of det(x - m) for a symmetric m without negative eigenvalues."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    mean = -(-trace // d)
    bits = max(math.comb(d, k) * mean**k for k in range(d + 1)).bit_length() + 1
    primes = primes_for(bits)

    def reduce(frames):
        for f in frames:
            for p in f["p"].tolist():
                residues = np.array([[x % p for x in row] for row in m], dtype=np.int64)
                yield pd.DataFrame({"p": [p], "residues": [hessenberg_polynomial(residues, p)]})

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // primes_a_task))
    found = {r.p: r.residues for r in table.mapInPandas(reduce, "p long, residues array<long>").collect()}
    product = math.prod(primes)
    total = [0] * (d + 1)
    for p in primes:
        rest = product // p
        lift = rest * pow(rest, -1, p)
        total = [(t + r * lift) % product for t, r in zip(total, found[p], strict=True)]
    return [t - product if 2 * t > product else t for t in total]


# -- real roots ---------------------------------------------------------------------------------


class RealRoots:
    """The positive roots of a whole polynomial all of whose roots are real."""

    def __init__(self, coefficients: list[int]):
        trimmed = list(coefficients)
        while len(trimmed) > 1 and trimmed[-1] == 0:  # roots that are zero
            trimmed.pop()
        self.up = trimmed[::-1]
        self.degree = len(trimmed) - 1

    def above(self, a: int, scale: int) -> int:
        """Number of roots greater than a / 2^scale, with multiplicity: sign changes of the shifted polynomial."""
        c = [x << (scale * (self.degree - k)) for k, x in enumerate(self.up)]
        for i in range(self.degree):
            for k in range(self.degree - 1, i - 1, -1):
                c[k] += a * c[k + 1]
        signs = [x > 0 for x in c if x]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def value(self, a: int, scale: int) -> int:
        """p(a / 2^scale) times 2^(scale * degree)."""
        total = 0
        for k, x in enumerate(reversed(self.up)):
            total = total * a + (x << (scale * k))
        return total

    def greatest(self, count: int) -> list[tuple[int, int]]:
        """The `count` greatest positive roots with multiplicity (or all), falling, as (a, scale) for a / 2^scale."""
        if self.degree < 1:
            return []
        n_positive = self.above(0, 0)
        wanted = min(count, n_positive)
        if not wanted:
            return []
        top = 0
        while self.above(1 << top, 0):
            top += 1
        # 400 bits below the top in the finest case: beyond that, roots of one interval are one
        finest = 400
        work, found = [(0, 1 << top, 0, 0, n_positive)], []  # (low, high], scale, roots above high, roots above low
        while work:
            low, high, scale, over, under = work.pop()
            if over >= wanted:
                continue
            if under - over == 1:
                found.append((over, 1, *self._refine(low, high, scale, finest - top)))
            elif scale > finest - top:
                found.append((over, under - over, high, scale))
            else:
                middle = low + high
                mid_count = self.above(middle, scale + 1)
                if mid_count > over:
                    work.append((middle, 2 * high, scale + 1, over, mid_count))
                if under > mid_count:
                    work.append((2 * low, middle, scale + 1, mid_count, under))
        roots = [(a, s) for _, times, a, s in sorted(found) for _ in range(times)]
        return roots[:wanted]

    def _refine(self, low: int, high: int, scale: int, until: int) -> tuple[int, int]:
        """The one simple root in (low, high] / 2^scale to 2^-until, by quadratic interval refinement."""
        if (at_high := self.value(high, scale)) == 0:
            return high, scale
        sign, at_low, grow = at_high > 0, self.value(low, scale), 2
        while scale < until:
            if at_low == 0 or (at_low > 0) == sign:  # the root of another interval lies on this edge: move off it
                low, high, scale = 2 * low, 2 * high, scale + 1
                middle = (low + high) // 2
                v = self.value(middle, scale)
                if v == 0:
                    return middle, scale
                low, high = (low, middle) if (v > 0) == sign else (middle, high)
                at_high, at_low = self.value(high, scale), self.value(low, scale)
                continue
            step = 1 << grow
            share = abs(at_low) * step // (abs(at_low) + abs(at_high))
            low, high, scale = low << grow, high << grow, scale + grow
            width = (high - low) // step
            a = low + min(share, step - 1) * width
            b = a + width
            va, vb = self.value(a, scale), self.value(b, scale)
            if va == 0 or vb == 0:
                return (a if va == 0 else b), scale
            if (va > 0) != sign and (vb > 0) == sign:
                low, high, at_low, at_high = a, b, va, vb
                grow = min(2 * grow, max(2, until - scale))
            else:  # the guess missed: halve, and guess more carefully
                low, at_low, high, at_high = (low, self.value(low, scale), a, va) if (va > 0) == sign else (b, vb, high, self.value(high, scale))
                grow = max(1, grow // 2)
        return high, scale


# -- components ---------------------------------------------------------------------------------


def null_vectors(m: list[list[int]], root: decimal.Decimal, times: int) -> list[list[decimal.Decimal]]:
    """`times` orthonormal vectors v with m v = root v, by inverse iteration in decimals."""
    with decimal.localcontext(decimal.Context(prec=_DIGITS)):
        d, zero = len(m), decimal.Decimal(0)
        tiny = (abs(root) + 1) * decimal.Decimal(10) ** (-(_DIGITS - 10))
        a = [[decimal.Decimal(x) for x in row] for row in m]
        for i in range(d):
            a[i][i] -= root
        order = list(range(d))
        for k in range(d):  # rows in place: L below the diagonal, U on and above it
            at = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[at] = a[at], a[k]
            order[k], order[at] = order[at], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            top, tail = a[k][k], a[k][k + 1 :]
            for i in range(k + 1, d):
                if a[i][k]:
                    f = a[i][k] / top
                    a[i] = [*a[i][:k], f, *(x - f * y for x, y in zip(a[i][k + 1 :], tail, strict=True))]

        def solve(b):
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), zero)
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), zero)) / a[i][i]
            return x

        def orthonormal(vectors):
            out = []
            for v in vectors:
                for _ in range(2):
                    for u in out:
                        c = sum((x * y for x, y in zip(u, v, strict=True)), zero)
                        v = [y - c * x for x, y in zip(u, v, strict=True)]
                    length = sum((x * x for x in v), zero).sqrt()
                    v = [x / length for x in v]
                out.append(v)
            return out

        rng = np.random.default_rng([d, times])
        vectors = orthonormal([[decimal.Decimal(int(x)) for x in rng.integers(1, 1000, d)] for _ in range(times)])
        for _ in range(3):
            vectors = orthonormal([solve(v) for v in vectors])
        return vectors


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    #: eigenvalues of the covariance, falling
    values: np.ndarray
    #: share of the trace of each
    explained: np.ndarray
    #: unit vectors, one a row
    components: np.ndarray


def fit(rows: DataFrame, dim: int, components: int = 32) -> Whitening | None:
    """Components of the rows with the greatest eigenvalues; those whose eigenvalue is zero are not among them.

    None if there is no row or no row differs from another.
    """
    s = scatter(rows, dim) if dim else None
    if not s or not s.n or not any(s.matrix[i][i] for i in range(dim)):
        return None
    spark, m = rows.sparkSession, s.matrix
    found = RealRoots(characteristic_polynomial(spark, m)).greatest(components)
    with decimal.localcontext(decimal.Context(prec=_DIGITS)):
        roots = [decimal.Decimal(a) / decimal.Decimal(1 << scale) if scale >= 0 else decimal.Decimal(a << -scale) for a, scale in found]
        groups: list[list] = []
        for r in roots:
            if groups and (groups[-1][0] - r) <= groups[-1][0] * decimal.Decimal(10) ** -_SAME:
                groups[-1][1] += 1
            else:
                groups.append([r, 1])
        trace = decimal.Decimal(sum(m[i][i] for i in range(dim)))
        values = np.array([float(r / decimal.Decimal(s.n) ** 2) for r in roots])
        explained = np.array([float(r / trace) for r in roots])

    def solve(frames):
        for f in frames:
            for first, root, times in zip(f["first"].tolist(), f["root"].tolist(), f["times"].tolist(), strict=True):
                vectors = null_vectors(m, decimal.Decimal(root), times)
                yield pd.DataFrame({"place": range(first, first + times), "vec": [[float(x) for x in v] for v in vectors]})

    starts = np.cumsum([0, *(t for _, t in groups)]).tolist()
    wanted = [(a, str(r), t) for a, (r, t) in zip(starts, groups, strict=False)]
    table = spark.createDataFrame(wanted, "first int, root string, times int").repartition(min(len(wanted), 64))
    vectors = {r.place: r.vec for r in table.mapInPandas(solve, "place int, vec array<double>").collect()}
    return Whitening(s.n, s.sums, values, explained, np.array([vectors[k] for k in range(len(roots))]))


# -- whitened rows ------------------------------------------------------------------------------


def transform(rows: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """vec_id, deviation decimal(38,0), whitened array<double> of each row: one entry a component."""
    n, sums = model.n, model.sums
    weights = (model.components / np.sqrt(model.values)[:, None]).T
    largest = max(map(abs, sums), default=0)
    sums_long = np.array(sums, dtype=np.int64) if largest < 1 << 62 else None

    def run(batches):
        for batch in batches:
            y = whole(_matrix(batch.column(1), dim))
            top = int(max(y.max(), -y.min())) if y.size else 0
            far = n * top + largest
            centred = n * y - sums_long if far < 1 << 62 else n * y.astype(object) - np.array(sums, dtype=object)
            if far * far * dim < 1 << 63:
                deviation = (centred * centred).sum(axis=1).tolist()
            else:
                deviation = [sum(x * x for x in row) for row in centred.tolist()]
            # beyond a decimal of 38 digits there is no value
            deviation = pa.array([decimal.Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
            whitened = (centred / n).astype(np.float64) @ weights
            k = whitened.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int, count: int) -> float:
    """The largest absolute entry of the covariance of `whitened` less the identity; count (count + 1) sums reach the driver."""

    def partial(batches):
        total, sums = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            w = _matrix(batch.column(0), count)
            total += w.T @ w
            sums += w.sum(axis=0)
        values = np.concatenate((sums, total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["place", "part"])

    parts = whitened.select("whitened").mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    values = np.zeros(count * (count + 1))
    for r in parts.collect():
        values[r.place] = r.part / n
    mean, products = values[:count], values[count:].reshape(count, count)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(count)).max())


def whiten(embeddings: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, eigenvalue, explained, identity_error of each row and component.

    Rows as in valid(), and only those of the commonest length (ties: the greatest). Components are numbered from
    1 by falling eigenvalue; an eigenvalue of zero gives none, so there are as many as the rank where that is less.
    deviation is the sum of (n x - S)^2, null beyond 38 digits. Without rows, or where all are equal, the
    result is empty. Ids may be null or repeated; other columns are not read.
    """
    rows, dim = of_one_length(valid(embeddings, id_col, vector_col))
    model = fit(rows, dim, components)
    spark = embeddings.sparkSession
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double")
    whitened = transform(rows, dim, model)
    error = identity_error(whitened, model.n, len(model.values))
    constant = F.array(*(F.struct(F.lit(float(e)).alias("eigenvalue"), F.lit(float(x)).alias("explained")) for e, x in zip(model.values, model.explained, strict=True)))
    long_rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "w")).withColumn("of", F.get(constant, F.col("place")))
    return long_rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), "of.eigenvalue", "of.explained", F.lit(error).alias("identity_error")
    )
