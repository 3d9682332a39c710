"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A unit vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
nearest signed axis. In every table two such rotations are concatenated: the first hash is the bucket,
the second the cell inside it. A query's score for a cell is the sum of its two rotated coordinates on
these axes, and it probes the cells of all tables whose score reaches one threshold, so probes go where
they are likeliest to pay, whatever the table. The threshold is measured: for a bounded sample of queries
the true neighbours are found by one exact pass over all rows, and the greatest threshold that finds the
target share of them is taken. Candidates are re-ranked exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, eight ways a step; the width is a power of two."""
    n, width = x.shape
    left = width
    while left > 1:
        ways = min(8, left)
        small = np.array([[(-1.0) ** (i & j).bit_count() for j in range(ways)] for i in range(ways)])
        # the last digit of the place is transformed and becomes the first
        x = np.ascontiguousarray((x.reshape(-1, ways) @ small).reshape(n, width // ways, ways).transpose(0, 2, 1)).reshape(n, width)
        left //= ways
    return x / np.sqrt(width)


@dataclass(frozen=True)
class CrossPolytope:
    dim: int
    tables: int = 8
    seed: int = 17

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def rotate(self, vectors: np.ndarray, table: int, part: int) -> np.ndarray:
        """Unit vectors under the pseudo-rotation of one table and part (0 bucket, 1 cell)."""
        y = np.zeros((len(vectors), self.width))
        # scaled first, so that the norm of very long or short vectors is a number
        y[:, : self.dim] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        rng = np.random.default_rng([self.seed, table, part])
        for _ in range(3):
            y = hadamard(y * rng.choice((-1.0, 1.0), self.width))
        return y

    def hashes(self, vectors: np.ndarray, table: int, part: int) -> np.ndarray:
        """Nearest signed axis of each vector: 2 * axis, and 1 more on its negative side."""
        y = self.rotate(vectors, table, part)
        axis = np.abs(y).argmax(axis=1)
        return 2 * axis + (y[np.arange(len(y)), axis] < 0)

    def scores(self, vectors: np.ndarray, table: int, part: int) -> np.ndarray:
        """The coordinate of each vector on every signed axis: the greater, the likelier its neighbours hash there."""
        y = self.rotate(vectors, table, part)
        return np.stack((y, -y), axis=2).reshape(len(y), -1)


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v of the rows that take part: an id, and a vector that is not null, zero or partly null or not finite."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"  # floats stay floats until they are multiplied
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    return kept.filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))


def _hits(query: np.ndarray, found: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query.astype(np.int64), "vec_id": found.astype(np.int64), "score": score.astype(np.float64)})


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, cells: np.ndarray | None = None, probed: np.ndarray | None = None) -> pd.DataFrame:
    """Each query's k nearest distinct ids in a block of candidates, without itself.

    cells: the cell of each candidate; probed[i, cell]: does query i look there? Without them it looks
    everywhere. Equal vectors get the very same score, so that ties go by id: products of matrices
    only choose, with a margin, and the scores that are returned are summed pair by pair.
    """
    # columns in the order of cells, and of ids inside a cell
    cells = np.zeros(len(c), dtype=np.int64) if cells is None else cells
    order = np.lexsort((c_ids, cells))
    c_ids, c, cells = c_ids[order], c[order], cells[order]
    names, begin, sizes = np.unique(cells, return_index=True, return_counts=True)
    repeated = len(np.unique(c_ids)) < len(c_ids)
    size = float((q * q).sum(axis=1).max() * (c * c).sum(axis=1).max()) if len(q) and len(c) else 0.0
    margin = 1e-12 * np.sqrt(size)
    out = [_hits(q_ids[:0], c_ids[:0], q[:0, 0])]
    looks_all = np.ones((len(q), len(names)), dtype=bool) if probed is None else probed[:, names]
    # queries in chunks of about two million pairs
    chunk = np.cumsum(looks_all @ sizes) // (1 << 21)
    for first, last in zip(*(np.searchsorted(chunk, np.unique(chunk), side=side) for side in ("left", "right")), strict=True):
        part, looks = np.arange(first, last), looks_all[first:last]
        # all pairs of a query and a candidate, query by query
        query, cell = np.nonzero(looks)
        past = np.cumsum(sizes[cell])
        place = np.zeros(looks.shape, dtype=np.int64)
        place[query, cell] = past - sizes[cell]
        r = np.repeat(query, sizes[cell])
        if not len(r):
            continue
        f = np.arange(len(r)) - np.repeat(place[query, cell] - begin[cell], sizes[cell])
        v = np.empty(len(r))
        for j in range(len(names)):
            who = np.flatnonzero(looks[:, j])
            if len(who):
                v[place[who, j][:, None] + np.arange(sizes[j])] = q[part[who]] @ c[begin[j] : begin[j] + sizes[j]].T
        r, f, v = (x[q_ids[part[r]] != c_ids[f]] for x in (r, f, v))
        lead = np.arange(len(r))
        if repeated:  # an id counts by its best row
            by_id = np.lexsort((-v, c_ids[f], r))
            lead = by_id[np.concatenate(([True], (r[by_id][1:] != r[by_id][:-1]) | (c_ids[f][by_id][1:] != c_ids[f][by_id][:-1])))[: len(by_id)]]
        # a query's k-th best id bounds what can be among its k best
        lead = lead[np.lexsort((-v[lead], r[lead]))]
        count = np.bincount(r[lead], minlength=len(part))
        full = count >= k
        bound = np.full(len(part), -np.inf)
        bound[full] = v[lead[(np.cumsum(count) - count)[full] + k - 1]]
        keep = v >= bound[r] - margin
        r, f = part[r[keep]], f[keep]
        out.append(_hits(q_ids[r], c_ids[f], (q[r] * c[f]).sum(axis=1)))
    return pd.concat(out)


_HIT = "query_id long, vec_id long, score double"


def nearest(hits: DataFrame, k: int) -> DataFrame:
    """The k best distinct vec_id of each query, with their best scores, however often they occur."""
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def brute_force(queries: list[tuple[int, list[float]]], base: DataFrame, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries: one pass over base, k rows a query and batch."""
    q_ids = np.array([i for i, _ in queries], dtype=np.int64)
    q = np.array([v for _, v in queries])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pandas(block_top(q_ids, q, batch.column(0).to_numpy(), matrix(batch.column(1), dim), k), preserve_index=False)

    return nearest(base.mapInArrow(run, _HIT), k)


@dataclass(frozen=True)
class Index:
    """What search() needs: the hash family, and the score that a cell must have to be probed."""

    family: CrossPolytope
    threshold: float
    #: share of the true neighbours of the sample that are found
    recall: float
    #: share of a sample of rows that a query of the sample examines, rows in several tables counted each time
    examined: float


def fit(base: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.94, tables: int = 8, sample: int = 200, seed: int = 17) -> Index | None:
    """Choose the threshold by measured recall; None if no row takes part.

    base and queries: id and v as valid() gives them. At most `sample` queries (those with the least
    hashed ids), their k true neighbours each, and 5 * sample rows come to the driver.
    """
    sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim = sizes[0]["dim"]
    family = CrossPolytope(dim, tables, seed)
    base = base.filter(F.size("v") == dim)
    least_hashed = lambda df, n: [(r.id, r.v) for r in df.orderBy(F.xxhash64("id"), "id").limit(n).collect()]
    chosen = least_hashed(queries.filter(F.size("v") == dim), sample)
    true = brute_force(chosen, base, dim, k).select("query_id", "vec_id").distinct() if chosen else None
    # sample * k ids at most, of rows that may repeat; the best row of each
    pairs = true.join(base.select(F.col("id").alias("vec_id"), "v"), "vec_id").groupBy("query_id", "vec_id").agg(F.min("v").alias("v")).collect() if chosen else []
    if not pairs:
        return Index(family, -np.inf, 1.0, 1.0)
    at = {i: n for n, (i, _) in enumerate(chosen)}
    q = np.array([v for _, v in chosen])
    who, near = np.array([at[r.query_id] for r in pairs]), np.array([r.v for r in pairs])
    rows = np.array([v for _, v in least_hashed(base, 5 * sample)])
    best, scores = np.full(len(pairs), -np.inf), []
    for t in range(tables):
        parts = [family.scores(q, t, p) for p in range(2)]
        best = np.maximum(best, sum(s[who, family.hashes(near, t, p)] for p, s in enumerate(parts)))
        scores.append(sum(s[:, family.hashes(rows, t, p)] for p, s in enumerate(parts)))
    threshold = float(np.sort(best)[int((1 - target) * len(best))])
    return Index(family, threshold, float((best >= threshold).mean()), float(sum((s >= threshold).mean() for s in scores)))


def search(base: DataFrame, queries: DataFrame, index: Index, k: int = 20, groups: int = 8, block: int | None = None, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates in the cells that it probes.

    base and queries have id and v. The buckets of a table go to `groups` groups, so that a query gets k
    rows from each of few groups whatever the number of buckets. A group of more than `block` rows (None:
    16 MB of vectors) is cut into blocks and its queries into blocks of query_block, so a task holds one
    block of each however crowded a bucket is; every block returns its own k best ids of each
    query. A row's own id is no neighbour; of rows with the same id the best counts; equal rows are
    one; fewer than k candidates give fewer rows; an empty table gives none.
    """
    family, threshold = index.family, index.threshold
    dim, axes = family.dim, 2 * family.width
    together = -(-axes // groups)
    block = block or max(1024, (1 << 21) // dim)

    def hashed(batches):
        for batch in batches:
            v = matrix(batch.column(1), dim)
            for t in range(family.tables if len(v) else 0):
                bucket, cell = family.hashes(v, t, 0), family.hashes(v, t, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, dtype=np.int32)), pa.array(bucket // together), pa.array(bucket * axes + cell), *batch.columns], names=["tab", "grp", "cell", "id", "v"])

    def probed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                v = matrix(part.column(1), dim)
                for t in range(family.tables):
                    # buckets with at least one cell to probe
                    some = family.scores(v, t, 0) + family.scores(v, t, 1).max(axis=1, keepdims=True) >= threshold
                    rows, grp = np.nonzero(np.logical_or.reduceat(some, np.arange(0, axes, together), axis=1))
                    chosen = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(grp), part.column(0).take(chosen), part.column(1).take(chosen)], names=["tab", "grp", "id", "v"])

    fits = F.size("v") == dim
    kind = base.schema["v"].dataType.simpleString()
    stored = base.filter(fits).dropDuplicates(["id", "v"]).mapInArrow(hashed, f"tab int, grp long, cell long, id long, v {kind}")
    asked = queries.filter(fits).dropDuplicates(["id", "v"]).mapInArrow(probed, f"tab int, grp long, id long, v {kind}")
    key = ["tab", "grp"]
    rows = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    asks = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_asks"))
    cut = rows.join(asks, key).select(*key, F.ceil(F.col("n_rows") / block).cast("int").alias("parts"), F.ceil(F.col("n_asks") / query_block).cast("int").alias("q_parts"))
    cut = stage(cut, "ann-buckets")  # at most tables * groups rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = stored.join(cut, key).select(*key, "cell", "id", "v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), every("q_parts").alias("q_part"))
    right = asked.join(cut, key).select(*key, "id", "v", every("parts").alias("part"), F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int").alias("q_part"))
    group = [*key, "part", "q_part"]

    def scored(key, c, q):
        if not len(c) or not len(q):
            return _hits(*(np.zeros(0),) * 3)
        q_vectors, c_vectors = (np.stack(x["v"].to_list()).astype(np.float64) for x in (q, c))
        cells, at = np.unique(c["cell"].to_numpy(), return_inverse=True)
        t = int(key[0])
        looks = family.scores(q_vectors, t, 0)[:, cells // axes] + family.scores(q_vectors, t, 1)[:, cells % axes] >= threshold
        return block_top(q["id"].to_numpy(), q_vectors, c["id"].to_numpy(), c_vectors, k, at, looks)

    hits = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(scored, _HIT)
    return nearest(hits, k)
