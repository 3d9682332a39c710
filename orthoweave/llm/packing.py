"""Hierarchical residual packing of token pieces into sequences.

Pieces are dealt evenly over partitions, and every partition packs its pieces best-fit, longest first.
Nearly full bins are final. The emptiest of the others go up a tree: the bins of some partitions meet
in one task and are packed again by best fit, each bin now an item as long as its fill, until one
group is left. Only the places of bins travel in the tree (a few an input partition); the pieces of a
bin that has moved learn its new place by one join at the end.

How many bins must go up. After best fit, longest first, at most one bin of a task is filled to half or
less: when the later of two such bins was opened, its first piece would have fitted the earlier one.
Items of more than half never share a bin, so a merge needs an item of half or less, and a node gets at
most `fan_in` of these, one a child. With L levels above a node, at most fan_in * L of its fuller bins can
therefore ever take a partner, and if any of its bins can take one, so can an emptier one in its place.
Handing up the bin of half or less and the fan_in * L emptiest others thus leaves the least number of
sequences as it is; all other bins become sequences as they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cameras import small
from ..session import stage
from . import bpe
from .tokens import default_vocabulary

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECE + ", grp long, bin long, offset long, fill long, emptier long"
_ITEM = "grp long, bin long, into long, shift long, fill long, emptier long"
_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents, cut only where longer than `capacity`: one row a piece.

    A document is its ids and then end_id; a null text counts as empty, so that every row gives a
    piece. If a document is cut, its first piece takes the remainder and all others are full.
    with_ids adds the ids themselves.
    """
    schema = _PIECE + (", ids array<int>" if with_ids else "")

    def run(batches):
        coder = bpe.load(vocabulary or default_vocabulary())
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in bpe.chunks(texts, 1 << 21):
                rows, held = [], []
                for name, ids in zip(names[a:b], coder.encode(texts[a:b]), strict=True):
                    ids = np.concatenate((ids.astype("<u4"), tail))
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = ids[i:j]
                        rows.append((name, k, i, j - i, zlib.crc32(part.tobytes())))
                        if with_ids:
                            held.append(part.astype(np.int32))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    arrays.append(pa.array(held, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*_FIELDS, *(["ids"] if with_ids else [])])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, schema)


def best_fit(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths that do not increase: each item goes to the fullest bin that still takes it.

    Returns the bin and the offset of each item, and the fill of each bin. Bins are kept by what is
    left in them; a bit mask over the residuals finds the least one that is large enough, so an item
    costs the same however many bins are open.
    """
    sizes = np.asarray(lengths, dtype=np.int64).tolist()
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    bin_of, offset_of, fills = [], [], []
    for size in sizes:
        fits = mask >> size
        if fits:
            residual = size + (fits & -fits).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                mask ^= 1 << residual
        else:
            residual, b = capacity, bins
            bins += 1
            fills.append(0)
        bin_of.append(b)
        offset_of.append(capacity - residual)
        residual -= size
        fills[b] = capacity - residual
        if residual:
            by_residual[residual].append(b)
            mask |= 1 << residual
    return np.array(bin_of, dtype=np.int64), np.array(offset_of, dtype=np.int64), np.array(fills, dtype=np.int64)


def _emptier(fills: np.ndarray, done: int, capacity: int) -> np.ndarray:
    """For each bin how many emptier ones of more than half must go up before it: -1 for half or less, none if nearly full."""
    out = np.full(len(fills), np.iinfo(np.int64).max)
    out[2 * fills <= capacity] = -1
    others = np.flatnonzero((2 * fills > capacity) & (fills < done))
    out[others[np.argsort(fills[others], kind="stable")]] = np.arange(len(others))
    return out


def pack(items: DataFrame, capacity: int = 2048, nearly_full: float = 0.995, fan_in: int = 8, rows_per_task: int = 1 << 17, hand_up: int | None = None) -> DataFrame:
    """Assign the rows of pieces() to sequences; adds sequence_id and offset.

    Pieces are dealt round and round over tasks of about rows_per_task, whatever their order or
    length, so every task sees the same mix. A bin filled to nearly_full is final at once. hand_up:
    bins of more than half that a task hands up; None: fan_in for each level above it, which is
    always enough (see above). No piece is lost, and a task of the tree holds at most
    fan_in * (1 + fan_in * levels) bins however large the input. Equal pieces are
    ordered by their columns, so a repeated task gives the same bins. An empty table gives none.
    """
    done = int(nearly_full * capacity)

    def locally(batches):
        table = pa.Table.from_batches(list(batches), schema=pieces_schema)
        if not table.num_rows:
            return
        columns = [table.column(i).combine_chunks() for i in range(5)]
        keys = [c.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
        order = np.lexsort((keys[4], keys[2], keys[1], keys[0], columns[0].is_null().to_numpy(zero_copy_only=False), -keys[3]))
        bins, offsets, fills = best_fit(keys[3][order], capacity)
        grp = TaskContext.get().partitionId()
        whole = pa.Table.from_arrays([
            *(c.take(pa.array(order)) for c in columns), pa.array(np.full(len(order), grp)), pa.array((grp << 32) + bins), pa.array(offsets), pa.array(fills[bins]), pa.array(_emptier(fills, done, capacity)[bins]),
        ], names=names)
        yield from whole.to_batches(1 << 14)

    def again(key, frame):
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        own = frame["bin"].to_numpy()
        bins, shift, fills = best_fit(frame["fill"], capacity)
        first = np.unique(bins, return_index=True)[1]  # a bin keeps the name of its longest item
        return pd.DataFrame({"grp": int(key[0]), "bin": own, "into": own[first][bins], "shift": shift, "fill": fills[bins], "emptier": _emptier(fills, done, capacity)[bins]})

    pieces_schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    names = [*_FIELDS, "grp", "bin", "offset", "fill", "emptier"]
    tasks = max(1, -(-items.count() // rows_per_task))
    packed = stage(items.select(_FIELDS).repartition(tasks).mapInArrow(locally, _PACKED), "packing-bins")
    groups = (packed.agg(F.max("grp")).first()[0] or 0) + 1
    levels = 1
    while fan_in**levels < groups:
        levels += 1
    level = packed.filter("offset = 0").select("grp", "bin", "fill", "emptier")
    moved = None  # bin, into, shift of all bins that are now inside another one
    for above in range(levels, 0, -1):
        up = level.filter(F.col("emptier") < (fan_in * above if hand_up is None else hand_up)).withColumn("up", F.floor(F.col("grp") / fan_in))
        merged = stage(up.groupBy("up").applyInPandas(again, _ITEM), "packing-level")
        step = merged.filter("shift > 0").select("bin", "into", "shift")
        if moved is not None:  # what was inside a bin goes with it
            inner = moved.alias("a").join(step.alias("b"), F.col("a.into") == F.col("b.bin"), "left")
            step = step.unionByName(inner.select("a.bin", F.coalesce("b.into", "a.into").alias("into"), (F.col("a.shift") + F.coalesce("b.shift", F.lit(0))).alias("shift")))
        moved = stage(step, "packing-moved")
        level = merged.filter("shift = 0").select("grp", "bin", "fill", "emptier")
    # fewer rows than fan_in for each input partition
    placed = packed.join(small(moved.withColumnRenamed("bin", "old")), F.col("bin") == F.col("old"), "left")
    return placed.select(*_FIELDS, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack: the pieces are staged, so that texts are tokenised once."""
    return pack(stage(pieces(docs, vocabulary, capacity), "packing-pieces"), capacity)
