"""Encoding and decoding of whole texts by byte-level BPE (see bpe.py for the method)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, `ids` array<int> and `decoded`, the text of those ids.

    Equal to the tokenizers library's encode(add_special_tokens=False) and
    decode(skip_special_tokens=False). Null and empty texts give no ids and an empty text; each row
    stands for itself, so repeated rows and null or repeated ids are kept; other columns are not read.
    There is no shuffle: a task holds one Arrow batch at a time.
    """

    def run(batches):
        coder = bpe.load(vocabulary or default_vocabulary())  # each machine has its own place for the file
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in bpe.chunks(texts, 1 << 21):
                ids = coder.encode(texts[a:b])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = pa.array(np.concatenate(ids), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), values), pa.array([coder.decode(x) for x in ids], type=pa.string())],
                    names=["id", "ids", "decoded"],
                )

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of what encode_decode returns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
