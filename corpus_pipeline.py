"""The corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of docs. run() writes each stage as Parquet and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoweave.llm import jaccard, packing, quality, secrets, substrings
from orthoweave.session import discard, stage, staging, table

ORACLE_SQL = None


def _named(row: str, columns: list[str], changed: dict | None = None):
    """Columns out of a struct, some of them replaced."""
    changed = changed or {}
    return [(changed[c] if c in changed else F.col(row)[c]).alias(c) for c in columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "lang", "text")
    # counted once: the cutoffs read the counts alone, the verdict reads them with the rows
    measured = stage(quality.measure(packed, keep=("row", "doc_id", "lang")), "pipeline-measured")
    cutoffs = quality.choose_cutoffs(measured.drop("row"), table(spark, sf_dir, "labels"))
    return quality.judge(measured, cutoffs).filter("kept").select(*_named("row", docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each class of near duplicates; rows without an id stay.

    Rows that share an id but hold different texts are told apart by their texts.
    """
    least = jaccard.first_of_each(docs).select(F.col("doc").alias("kept_id"), F.col("key").alias("kept_key"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), jaccard.text_key(F.col("text")).alias("own_key"))
    chosen = packed.join(least, (F.col("own_id") == F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")), "left_semi").groupBy("own_id", "own_key").agg(F.first("row").alias("row"))
    return chosen.select("row").unionByName(packed.filter("own_id is null").select("row")).select(*_named("row", docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; texts without such a passage stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    parsed = substrings.remove_repeats(docs, carry=tuple(others), verbatim=True)  # the text travels once
    text = F.col("kept")
    changed = {"n_chars": F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in others else {}
    columns = dict(zip(others, _named("row", others, changed), strict=True)) | {"text": text.alias("text")}
    return parsed.select(*(columns[c] for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the secrets found in them masked."""
    masked = secrets.redact(docs, secrets.scan(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    Once a stage is written, the tables it was made from are deleted.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with staging() as made:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
