"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, table
from . import ann, jaccard, language, packing, quality, rounds, secrets, spelling, substrings, tokens, toxicity, warc, whitening


def split_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every row of `pages`, two a page; a null html is an empty page. Repeated pages come out each."""
    made = warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")), keep=("page_id",))
    source = F.col("headers")
    return made.select(
        "page_id", "record_id", "type", "target_uri", "refers_to", "content_type", source["WARC-Refers-To-Payload-Digest"].alias("source_payload_digest"),
        source["WARC-Refers-To-Block-Digest"].alias("source_block_digest"), "block", "block_digest",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every whole text of `documents`; lexicon and calibration from labelled rows outside the held-out fifth. Null and empty texts are scored as texts without a word."""
    docs = table(spark, sf_dir, "documents")
    labels = toxicity.sample_labels(table(spark, sf_dir, "labels").filter(split_of("doc_id", 5) != 0))
    # ids and labels of a sample of fixed size, sent to the texts
    labelled = stage(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"), "toxicity-labelled")
    scored = toxicity.score(docs, toxicity.learn(labelled))
    return scored.select("doc_id", (split_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, how many go because their window starts earlier, and the digest of the rest. Rows that share an id or have none come out each."""
    parsed = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; a null text has the separator alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class of near duplicates and the number of its links. Rows that share an id are told apart by their texts."""
    return jaccard.join_similar(table(spark, sf_dir, "documents"))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of `documents`, and of the text decoded from its ids; null counts as empty."""
    return tokens.digests(tokens.encode_decode(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every whole text with the forest's probability and verdict. Documents without a candidate have no row."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", F.length("value").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every whole text; `und` for a null text or one without a letter."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(split_of("doc_id", 4) != 2))
    return language.predict(docs, model)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text; a null text has no words and fails the base rule."""
    measured = stage(quality.measure(table(spark, sf_dir, "documents")), "quality-measured")
    cutoffs = quality.choose_cutoffs(measured, table(spark, sf_dir, "labels"))
    judged = quality.judge(measured, cutoffs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id is divisible by 20. Without a usable vector the result is empty."""
    base = ann.valid(table(spark, sf_dir, "embeddings"))
    queries = base.filter(F.col("id") % 20 == 0)
    index = ann.fit(base, queries)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.search(base, queries, index)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary of `documents`, its near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_round_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of `documents`, and of the bytes decoded from its ids."""
    return rounds.digests(rounds.encode_decode(table(spark, sf_dir, "documents")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened rows of `embeddings`, one row a component; deviation is null where it exceeds a long."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return made.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_derivatives, op2_toxicity, op3_substring_dedup, op4_best_fit_packing, op5_ngram_jaccard_join, op6_bpe_encode_decode, op7_secret_scan, op8_language_id, op9_quality_rules, op10_cross_polytope_ann, op11_spelling_variants, op12_round_bpe, op13_embedding_whitening)}
