"""The pipeline, stage by stage and as a whole."""

import itertools
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from test_llm_operators import brute_classes, brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from orthoweave.llm import sql, tokens
from orthoweave.session import shared_folder, stage

DATA = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs, before = documents, documents.count()
    seen = {}
    for name, step in pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, DATA), "test-stage")
        assert docs.columns == documents.columns
        seen[name] = docs.count()
        assert seen[name] <= before
        before = seen[name]
    assert seen["quality_rules"] < documents.count() and seen["ngram_jaccard_join"] < seen["quality_rules"]
    packed = pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


LARGER = "/root/testdata/sf0.01"


def brute_pipeline(documents):
    """The pipeline in plain Python and SQL: texts by id after the first four stages."""
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"create view {name} as select * from '{LARGER}/{name}.parquet'")
    found = duck.execute(sql.ORACLES["op9_quality_rules"])
    names = [d[0] for d in found.description]
    good = {r[names.index("doc_id")] for r in found.fetchall() if r[names.index("kept")]}
    texts = [(r.doc_id, r.text) for r in sorted(documents.collect(), key=lambda r: r.doc_id) if r.doc_id in good]
    first = {i for i, least, _ in brute_classes(texts) if i == least}
    texts = [(i, t) for i, t in texts if i in first]
    cut = {i: kept if n_removed else dict(texts)[i] for i, _, n_removed, kept in brute_repeats(texts)}
    return {i: re.sub(r"\b[0-9a-fA-F]{40}\b", "[SECRET]", t) for i, t in cut.items()}


def test_pipeline_against_brute_force(spark):
    documents = spark.read.parquet(f"{LARGER}/documents.parquet")
    library = Tokenizer.from_file(tokens.default_vocabulary())
    want = brute_pipeline(documents)
    assert len(want) < documents.count() and any("[SECRET]" in t for t in want.values())
    pieces = {}
    for i, t in want.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 2048)])):
            pieces[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    packed = pipeline.run(spark, LARGER).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == pieces and len(packed) == len(pieces)
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert len(held) <= -(-sum(n for _, n, _ in pieces.values()) // 2048) * 1.02 + 1


def test_one_of_each_class_stays(spark, documents):
    from orthoweave.llm.jaccard import join_similar

    kept = {r.doc_id for r in pipeline.keep_one_of_each(spark, documents, DATA).collect()}
    assert kept == {r.class_id for r in join_similar(documents).select("class_id").distinct().collect()} and len(kept) < documents.count()


def test_stages_leave_one_table_each(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    pipeline.run(spark, DATA)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    # the output of the stage before the last, and what the last stage reads
    assert "pipeline-secret_scans" in left
    assert not any(name.startswith(("pipeline-quality", "pipeline-measured", "pipeline-ngram", "pipeline-substring", "substring", "jaccard", "quality")) for name in left)


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in "abc"]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 2), (1, texts[1], "en", "s", 2), (2, texts[1] + " end", "en", "s", 3), (2, texts[2], "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_one_of_each(spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2])])


def test_odd_and_empty_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        rows = docs
        for _, step in pipeline.STAGES[:-1]:
            rows = stage(step(spark, rows, DATA), "test-stage")
            assert rows.columns == docs.columns
        left = Counter((r.doc_id, r.text or "") for r in rows.collect())
        packed = pipeline.STAGES[-1][1](spark, rows, DATA).collect()
        # every row gives its pieces; the same words give the same digests
        assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in left.elements())
        if docs is odd_documents:
            assert {i for i, _ in left} == {1, None}
