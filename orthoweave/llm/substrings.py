"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, each passage where it occurs first. It is indexed by anchors: of
the n-grams in a window of `width` words the one with the least hash is the window's anchor, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor make a segment. The
index is cut into blocks by segment hash and holds every distinct segment once, at its first
occurrence, so a place of a document has one longest match in it:

* seeds: a segment that occurs earlier as a whole is matched with its first occurrence;
* boundaries: where a segment has no match as a whole but its anchor occurs in other segments, a match
  begins or ends inside it; its windows are looked up one by one;
* parse: seeds and windows that go on in the same source grow into matches as long as they go, and
  each document is factored greedily: of the matches that cover the next repeated window the one that
  reaches farthest becomes a factor, and the parse steps past it (parse()).

Lookups sort a block and stream through it, holding one row. Before a row is sent, a task matches its own
equal segments with the first of them, so a passage that all documents share reaches its block about once a
task; such a match names that earlier place of the task as its source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cameras import small
from ..session import stage
from .vectors import Texts, mix, span_hashes

_NONE = 2**63 - 1
_FACT = "kind int, route long, e long, e2 int, doc long, start int, n int, src_doc long, src_start int, fp long"
_NAMES = [f.split()[0] for f in _FACT.split(", ")]
SETTLED, INDEXED, FIRST = 0, 1, 2


def _batch(**columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "e2": pa.int32(), "start": pa.int32(), "n": pa.int32(), "src_start": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=kinds.get(k, pa.int64())) for k in _NAMES], names=_NAMES)


class _Seen:
    """Passages that a task has met more than once, with a place of each; emptied when full (results do not depend on it)."""

    def __init__(self, limit: int = 1 << 16):
        self.limit = limit
        self.e = self.e2 = self.doc = self.start = np.zeros(0, dtype=np.int64)

    def sources(self, e, e2, doc, start):
        """For each passage whether it is known from an earlier place, and that place."""
        if not len(self.e):
            return np.zeros(len(e), dtype=bool), doc, start
        at = np.minimum(np.searchsorted(self.e, e), len(self.e) - 1)
        known = (self.e[at] == e) & (self.e2[at] == e2) & ((self.doc[at] < doc) | ((self.doc[at] == doc) & (self.start[at] < start)))
        return known, self.doc[at], self.start[at]

    def note(self, e, e2, doc, start):
        """Keep these; of two with one hash the one with the earlier place."""
        if len(self.e) + len(e) > self.limit:
            self.__init__(self.limit)
        e, e2, doc, start = (np.concatenate(x) for x in ((self.e, e), (self.e2, e2), (self.doc, doc), (self.start, start)))
        order = np.lexsort((start, doc, e))
        order = order[np.concatenate(([True], e[order][1:] != e[order][:-1]))[: len(order)]]
        self.e, self.e2, self.doc, self.start = e[order], e2[order], doc[order], start[order]


def _first_in_batch(seen: _Seen, route, e, e2, doc, start, n, fp):
    """Rows of a batch in (doc, start) order: the first of equal rows is INDEXED, the others are SETTLED as its copies."""
    order = np.argsort(e, kind="stable")
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (e[order][1:] == e[order][:-1]) & (e2[order][1:] == e2[order][:-1])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    rows, source = order[same], lead[same]
    earlier = (doc[source] != doc[rows]) | (start[source] != start[rows])
    rows, source = rows[earlier], source[earlier]
    firsts = np.sort(order[~same])
    known, src_doc, src_start = seen.sources(e[firsts], e2[firsts], doc[firsts], start[firsts])
    settled = np.concatenate((rows, firsts[known]))
    if len(settled):
        spread = mix(doc[settled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[settled].astype(np.uint64)).view(np.int64)
        zero = np.zeros(len(settled), dtype=np.int64)
        yield _batch(
            kind=np.full(len(settled), SETTLED), route=zero, e=spread, e2=zero, doc=doc[settled], start=start[settled], n=n[settled],
            src_doc=np.concatenate((doc[source], src_doc[known])), src_start=np.concatenate((start[source], src_start[known])), fp=fp[settled],
        )
    indexed = firsts[~known]
    if len(indexed):
        zero = np.zeros(len(indexed), dtype=np.int64)
        yield _batch(kind=np.full(len(indexed), INDEXED), route=route[indexed], e=e[indexed], e2=e2[indexed], doc=doc[indexed], start=start[indexed], n=n[indexed], src_doc=zero, src_start=zero, fp=fp[indexed])
    repeated = np.unique(source)
    seen.note(e[repeated], e2[repeated], doc[repeated], start[repeated])


def _sorted_texts(batches, limit: int = 1 << 20):
    """(ids, texts, fingerprints, extra) of about `limit` characters, in the order of ids; null ids come last."""
    for batch in batches:
        ids = np.array([_NONE if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
        texts = batch.column(1).to_pylist()
        prints = batch.column(2).to_numpy(zero_copy_only=False)
        extra = batch.column(3).to_pylist() if batch.num_columns > 3 else None
        order = np.argsort(ids, kind="stable")
        a, total = 0, 0
        for b, i in enumerate(order.tolist()):
            size = len(texts[i] or "") + 1
            if total and total + size > limit:
                part = order[a:b]
                yield ids[part], [texts[k] for k in part], prints[part], extra and [extra[k] for k in part]
                a, total = b, 0
            total += size
        if a < len(order):
            part = order[a:]
            yield ids[part], [texts[k] for k in part], prints[part], extra and [extra[k] for k in part]


def _segments(words: Texts, width: int, gram: int):
    """First window, number of windows, and text of each segment of a batch, in order of place."""
    total = len(words.starts)
    if total < width:
        return None
    owner = np.searchsorted(words.first[1:], np.arange(total), side="right")
    grams = words.windows(gram)
    windows = total - width + 1
    ahead = np.lib.stride_tricks.sliding_window_view(grams, width - gram + 1)[:windows]
    anchor = np.arange(windows) + ahead.argmin(axis=1)
    inside = owner[:windows] == owner[width - 1 :]
    new = np.ones(windows, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:windows] != owner[: windows - 1]) | ~inside[:-1]
    at = np.flatnonzero(new & inside)
    if not len(at):
        return None
    # a segment ends before the next one, or where windows leave their text
    stop = np.append(np.flatnonzero(new)[1:], windows)
    last = stop[np.searchsorted(np.flatnonzero(new), at)]
    text = owner[at]
    last = np.minimum(last, words.first[text + 1] - width + 1)
    return at, last - at, text, grams[anchor[at]]


def _index_rows(width: int, gram: int):
    def run(batches):
        seen = _Seen()
        for ids, texts, prints, _ in _sorted_texts(batches):
            words = Texts(texts, 2)
            found = _segments(words, width, gram)
            if found is None:
                continue
            at, n, text, anchors = found
            ends = at + n + width - 1
            e = span_hashes(words.hashes[0], at, ends).view(np.int64)
            e2 = (span_hashes(words.hashes[1], at, ends, 1) >> np.uint64(33)).astype(np.int64)
            yield from _first_in_batch(seen, anchors.view(np.int64), e, e2, ids[text], at - words.first[text], n, prints[text])

    return run


def _window_rows(width: int):
    """Windows of the segments (start, n) that come with each text."""

    def run(batches):
        seen = _Seen()
        for ids, texts, prints, wanted in _sorted_texts(batches):
            words = Texts(texts, 2)
            n = np.array([w["n"] for part in wanted for w in part], dtype=np.int64)
            start = np.array([w["start"] for part in wanted for w in part], dtype=np.int64)
            text = np.repeat(np.arange(len(texts)), [len(p) for p in wanted])
            place = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.repeat(text, n)
            order = np.lexsort((place, text))
            place, text = place[order], text[order]
            at = place + words.first[text]
            e = span_hashes(words.hashes[0], at, at + width)
            e2 = (span_hashes(words.hashes[1], at, at + width, 1) >> np.uint64(33)).astype(np.int64)
            yield from _first_in_batch(seen, np.zeros(len(at), dtype=np.int64), e.view(np.int64), e2, ids[text], place, np.ones(len(at), dtype=np.int64), prints[text])

    return run


def _look_up(with_firsts: bool):
    """Streams rows sorted by (kind, e, e2, doc, start): the first of equal rows is the source of the others.

    with_firsts: the first rows come out too, as FIRST.
    """

    def run(batches):
        lead = None  # key and place of the current source
        for batch in batches:
            cols = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(_NAMES)}
            settled = cols["kind"] == SETTLED
            if settled.any():
                yield batch.filter(pa.array(settled))
            c = {k: v[~settled] for k, v in cols.items()}
            rows = len(c["doc"])
            if not rows:
                continue
            new = np.ones(rows, dtype=bool)
            new[1:] = (c["e"][1:] != c["e"][:-1]) | (c["e2"][1:] != c["e2"][:-1])
            new[0] = lead is None or lead[:2] != (c["e"][0], c["e2"][0])
            firsts = np.flatnonzero(new)
            at = np.cumsum(new) - 1  # -1: still the source of an earlier batch
            if len(firsts):
                src_doc, src_start = c["doc"][firsts][at], c["start"][firsts][at]
            else:
                src_doc, src_start = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            if lead is not None:
                src_doc, src_start = np.where(at < 0, lead[2], src_doc), np.where(at < 0, lead[3], src_start)
            copy = ~new & ((src_doc != c["doc"]) | (src_start != c["start"]))
            if copy.any():
                zero = np.zeros(int(copy.sum()), dtype=np.int64)
                yield _batch(kind=zero + SETTLED, route=zero, e=zero, e2=zero, doc=c["doc"][copy], start=c["start"][copy], n=c["n"][copy], src_doc=src_doc[copy], src_start=src_start[copy], fp=c["fp"][copy])
            if len(firsts):
                i = firsts[-1]
                lead = (c["e"][i], c["e2"][i], c["doc"][i], c["start"][i])
            if with_firsts and len(firsts):
                zero = np.zeros(len(firsts), dtype=np.int64)
                yield _batch(kind=zero + FIRST, route=c["route"][firsts], e=zero, e2=zero, doc=c["doc"][firsts], start=c["start"][firsts], n=c["n"][firsts], src_doc=zero, src_start=zero, fp=c["fp"][firsts])

    return run


def _looked_up(rows: DataFrame, with_firsts: bool) -> DataFrame:
    dealt = rows.repartition("e").sortWithinPartitions("kind", "e", "e2", "doc", "start")
    return dealt.mapInArrow(_look_up(with_firsts), _FACT)


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("src_doc", T.LongType()), T.StructField("src_start", T.IntegerType())])
_RESULT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN))])


def parse(start: np.ndarray, n: np.ndarray, src_doc: np.ndarray, src_start: np.ndarray, width: int):
    """Greedy factors of one document, from its matches of n windows each: start, length in words, source.

    Matches that go on in the same source are one match. The next factor is, of the matches that hold the
    next window that no factor covers, the one that reaches farthest; where there is none the parse goes
    on at the next match. Every matched window lies in a factor.
    """
    order = np.lexsort((-n, start))
    start, n, src_doc, src_start = start[order], n[order], src_doc[order], src_start[order]
    chains: dict[tuple[int, int], int] = {}  # (source, shift) -> its last match
    first, last, source = [], [], []
    for a, k, d, c in zip(start.tolist(), n.tolist(), src_doc.tolist(), src_start.tolist(), strict=True):
        i = chains.get((d, c - a))
        if i is not None and a <= last[i]:
            last[i] = max(last[i], a + k)
        else:
            chains[d, c - a] = len(first)
            first.append(a)
            last.append(a + k)
            source.append((d, c))
    factors, at, i = [], -1, 0  # windows before `at` are done
    while i < len(first):
        at = max(at, first[i])
        best = None
        while i < len(first) and first[i] <= at:
            if last[i] > at and (best is None or last[i] > last[best]):
                best = i
            i += 1
        if best is not None:
            factors.append(best)
            at = last[best]  # no match passed over reaches farther
    spans = np.array([(first[i], last[i] - first[i] + width - 1, *source[i]) for i in factors], dtype=np.int64).reshape(-1, 4)
    return spans[:, 0], spans[:, 1], spans[:, 2], spans[:, 3]


def _remove(width: int, verbatim: bool):
    def run(batches):
        for batch in batches:
            docs, spans_in = batch.column(0), batch.column(2).to_pylist()
            texts = batch.column(1).to_pylist()
            n_words, n_removed, kept, spans = [], [], [], []
            for text, facts in zip(texts, spans_in, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if not facts:
                    n_removed.append(0)
                    kept.append(text if verbatim else b" ".join(words).decode("utf-8", "replace"))
                    spans.append([])
                    continue
                start, n, src_doc, src_start = (np.array([f[k] for f in facts], dtype=np.int64) for k in ("start", "n", "src_doc", "src_start"))
                start, length, src_doc, src_start = parse(start, n, src_doc, src_start, width)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace"))
                spans.append([dict(start=a, length=b, src_doc=None if c == _NONE else c, src_start=d) for a, b, c, d in zip(start.tolist(), length.tolist(), src_doc.tolist(), src_start.tolist(), strict=True)])
            fields = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("src_doc", pa.int64()), ("src_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([docs, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, fields), *batch.columns[3:]], names=["doc", "n_words", "n_removed", "kept", "spans", *batch.schema.names[3:]])

    return run


def _told_apart(texts: DataFrame) -> DataFrame:
    """texts(doc, text, ...) with fp, which differs between rows with one doc and different texts (by their 128-bit digests).

    fp is a 32-bit hash of the text; of texts with one doc and one hash each gets a number of its own on top. Those
    are few: they are found from digests alone, and are sent to the rows where their size is bounded.
    """
    hashed = F.hash("text").cast("long")
    digests = texts.select("doc", hashed.alias("h"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    clashes = digests.groupBy("doc", "h").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc", "h")
    clashes = stage(clashes, "substring-clashes")
    if clashes.isEmpty():
        return texts.withColumn("fp", hashed)
    each = digests.join(small(clashes), ["doc", "h"], "left_semi").distinct()
    number = F.row_number().over(Window.partitionBy("doc", "h").orderBy("digest"))
    each = stage(each.withColumn("number", number), "substring-numbers").withColumnsRenamed({"doc": "doc_", "h": "h_"})
    same = (F.col("doc") == F.col("doc_")) & (hashed == F.col("h_")) & (F.coalesce(F.md5("text"), F.lit("")) == F.col("digest"))
    return texts.join(small(each), same, "left").withColumn("fp", hashed + F.coalesce(F.col("number").cast("long") * (1 << 32), F.lit(0))).drop("doc_", "h_", "digest", "number")


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept, spans: every document without the words of repeated windows.

    Words are runs of characters other than ASCII white space. A window of `width` words is repeated if
    its words also start earlier: in a document with a smaller id, or earlier in the same one; all its
    words go. kept: the other words joined by blanks. spans: the factors of parse() (first word, number
    of words, source document and word there); neighbours may overlap by words, never by all windows.

    Null texts have no words. Rows with one id count as one document each in the same place: a row
    does not make its own repetition repeated; they are told apart by 128-bit digests of their texts. Null ids come after all others and count as one id.
    Windows are compared by hashes of 64 and 31 bits (61 and 31 of them independent). Texts shorter than a window are kept as they are.
    carry: columns of docs that come along unchanged, in a struct column `row`; the text need not be one of
    them. verbatim: kept is the text as it was, null or not, where no word goes.
    """
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc"), F.col(text_col).cast("string").alias("text")
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    texts = _told_apart(docs.select(doc, text, *row))
    # both joins below read this one exchange of the texts
    dealt = texts.repartition("doc", "fp")
    rest = ["row"] if carry else []
    facts = stage(_looked_up(texts.select("doc", "text", "fp").mapInArrow(_index_rows(width, gram), _FACT), True), "substring-seeds")
    # anchors of two or more different segments: a match may begin or end inside these
    firsts = facts.filter(F.col("kind") == FIRST).select("route", "doc", "start", "n", "fp")
    shared = stage(firsts.groupBy("route").agg(F.count(F.lit(1)).alias("segments")).filter("segments > 1").select("route"), "substring-anchors")
    needs = firsts.join(small(shared), "route", "left_semi").groupBy("doc", "fp").agg(F.collect_set(F.struct("start", "n")).alias("wanted"))
    windows = dealt.join(needs, ["doc", "fp"]).select("doc", "text", "fp", "wanted", *rest).mapInArrow(_window_rows(width), _FACT)
    factors = facts.filter(F.col("kind") == SETTLED).unionByName(_looked_up(windows, False))
    by_doc = factors.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_start")).alias("facts"))
    joined = dealt.join(by_doc, ["doc", "fp"], "left").select("doc", "text", "facts", *rest)
    schema = T.StructType([*_RESULT.fields, *(f for f in joined.schema.fields if f.name == "row")])
    done = joined.mapInArrow(_remove(width, verbatim), schema)
    return done.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias(id_col), "n_words", "n_removed", "kept", "spans", *rest)
