"""Language identification with a blended-spectrum string kernel.

A text is lower-cased, and what is no letter becomes one blank. For n = 1..orders its features are which
of its n-grams are present (hashed into `buckets` per order); the kernel of two texts is the mean over n
of shared n-grams / sqrt(present in one * present in the other). Landmarks are drawn from the labelled
rows; the Nystrom map sends a text to kernel values with them times K_mm^(-1/2), and one-versus-rest
ridge regression is fitted there. The map and the regression are linear in the presence vector of each
order up to its norm, so scoring a batch is one matrix product an order: presence x (buckets x languages).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cameras import small
from ..session import stage
from .bpe import LETTER, character_classes
from .vectors import chunks, mix

BLANK = 0x20
_lower: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or blank for what is no letter."""
    global _lower
    if _lower is None:
        letters = character_classes() == LETTER
        table = np.where(letters, np.arange(0x110000), BLANK).astype(np.uint32)
        for p in np.flatnonzero(letters[:0x20000]):
            low = chr(p).lower()
            if len(low) == 1:
                table[p] = ord(low)
        _lower = table
    return _lower


@dataclass(frozen=True)
class Spectrum:
    """Feature space: n-grams of 1..orders characters, hashed into 2**bits buckets per order."""

    orders: int = 3
    bits: int = 15

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def presence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """uint8 array (order, text, bucket), and which texts have a letter."""
        out = np.zeros((self.orders, len(texts), self.buckets), dtype=np.uint8)
        # every text ends with a blank and starts behind one, wherever it stands in the batch
        joined = "".join((t or "") + " " for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        rows = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
        folded = _fold_table()[points]
        blank = folded == BLANK
        keep = ~(blank & np.concatenate(([True], blank[:-1])))
        folded, rows = folded[keep].astype(np.uint64), rows[keep]
        lettered = np.zeros(len(texts), dtype=bool)
        lettered[rows[folded != BLANK]] = True
        gram = np.zeros(len(folded), dtype=np.uint64)
        for n in range(1, self.orders + 1):
            m = len(folded) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * np.uint64(0x100000001B3) + folded[n - 1 :] + np.uint64(1)
            inside = rows[:m] == rows[n - 1 :]
            code = (mix(gram) >> np.uint64(64 - self.bits)).astype(np.int64)
            out[n - 1].reshape(-1)[(rows[:m] * self.buckets + code)[inside]] = 1
        return out, lettered


@dataclass
class LanguageModel:
    spectrum: Spectrum
    languages: list[str]
    #: (order, bucket, language), float32
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        present, lettered = self.spectrum.presence(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for p, w in zip(present, self.weights, strict=True):
            norm = np.sqrt(np.maximum(p.sum(axis=1, dtype=np.int64), 1))
            total += (p.astype(np.float32) @ w) / norm[:, None]
        best = total.argmax(axis=1)
        score = np.clip(total[np.arange(len(texts)), best], 0.0, 1.0)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 256, landmarks: int = 192, ridge: float = 1e-3, spectrum: Spectrum = Spectrum()) -> LanguageModel:
    """Fit on a bounded sample: of each language the `per_language` rows with the least hashed id and text.

    Rows with a null label or text take no part; rows equal in id, label and text are one, and rows that share
    an id otherwise are told apart by a hash of their text. Presence vectors are computed by tasks and come to the
    driver as bits (orders * 2**bits / 8 bytes a row). There are `landmarks` landmarks, and at least one of each
    language. Without any labelled row every text is `und`.
    """
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = rows.select(F.col(id_col).cast("long").alias("sample_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(F.col(text_col)).alias("print"))
    order = [F.xxhash64("sample_id", "print"), F.col("sample_id"), F.col("print")]
    distinct = keyed.select("sample_id", "label", "print").distinct()
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).filter(F.col("rank") <= per_language)
    ranked = stage(ranked.select(F.col("sample_id").alias("own_id"), F.col("label").alias("own_label"), F.col("print").alias("own_print")), "language-sample")

    def features(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 32):
                present, _ = spectrum.presence(texts[a : a + 32])
                bits = np.packbits(present.transpose(1, 0, 2).reshape(present.shape[1], -1), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 32), batch.column(2).slice(a, 32), pa.array([r.tobytes() for r in bits], type=pa.binary())], names=["sample_id", "label", "bits"])

    # at most per_language rows a language, sent to the tasks where their size is bounded
    same = F.col("sample_id").eqNullSafe(F.col("own_id")) & (F.col("label") == F.col("own_label")) & (F.col("print") == F.col("own_print"))
    chosen = keyed.join(small(ranked), same, "left_semi").dropDuplicates(["sample_id", "label", "print"])
    got = chosen.select("sample_id", "text", "label").mapInArrow(features, "sample_id long, label string, bits binary").collect()
    got.sort(key=lambda r: (r.sample_id is None, r.sample_id, r.label, r.bits))
    languages = sorted({r.label for r in got})
    if not got:
        return LanguageModel(spectrum, ["und"], np.zeros((spectrum.orders, spectrum.buckets, 1), dtype=np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in got), dtype=np.uint8).reshape(len(got), -1), axis=1)
    x = x.reshape(len(got), spectrum.orders, spectrum.buckets)
    y = np.array([[r.label == c for c in languages] for r in got], dtype=np.float64)
    # landmarks: the languages in turn, so that each has its share
    nth, met = [], Counter()
    for r in got:
        nth.append(met[r.label])
        met[r.label] += 1
    marks = np.lexsort((np.arange(len(got)), nth))[: min(max(landmarks, len(languages)), len(got))]
    norms = np.sqrt(np.maximum(x.sum(axis=2, dtype=np.int64), 1))
    kernel = np.zeros((len(got), len(marks)))
    for n in range(spectrum.orders):
        one = x[:, n].astype(np.float32)
        kernel += (one @ one[marks].T) / np.outer(norms[:, n], norms[marks, n]) / spectrum.orders
    values, vectors = np.linalg.eigh(kernel[marks] + 1e-6 * np.eye(len(marks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    mapped = kernel @ root
    share = y.sum(axis=0)
    weight = (y / np.maximum(share, 1)).sum(axis=1)  # every language counts the same
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * np.eye(len(marks))
    coefficients = root @ np.linalg.solve(gram, mapped.T @ (y * weight[:, None]))
    weights = np.stack([(x[marks, n].astype(np.float32).T @ (coefficients / norms[marks, n][:, None] / spectrum.orders)).astype(np.float32) for n in range(spectrum.orders)])
    return LanguageModel(spectrum, languages, weights)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, lang_pred and score of every whole text, without a shuffle.

    Null texts and texts without a letter are `und` with score 0. Rows stand for themselves; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # orders * buckets * languages floats

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [], []
            for a, b in chunks(texts, 1 << 20):
                for c in range(a, b, 64):
                    n, s = model.score(texts[c : min(c + 64, b)])
                    names += n
                    scores += s.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    return kept.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
