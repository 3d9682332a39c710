"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded first: homoglyphs to Latin letters, accents dropped, digits and signs that stand for
letters inside words replaced, what is no letter turned into one blank. Runs of digits and signs without
any letter are numbers and prices, and no words. The lexicon is learned: words
whose share of toxic labelled documents is far above their share of the others, with the log ratio as
weight. Words beside a lexicon word make an exception phrase where the two together are no sign of
toxicity. The score of a document is a logistic function of its matched weight per length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cameras import small
from ..session import stage
from .bpe import LETTER, character_classes

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
# l and i look alike to the substitutions of 1, so both fold to i.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ꞵ": "b",
}
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
SAME = {"l": "i"}

_table: tuple[np.ndarray, np.ndarray] | None = None
_BLANK = 0x20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> folded letter (0: drop, blank: no letter); code point -> letter it substitutes (0: none)."""
    global _table
    if _table is None:
        letters = character_classes() == LETTER
        fold = np.where(letters, np.arange(0x110000), _BLANK).astype(np.uint32)
        ranges = [*range(0x3000), *range(0xA640, 0xAB70), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]
        for p in ranges:
            c = chr(p)
            if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
                fold[p] = 0  # accents, and characters without width
                continue
            base = unicodedata.normalize("NFKD", c)[:1].lower()[:1]
            base = HOMOGLYPHS.get(base, base)
            base = SAME.get(base, base)
            if base.isalpha():
                fold[p] = ord(base)
        stand = np.zeros(0x110000, dtype=np.uint32)
        for k, v in SUBSTITUTES.items():
            stand[ord(k)] = ord(SAME.get(v, v))
        _table = fold, stand
    return _table


def fold(text: str | None) -> str:
    """Folded words joined by one blank, with a blank at both ends; null gives one blank."""
    if not text:
        return " "
    to, stand = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = to[points]
    if not folded.all():
        points, folded = points[folded != 0], folded[folded != 0]
    spare = np.flatnonzero(stand[points])
    if len(spare):
        letter = folded != _BLANK
        gaps = np.concatenate(([-1], np.flatnonzero(~letter & (stand[points] == 0)), [len(points)]))
        letters = np.flatnonzero(letter)
        firm = np.flatnonzero(letter | ((points >= 0x30) & (points <= 0x39)))
        after = np.searchsorted(gaps, spare)
        start, end = gaps[after - 1], gaps[after]
        # a run of letters and substitutes is a word if it holds a letter; signs at its end are punctuation
        word = np.searchsorted(letters, end) > np.searchsorted(letters, start)
        spare = spare[word & (np.searchsorted(firm, end) > np.searchsorted(firm, spare))]
        folded[spare] = stand[points[spare]]
    blank = folded == _BLANK
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    return f" {folded[keep].tobytes().decode('utf-32-le', 'replace').rstrip(' ')} "


@dataclass
class ToxicityModel:
    """lexicon: folded word -> weight; exceptions: folded two-word phrases in which a match does not count."""

    lexicon: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    slope: float = 1.0
    offset: float = -1.0
    #: added to the length, so that one word in a short text is no certainty
    smoothing: float = 40.0

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, weight in self.lexicon.items():
            machine.add_word(f" {word} ", (len(word) + 2, weight))
        machine.make_automaton()
        return machine if self.lexicon else None

    def feature(self, folded: str, machine) -> float:
        """Matched weight per length, on a logarithmic scale."""
        total = 0.0
        if machine is not None:
            for end, (width, weight) in machine.iter(folded):
                if self.exceptions and any(p in self.exceptions for p in around(folded, end - width + 1, end)):
                    continue
                total += weight
        words = folded.count(" ") - 1
        return math.log1p(100.0 * total / (max(words, 0) + self.smoothing))

    def score(self, feature: float) -> float:
        z = self.slope * feature + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def around(folded: str, start: int, end: int) -> list[str]:
    """The match with the word before it, and with the word after it; start and end are its blanks."""
    out = []
    if start > 0:
        out.append(folded[folded.rfind(" ", 0, start) + 1 : end])
    if end + 1 < len(folded):
        out.append(folded[start + 1 : folded.find(" ", end + 1)])
    return out


def _counted(rows: DataFrame, make) -> DataFrame:
    """Sum over all rows of what make(folded) gives, by label: columns key, bad, good."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(make(fold(text)))
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array([counts[1][k] for k in keys], type=pa.int64()), pa.array([counts[0][k] for k in keys], type=pa.int64())], names=["key", "bad", "good"])

    return rows.mapInArrow(run, "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


_word = re.compile(r"[^ ]+")


def sample_labels(labels: DataFrame, rows: int = 60_000) -> DataFrame:
    """doc_id and toxic of about `rows` labelled documents (all, if fewer), chosen by a hash of the id.

    A document with several labels has the greatest; null ids and labels take no part.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = one.count()
    return one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total))) < rows)


def learn(labelled: DataFrame, least_ratio: float = 8.0, least_documents: int = 3, lexicon_words: int = 20_000, calibration_rows: int = 20_000) -> ToxicityModel:
    """Learn from columns doc_id, text, toxic (rows with a null label or text take no part).

    Word and phrase counts cover all labelled rows. lexicon_words bounds what is sent to the tasks (the
    words with the most evidence stay); the two numbers of the logistic function are fitted on about
    calibration_rows rows, chosen by a hash of the id. Without toxic rows nothing is toxic.
    """
    rows = labelled.filter(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # copies of a text are one piece of evidence
    firsts = rows.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.min("doc_id").alias("first_id")).select("first_id").distinct()
    rows = rows.join(small(stage(firsts, "toxicity-texts")), F.col("doc_id") == F.col("first_id"), "left_semi")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n_bad, n_good = sizes.bad, sizes.n - sizes.bad
    if not n_bad:
        return ToxicityModel({})
    texts = rows.select("text", "toxic")
    counts = stage(_counted(texts, lambda f: set(_word.findall(f))).filter(F.col("bad") >= least_documents), "toxicity-words")
    weight = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    # log likelihood of a word's own share of toxic documents against the share of all; it must stand out
    # among all candidate words
    share = n_bad / sizes.n
    total = F.col("bad") + F.col("good")
    gain = F.col("bad") * F.log(F.col("bad") / total / share)
    if n_good:
        gain = gain + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / total / (1 - share))).otherwise(0.0)
    least_gain = math.log(max(1, counts.count())) + 2
    evidence = counts.withColumns({"weight": weight, "gain": gain}).filter((F.col("weight") >= math.log(least_ratio)) & (F.col("gain") >= least_gain))
    best = evidence.orderBy(F.desc("gain"), "key").limit(lexicon_words).collect()
    model = ToxicityModel({r.key: r.weight for r in best})

    def phrases(folded: str) -> set[str]:
        machine = cached_automaton(model)
        return {p for end, (width, _) in machine.iter(folded) for p in around(folded, end - width + 1, end)} if machine else set()

    harmless = _counted(texts, phrases).filter((F.col("good") >= 5) & (F.col("good") * n_bad >= F.col("bad") * n_good))
    model.exceptions = {r.key for r in harmless.orderBy(F.desc("good"), "key").limit(lexicon_words).collect()}
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(sizes.n)) < calibration_rows)

    def features(batches):
        machine = cached_automaton(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.feature(fold(t), machine) for t in batch.column(0).to_pylist()], type=pa.float64()), batch.column(1)], names=["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(features, "x double, toxic int").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], dtype=float)
    model.slope, model.offset = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for one feature and a constant; a little ridge keeps separable data finite."""
    design = np.stack((x, np.ones_like(x)), axis=1)
    w = np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


_machines: dict[int, tuple[ToxicityModel, object]] = {}


def cached_automaton(model: ToxicityModel):
    """The automaton of a model, built once where it is used repeatedly."""
    if id(model) not in _machines:
        _machines.clear()
        _machines[id(model)] = (model, model.automaton())
    return _machines[id(model)][1]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (score >= 0.5) of every whole text, without a shuffle.

    Null and empty texts match nothing and get the score of a text without matches. Rows stand for
    themselves; only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by lexicon_words

    def run(batches):
        model = shared.value
        machine = cached_automaton(model)
        for batch in batches:
            scores = [model.score(model.feature(fold(t), machine)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64())], names=["id", "score"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
