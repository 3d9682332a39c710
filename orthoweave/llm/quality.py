"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects documents whose value lies above a cutoff. Cutoffs are chosen per stratum on labelled
rows: a cutoff may be used only if an exact binomial test shows that the share of good documents it
rejects is below the rule's part of the risk limit. All tests of all strata, rules and cutoffs share
the error probability (Bonferroni), so with probability 1 - delta every chosen cutoff keeps its bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cameras import small
from ..session import stage

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAPS = " \t\n\x0b\f\r"

#: rule -> (numerator, denominator, cutoffs); the value is their quotient
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.03, 0.06, 0.09, 0.12, 0.15, 0.18)),
    "capitals": ("n_capitals", "word_chars", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "exclamations": ("n_exclamations", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "word_length": ("word_chars", "n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
}


@dataclass(frozen=True)
class Risk:
    """false_rejection: limit for all rules of a stratum together; delta: probability that any limit is missed."""

    false_rejection: float = 0.05
    delta: float = 0.05


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words occurring twice or more in the same array.

    Windows are compared by 64-bit hashes within one text. They are sorted only where two are equal.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(twice(x, j), F.get(s, j + 1)["h"] == x["h"], F.get(s, j - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        reach = lambda p: F.aggregate(F.transform(p, lambda at, j: F.least(F.coalesce(F.get(p, j + 1) - at, F.lit(width)), F.lit(width))), F.lit(0), lambda s, x: s + x)
        return let(ordered, lambda s: let(places(s), reach))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))

    some = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), some)))


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The counts of every whole text beside the columns in keep; a null text has no word."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    counts = F.transform(
        F.array(F.struct(words.alias("w"), lines.alias("l"))),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            _repeat_words(s["w"]).cast("long").alias("n_repeat_words"),
            F.size(s["l"]).cast("long").alias("n_lines"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
        ),
    )
    plain = docs.select(*keep, text.alias("text"), F.element_at(counts, 1).alias("c"))
    n_words, n_repeat = F.col("n_words"), F.col("n_repeat_words")
    return plain.select(
        *keep,
        "c.*",
        F.length(F.translate("text", GAPS, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(F.col("text"), CAPITALS).cast("long").alias("n_capitals"),
        _count_of(F.col("text"), "!").cast("long").alias("n_exclamations"),
    ).withColumn("base_failed", (n_words < 10) | (100 * n_repeat > 20 * n_words))


def _value(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(at most k of n), each with probability p; terms are carried as logarithms. 1 if k > n * p."""
    first = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(term.alias("term"), (s["total"] + F.exp(term)).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, first, add, lambda s: s["total"]))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoffs that part bad from good best.

    measured: rows of measure(); labels: doc_id and quality (1 good, 0 bad; null labels and ids take no
    part; the least label of a document counts). Rows that fail the base rules are not the method's.
    A rule without a certified cutoff that rejects a larger share of the bad than of the good is not
    used in that stratum, and a stratum with too few labelled rows has none. A null stratum is a
    stratum of its own. The result has at most one row a stratum and rule.
    """
    one = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.filter(~F.col("base_failed")).join(one, "doc_id")
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), sum((F.when(_value(r) > c, 1).otherwise(0) for c in RULES[r][2]), F.lit(0)).alias("above")) for r in RULES))
    binned = rows.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), (F.col("quality") > 0).alias("good"), F.explode(rules).alias("x"))
    counted = binned.groupBy("stratum", "x.rule", "x.above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    within = Window.partitionBy("stratum", "rule")
    grid = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*(F.array(*map(F.lit, c)) for _, _, c in RULES.values())))
    # a document above j cutoffs is rejected by the cutoffs 1..j
    totals = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("above", "good", "bad")).alias("bins"))
    tests = totals.withColumn("cutoffs", F.element_at(grid, F.col("rule"))).select("*", F.posexplode("cutoffs").alias("at", "cutoff"))
    reject = lambda name: F.aggregate(F.filter("bins", lambda b: b["above"] > F.col("at")), F.lit(0).cast("long"), lambda s, b: s + b[name])
    tests = tests.withColumn("good_out", reject("good")).withColumn("bad_out", reject("bad"))
    n_tests = F.count_distinct("stratum") * len(RULES) * 6
    strata = totals.agg(n_tests.alias("n_tests"))
    each = risk.false_rejection / len(RULES)
    # one row with the number of tests
    tests = tests.join(F.broadcast(strata), F.lit(True)).withColumn("p_value", binomial_tail(F.col("n_good"), F.col("good_out"), each))
    gain = F.col("bad_out") / F.greatest("n_bad", F.lit(1)) - F.col("good_out") / F.greatest("n_good", F.lit(1))
    certified = tests.filter(F.col("p_value") <= risk.delta / F.col("n_tests")).withColumn("gain", gain).filter(F.col("gain") > 0)
    ranked = certified.withColumn("rank", F.row_number().over(within.orderBy(F.desc("gain"), F.desc("cutoff"))))
    return stage(ranked.filter(F.col("rank") == 1).select("stratum", "rule", "cutoff"), "quality-cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds kept: false for rows that fail the base rules or lie above a cutoff of their stratum."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    # at most one row a stratum: sent to the rows, whose strata may be very unequal, where its size allows
    joined = measured.join(small(wide), F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("stratum"), "left")
    above = F.lit(False)
    for r in RULES:
        above = above | F.coalesce(_value(r) > F.col("cuts")[r], F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~above).drop("cuts", "stratum")
