"""Secret scans with a random forest that removes false positives; DataFrame and SQL operations only.

Candidates are long runs of identifier characters, and values of 6 or more characters other than blanks that
are assigned to a credential keyword or stand as the password in a URL. Each is described by its length, how often the class
of character changes, its share of digits, capitals and distinct characters, how much of it the letter
trigrams of the corpus's common words cover, the path it was found in, and the words beside it. A
random forest fitted on labelled findings gives each candidate a probability.

Labelled findings may be given. Where none are, they are made from one view and learned from another: a
candidate that a credential keyword stands before counts as a finding, one without a keyword near it
does not, and the forest sees nothing of that context: only the value, its path and whether the words
beside it are words. Keyword findings that look like the values of no credential are thereby removed.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

CANDIDATE = r"[A-Za-z0-9+/_=.-]{16,}"
# Words that name credentials, and path parts of code that only shows how.
KEYWORDS = r"(?i)(token|secret|passw|passwd|pwd|credential|bearer|auth|api[_-]?key|access[_-]?key|private[_-]?key|apikey)"
# A keyword, the rest of its name and a sign of assignment; the value may be quoted (groups 2, 3) or not (4).
ASSIGN = KEYWORDS + r"[\w-]{0,40}[\"'`\])]?\s*(?:=>|[:=]{1,2})"
ASSIGNED = ASSIGN + r"\s*(?:\"([^\"\s]{6,})|'([^'\s]{6,})|([^\s\"'][^\s]{5,}))"
URL_USER = r"://[^/\s:@]*:"
URL_PASSWORD = URL_USER + r"(\S{6,})@"
SAMPLE_PATHS = r"(?i)(test|example|sample|mock|fixture|demo|doc)"

#: what the labels of self_labelled() are made of, or goes along with it
CONTEXT = ["keyword_near", "keyword_before", "assigned", "quoted"]
SHAPE = ["length", "transitions", "digits", "capitals", "hexadecimal", "distinct", "coverage", "sample_path", "long_neighbour", "plain_neighbours"]
FEATURES = SHAPE + CONTEXT
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _share(value: Column, characters: str) -> Column:
    return (F.length(value) - F.length(F.translate(value, characters, ""))) / F.length(value)


def common_trigrams(docs: DataFrame, text_col: str = "text", least: int = 5, size: int = 4096) -> DataFrame:
    """The `size` letter trigrams that most words of the corpus hold, from words seen `least` times or more.

    Words are counted over all documents. The table is bounded by size.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^a-zß-ÿ]+")).alias("word"))
    counted = words.groupBy("word").count().filter((F.col("count") >= least) & (F.length("word") >= 3) & (F.length("word") <= 40))
    grams = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3)))).alias("gram"), "count")
    totals = grams.groupBy("gram").agg(F.sum("count").alias("n"))
    return totals.orderBy(F.desc("n"), "gram").limit(size).select("gram")


def candidates(docs: DataFrame, path_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, text_key (a hash of the text), position (of the word), value, path, and the words around each candidate of every whole text.

    rid numbers the rows; it lasts once they are written. A word with several candidates gives each; null texts give none; null paths count as empty.
    """
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def around(w: Column) -> Column:
        before = lambda i, k: F.coalesce(F.get(w, i - k), F.lit(""))
        line = lambda x, i: F.concat_ws(" ", before(i, 2), before(i, 1), x)
        short = lambda x, i: x.rlike(URL_PASSWORD) | (line(x, i).rlike("[:=]") & line(x, i).rlike(ASSIGNED))
        hit = lambda x, i: F.when(F.length(x) >= 6, F.when(((F.length(x) >= 16) & x.rlike(CANDIDATE)) | short(x, i), i))
        hits = F.filter(F.transform(w, hit), lambda i: i.isNotNull())
        return F.transform(hits, lambda i: F.struct(i.alias("position"), F.get(w, i).alias("word"), before(i, 1).alias("p1"), before(i, 2).alias("p2"), before(i, 3).alias("p3"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("n1")))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    may = F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED) | F.col("text").rlike(URL_PASSWORD)
    found = plain.filter(may).select("doc_id", F.xxhash64("text").alias("text_key"), "path", F.explode(F.element_at(F.transform(F.array(words), around), 1)).alias("c"))
    every = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    line = F.concat_ws(" ", "c.p2", "c.p1", "c.word")
    bare = F.transform(every(line, ASSIGNED, 4), lambda v: F.regexp_replace(v, r"[\"'`,;.)\]}>]+$", ""))
    short = F.filter(F.concat(every(line, ASSIGNED, 2), every(line, ASSIGNED, 3), bare), lambda v: (v != "") & F.contains(F.col("c.word"), v))
    values = F.concat(every(F.col("c.word"), CANDIDATE, 0), short, every(F.col("c.word"), URL_PASSWORD, 1))
    return found.select("doc_id", "text_key", "path", "c.*", F.explode(F.array_distinct(values)).alias("value")).withColumn("rid", F.monotonically_increasing_id())


def describe(found: DataFrame, trigrams: DataFrame) -> DataFrame:
    """FEATURES of the written rows of candidates(): each row by itself, so a value that occurs everywhere is no hot key."""
    value, lower = F.col("value"), F.lower(F.col("value"))
    kind = F.translate(value, _LOWER + _LOWER.upper() + "0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    grams = F.filter(F.transform(F.sequence(F.lit(1), F.length("value") - 2), lambda i: F.substring(lower, i, F.lit(3))), lambda g: g.rlike("^[a-zß-ÿ]{3}$"))
    spread = found.select("rid", F.explode(grams).alias("gram")).join(F.broadcast(trigrams), "gram").groupBy("rid").agg(F.count(F.lit(1)).alias("covered"))
    context = F.concat_ws(" ", "p3", "p2", "p1")
    head = F.expr("substring_index(word, value, 1)")
    joined = found.join(spread, "rid", "left")
    plain = lambda w: F.col(w).rlike(r"^[a-zA-Zß-ÿÀ-Þ]{2,20}[.,;:!?]?$").cast("double")
    return joined.select(
        "doc_id", "text_key", "position", "value", "path",
        F.length(value).cast("double").alias("length"),
        ((F.length(F.regexp_replace(kind, r"(.)\1+", "$1")) - 1) / F.length(value)).alias("transitions"),
        _share(value, "0123456789").alias("digits"),
        _share(value, _LOWER.upper()).alias("capitals"),
        _share(lower, "0123456789abcdef").alias("hexadecimal"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / F.greatest(F.length(value) - 2, F.lit(1))).alias("coverage"),
        F.col("path").rlike(SAMPLE_PATHS).cast("double").alias("sample_path"),
        F.concat_ws(" ", context, head).rlike(KEYWORDS).cast("double").alias("keyword_near"),
        (F.concat_ws(" ", "p2", "p1", head).rlike(ASSIGN) | head.rlike(URL_USER + "$")).cast("double").alias("keyword_before"),
        F.concat_ws(" ", "p1", head).rlike(r"[:=]\s*[\"']?$").cast("double").alias("assigned"),
        head.rlike(r"[\"'`]$").cast("double").alias("quoted"),
        # the words next before it are part of the context
        F.length("n1").cast("double").alias("long_neighbour"),
        (plain("p3") + plain("n1")).alias("plain_neighbours"),
    )


def self_labelled(described: DataFrame) -> DataFrame:
    """Labelled findings where none are given: label 1 for a value that a credential keyword stands before,
    0 for one without any keyword near; others are left out. To be learned from SHAPE alone."""
    label = F.when(F.col("keyword_before") > 0, 1.0).when(F.col("keyword_near") == 0, 0.0)
    return described.withColumn("label", label).filter(F.col("label").isNotNull())


def labelled_by(described: DataFrame, labels: DataFrame) -> DataFrame:
    """described with the given labels: rows doc_id, value, label (0 or 1; null or several different ones: not used)."""
    one = labels.groupBy("doc_id", "value").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("doc_id", "value", F.col("label").cast("double").alias("label"))
    return described.join(one, ["doc_id", "value"])


def fit(labelled: DataFrame, features: list[str] = FEATURES, rows_per_label: int = 5000, trees: int = 24, depth: int = 5, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest fitted on at most rows_per_label findings of each label (least hashed place first).

    labelled has the features and label (0 or 1; null: not used). None if a label is missing.
    """
    order = [F.xxhash64("doc_id", "position", "value"), F.col("doc_id"), F.col("position"), F.col("value")]
    parts = [labelled.filter(F.col("label") == v).orderBy(*order).limit(rows_per_label) for v in (0.0, 1.0)]
    sample = parts[0].unionByName(parts[1]).select(*features, "label")
    sample = stage(sample, "secret-findings").coalesce(1)
    if sample.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(assembled)


def score(described: DataFrame, model: RandomForestClassificationModel | None, features: list[str] = FEATURES) -> DataFrame:
    """doc_id, text_key, position, value, probability, is_secret, status of every candidate.

    status: forest, or no_model where no forest could be fitted; then the probability is null, nothing
    is removed, and every candidate that a credential keyword stands before is a secret.
    """
    out = ["doc_id", "text_key", "position", "value"]
    if model is None:
        return described.select(*out, F.lit(None).cast("double").alias("probability"), (F.col("keyword_before") > 0).alias("is_secret"), F.lit("no_model").alias("status"))
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(described)
    scored = model.transform(assembled).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*out, F.col("p").alias("probability"), (F.col("p") >= 0.5).alias("is_secret"), F.lit("forest").alias("status"))


def scan(docs: DataFrame, path_col: str = "source", labels: DataFrame | None = None) -> DataFrame:
    """Candidates of all documents, scored by a forest.

    labels: labelled findings (doc_id, value, label) to learn from, with all features; None: self_labelled()
    ones, from SHAPE alone. Equal rows give equal candidates each; null ids are ids like others; null
    texts and empty tables give none.
    """
    # candidates are read twice below: once for their trigrams, once to be described
    found = stage(candidates(docs, path_col), "secret-candidates")
    described = stage(describe(found, stage(common_trigrams(docs), "secret-trigrams")), "secret-features")
    features = SHAPE if labels is None else FEATURES
    model = fit(self_labelled(described) if labels is None else labelled_by(described, labels), features)
    return score(described, model, features)


def redact(docs: DataFrame, findings: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of each document replaced by mask in its text; all columns stay.

    Findings of scan() hold for the rows with their id, null or not, and text; findings without text_key
    for all rows with their id.
    """
    key = [F.col("text_key").alias("found_key")] if "text_key" in findings.columns else []
    per_doc = findings.filter("is_secret").groupBy(F.col("doc_id").alias("found_in"), *key).agg(F.sort_array(F.collect_set("value"), asc=False).alias("found_values"))
    # the longest first, so that no value is cut by one inside it
    per_doc = per_doc.withColumn("found_values", F.array_sort("found_values", lambda a, b: F.length(b) - F.length(a)))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    same = F.col("id").eqNullSafe(F.col("found_in"))
    joined = packed.join(per_doc, same & (F.col("own_key") == F.col("found_key")) if key else same, "left")
    text = F.aggregate(F.coalesce("found_values", F.array().cast("array<string>")), F.col("row.text"), lambda t, v: F.replace(t, v, F.lit(mask)))
    return joined.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
