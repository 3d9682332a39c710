"""Spelling variants: words one edit apart, found by Gram matrices of letter counts over blocks.

Two words one inserted, deleted or replaced letter apart have letter counts whose squared distance is 1
or 2. Blocks are sets of words with equal counts of a few groups of letters, so every block has words of
one length, and a near word lies in the same block, in one that counts a letter more or less in one
group (the adjacent length), or one more and one less in two groups. Every two such blocks meet in one
task: one matrix product of their letter counts gives all squared distances, pairs at most two apart are
kept, and their edits are verified letter by letter.

The number of groups follows the size of the vocabulary, so that blocks stay small; a block that is
still large is cut by a hash, and each two pieces meet in a task of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import size_in_bytes, stage

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (ord("A"), ord("a")))
#: the letters of words: a-z and U+00C0 to U+00FF
LETTERS = [*_LOWER, *map(chr, range(0xC0, 0x100))]
#: words of a block in one task, and words of its neighbours that meet them there
_OWN, _OTHERS = 1024, 4096
#: letters of a block in one task: words longer than a thousand letters come in fewer
_CHARACTERS = 1 << 20


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the words of the vocabulary and how often each occurs.

    Words are maximal runs of letters with A-Z in lower case. One run in about `damage` loses a letter: where
    the CRC-32 of "<id>:<run>" is divisible by it, the letter at CRC modulo length goes (0: none does). Words of
    fewer than min_length letters or min_count occurrences are left out. A null text has no words, a
    null id is an empty text in the CRC, and repeated rows count each.
    """
    text = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if damage:
        crc = F.crc32(F.concat_ws(":", "id", "run"))
        at = (crc % F.length("run")).cast("int")
        word = F.when(crc % damage == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


# -- blocks -------------------------------------------------------------------------------------


def letter_groups(words: DataFrame) -> list[str]:
    """Groups of letters that are about equally frequent in the vocabulary; more of them where it is larger."""
    counts = words.agg(F.count(F.lit(1)).alias("words"), *(F.sum(F.length("word") - F.length(F.translate("word", a, ""))).alias(f"c{k}") for k, a in enumerate(LETTERS))).first()
    n = max(3, min(10, 4 + round(math.log(max(counts.words, 1) / (1 << 16), 4))))
    groups, weights = [""] * n, [0] * n
    for weight, letter in sorted(((counts[f"c{k}"] or 0, a) for k, a in enumerate(LETTERS)), key=lambda x: (-x[0], x[1])):
        least = weights.index(min(weights))
        groups[least] += letter
        weights[least] += weight
    return groups


def _key(vector: list[Column]) -> Column:
    return F.concat_ws(",", *(v.cast("string") for v in vector))


def _placed(words: DataFrame, groups: list[str]) -> DataFrame:
    """Words with their block, and the blocks that they meet as others.

    Of two blocks that meet, the words of one go to the other: those of the longer words to the shorter, and
    of equal lengths those with one letter more in an earlier group.
    """
    counts = [F.length("word") - F.length(F.translate("word", g, "")) for g in groups]
    v = words.select("word", "n", *(c.cast("int").alias(f"v{k}") for k, c in enumerate(counts)))
    own = [F.col(f"v{k}") for k in range(len(groups))]
    moved = lambda changes: _key([own[k] + changes[k] if k in changes else own[k] for k in range(len(own))])
    meets = [F.when(own[i] > 0, moved({i: -1})) for i in range(len(own))]
    meets += [F.when(own[i] > 0, moved({i: -1, j: 1})) for i in range(len(own)) for j in range(i + 1, len(own))]
    return v.select("word", "n", _key(own).alias("block"), F.array_compact(F.array(*meets)).alias("meets"))


def _small(df: DataFrame, limit: int = 16 << 20) -> DataFrame:
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def _dealt(placed: DataFrame) -> DataFrame:
    """block, piece, part, own, word, n: which words meet in which task.

    A block is cut into pieces by a hash of the word; the words of neighbour blocks, and of later pieces of the
    same block, come to every piece in parts of bounded size, and the piece is there in every part.
    """
    sizes = stage(placed.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.max(F.length("word")).alias("length"), F.first("meets").alias("meets")), "spelling-blocks")
    pieces = F.ceil(F.col("size") / F.greatest(F.lit(1), F.least(F.lit(_OWN), F.floor(F.lit(_CHARACTERS) / F.col("length"))))).cast("int")
    visits = sizes.select("size", F.explode("meets").alias("block")).groupBy("block").agg(F.sum("size").alias("others"))
    others = F.coalesce("others", F.lit(0)) + F.when(F.col("pieces") > 1, F.col("size")).otherwise(0)
    limit = F.greatest(F.lit(1), F.least(F.lit(_OTHERS), F.floor(F.lit(4 * _CHARACTERS) / F.col("length"))))
    plan = sizes.select("block", "size", "length", pieces.alias("pieces")).join(_small(visits), "block", "left").select("block", "pieces", F.greatest(F.lit(1), F.ceil(others / limit)).cast("int").alias("parts"))
    plan = stage(plan, "spelling-plan")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    hashed = F.xxhash64("word")
    in_own = placed.join(_small(plan), "block").withColumn("own_piece", F.pmod(hashed, F.col("pieces")).cast("int"))
    in_part = F.pmod(F.shiftright(hashed, 20), F.col("parts")).cast("int").alias("part")
    own = in_own.select("block", F.col("own_piece").alias("piece"), every("parts", "part"), F.lit(True).alias("own"), "word", "n")
    # pieces before its own see a word of the same block as another's
    later = in_own.filter("own_piece > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("own_piece") - 1)).alias("piece"), in_part, F.lit(False).alias("own"), "word", "n")
    away = placed.select("word", "n", F.explode("meets").alias("block")).join(_small(plan), "block").select("block", every("pieces", "piece"), in_part, F.lit(False).alias("own"), "word", "n")
    return own.unionByName(later).unionByName(away)


# -- one task -----------------------------------------------------------------------------------


def _points(words: list[str], width: int) -> np.ndarray:
    """Code points of each word, one row a word, 0 beyond its end."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each of the 90 letters occurs in each row."""
    letter = np.where(points >= 0xC0, points.astype(np.int64) - 0xC0 + 26, points.astype(np.int64) - ord("a"))
    real = points > 0
    rows = np.nonzero(real)[0]
    counts = np.bincount(rows * len(LETTERS) + letter[real], minlength=len(points) * len(LETTERS)).reshape(len(points), len(LETTERS))
    # float32 holds squares and sums of counts below 2^24
    return counts.astype(np.float32 if points.shape[1] < 2000 else np.float64)


def one_edit(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Which rows of a and b (code points, padded with 0) are exactly one edit apart; b is as long as a or longer by one."""
    width = a.shape[1]
    same = a == b
    prefix = np.where(same.all(axis=1), width, same.argmin(axis=1))
    replaced = (a_len == b_len) & ((~same).sum(axis=1) == 1)
    # without the letter behind the common beginning, b is a: the rest of a is b moved by one
    moved = np.zeros_like(same)
    moved[:, :-1] = a[:, :-1] == b[:, 1:]
    moved[:, -1] = a[:, -1] == 0
    behind = np.arange(width)[None, :] >= prefix[:, None]
    inserted = (b_len == a_len + 1) & (moved | ~behind).all(axis=1)
    return replaced | inserted


def near_pairs(own: list[str], others: list[str], among_own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs one edit apart: of two own words (the first is the smaller place; not unless among_own), and of own words with others.

    Others are numbered on behind the own words. They are as long as the own words or longer by one.
    """
    width = max(map(len, [*own, *others])) + 1
    points = _points([*own, *others], width)
    lengths = (points > 0).sum(axis=1)
    counts = letter_counts(points)
    norms = (counts * counts).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_own, n_all = len(own), len(points)
    step = 2048
    for a in range(0, n_own, step):
        a_end = min(a + step, n_own)
        for b in range(a if among_own else n_own, n_all, step):
            b_end = min(b + step, n_all)
            squared = norms[a:a_end, None] + norms[None, b:b_end] - 2 * (counts[a:a_end] @ counts[b:b_end].T)
            i, j = np.nonzero(squared <= 2)
            i, j = i + a, j + b
            after = i < j
            i, j = i[after], j[after]
            each = max(1, (1 << 22) // width)
            for k in range(0, len(i), each):
                p, q = i[k : k + each], j[k : k + each]
                short = np.where(lengths[p] <= lengths[q], p, q)
                long = np.where(lengths[p] <= lengths[q], q, p)
                near = one_edit(points[short], lengths[short], points[long], lengths[long])
                found.append((p[near], q[near]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _meeting(table: pa.Table) -> pa.Table:
    """word, n_near, best_n, best of the words of a task that have near words there."""
    mine = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
    words = np.array(table.column("word").to_pylist(), dtype=object)
    counts = table.column("n").to_numpy(zero_copy_only=False)
    order = np.argsort(~mine, kind="stable")
    words, counts, n_own = words[order], counts[order], int(mine.sum())
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    if not n_own:
        return schema.empty_table()
    # own words are in every part of their piece; the first part alone counts the pairs among them
    p, q = near_pairs(words[:n_own].tolist(), words[n_own:].tolist(), table.column("part")[0].as_py() == 0)
    if not len(p):
        return schema.empty_table()
    word, other = np.concatenate((p, q)), np.concatenate((q, p))
    # the near word of largest n first, then the smallest: Python compares strings by code points
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((rank[other], -counts[other], word))
    word, other = word[by], other[by]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    n_near = np.diff(np.append(first, len(word)))
    return pa.table([pa.array(words[word[first]].tolist(), pa.string()), pa.array(n_near), pa.array(counts[other[first]]), pa.array(words[other[first]].tolist(), pa.string())], schema=schema)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best_n, best: how many words of the vocabulary are one edit away, and the one of largest n.

    words(word, n): distinct words of the letters a-z and U+00C0 to U+00FF. Ties go to the smallest in code-point order.
    """
    dealt = _dealt(stage(_placed(words, letter_groups(words)), "spelling-placed"))
    met = dealt.groupBy("block", "piece", "part").applyInArrow(_meeting, "word string, n_near long, best_n long, best string")
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b"))
    joined = words.join(found, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


# -- forms and roots ----------------------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form): the last word along the forms. Each step at least doubles n, so there is no circle.

    Pointers are doubled: every round follows twice as many steps, so a few rounds do.
    """
    step = stage(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = stage(step.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        if step.filter("moved").isEmpty():
            return step.drop("moved")
        step = step.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary of words_of().

    form is the near word of largest n (ties: smallest in code-point order) if that n is twice the word's own or
    more, else null; root is the last word along the forms, the word itself without one. A table without
    words gives no rows. Columns of docs other than id and text are not read.
    """
    words = stage(words_of(docs, id_col, text_col, damage, min_length, min_count), "spelling-words")
    near = near_words(words)
    is_form = F.col("best_n") >= 2 * F.col("n")
    formed = stage(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-near")
    return formed.join(roots_of(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
