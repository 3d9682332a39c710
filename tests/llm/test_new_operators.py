"""Spelling variants, BPE by rounds, whitening, and rows that substring dedup must tell apart: brute force and odd tables."""

import decimal
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.llm import language, queries, rounds, spelling, substrings, whitening

DATA = "/root/testdata/sf0.001"
WORDS = "doc_id long, text string"


# -- spelling variants --------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_vocabulary(rows, damage=97, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(vocabulary, all_pairs=False):
    near = defaultdict(set)
    if all_pairs:
        for a in vocabulary:
            near[a] = {b for b in vocabulary if b != a and distance_one(a, b)}
    else:
        holes = defaultdict(set)
        for w in vocabulary:
            for k in range(len(w)):
                holes[w[:k] + "\0" + w[k + 1 :]].add(w)
                if (shorter := w[:k] + w[k + 1 :]) in vocabulary:
                    near[w].add(shorter)
                    near[shorter].add(w)
        for group in holes.values():
            for w in group:
                near[w] |= group - {w}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), vocabulary[form[w]] if form[w] else None) for w, n in vocabulary.items()}


def as_set(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def test_variants_query_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = brute_variants(brute_vocabulary(rows))
    assert sum(w[1] is not None for w in want) > 100
    assert as_set(queries.op11_spelling_variants(spark, DATA)) == want


def test_variants_in_cut_blocks(spark, monkeypatch):
    """Blocks of a few words, so that own words and neighbours are cut into pieces and parts."""
    monkeypatch.setattr(spelling, "_OWN", 3)
    monkeypatch.setattr(spelling, "_OTHERS", 5)
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(5, 8))) for _ in range(400)})
    vocabulary = {w: int(rng.integers(1, 40)) for w in words}
    near = spelling.near_words(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
    want = brute_variants(vocabulary, all_pairs=True)
    counts = {(w, n, near_n) for w, _, _, n, near_n, _ in want}
    assert {(r.word, r.n, r.n_near) for r in near.collect()} == counts
    best = {r.word: (r.best, r.best_n) for r in near.collect() if r.n_near}
    for w, (b, n) in best.items():
        assert (b, n) == min(((x, m) for x, m in vocabulary.items() if x != w and distance_one(w, x)), key=lambda p: (-p[1], p[0]))


def test_variants_count_pairs_of_a_block_once(spark, monkeypatch):
    """More letters than groups: words of one block are near each other and meet in every part of their piece."""
    monkeypatch.setattr(spelling, "_OTHERS", 5)
    rng = np.random.default_rng(4)
    words = sorted({"xx" + "".join(rng.choice(list("abcdefghi"), 3)) for _ in range(250)})
    vocabulary = {w: int(rng.integers(1, 40)) for w in words}
    near = spelling.near_words(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
    want = {(w, n, near_n) for w, _, _, n, near_n, _ in brute_variants(vocabulary, all_pairs=True)}
    assert {(r.word, r.n, r.n_near) for r in near.collect()} == want


def test_variants_on_odd_tables(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert as_set(spelling.variants(odd_documents)) == brute_variants(brute_vocabulary(rows))
    assert spelling.variants(no_documents).count() == 0
    # ties, chains, letters beyond ASCII, upper case that is not folded, and a very long word
    long = "z" * 5000
    text = " ".join(["house"] * 20 + ["hoise"] * 9 + ["hoisé"] * 4 + ["ÉCOLE"] * 3 + ["école"] * 3 + ["abcde"] * 6 + ["abcdf"] * 6 + ["abcdg"] * 3 + [long] * 3 + [long + "y"] * 7)
    docs = spark.createDataFrame([(None, text), (None, None), (2, "")], WORDS)
    got = as_set(spelling.variants(docs, damage=0))
    assert got == brute_variants(brute_vocabulary([(None, text)], damage=0), all_pairs=True)
    by_word = {g[0]: g for g in got}
    assert by_word["hoisé"][1:3] == ("hoise", "house") and by_word["abcdg"][1] == "abcde" and by_word["abcde"][1] is None
    assert by_word[long][1] == long + "y"


# -- BPE by rounds ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return rounds.RoundBPE(rounds.default_ranks())


@pytest.fixture(scope="module")
def library(coder):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.rank, special_tokens={})


def test_rounds_equal_the_library(coder, library):
    rng = np.random.default_rng(0)
    pieces = ["'", "s", "ll", " ", "  ", "\n", "\t", " ", "a", "é", "Z", "1", "!", "日本", "😀", "<|endoftext|>", "'re", "ß", "́", "　", "."]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(8000)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéü"), rng.integers(1, 400))) for _ in range(500)]
    texts += ["".join(rng.choice(list(letters), n)) for letters in ("aab", "xyxyz", "日本語", "abcdefghij") for n in (513, 1000, 4001)]
    texts += ["x" * 5000, "ab" * 3000 + " " * 700, "a" * 513, ""]
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert all(coder.decode(g) == t.encode() for g, t in zip(got, texts, strict=True))


def test_every_token_encodes_to_itself(coder):
    words = [t for t in coder.tokens if t]
    assert [x for x in coder.encode_words(words)] == [[coder.rank[w]] for w in words]


def test_merging_of_whole_tokens_equals_single_merges(coder):
    """merge_words() against merges one at a time, also where several pairs merge in a round."""

    def single(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [coder.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:], strict=False)]
            k = ranks.index(min(ranks))
            if ranks[k] == math.inf:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [coder.rank[p] for p in parts]

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aabb etx"), n)).encode() for n in [*range(1, 40), 600, 700, 1500]] + [b"a" * 600, b"ab" * 400, bytes(range(256)) * 3]
    assert [x.tolist() for x in coder.merge_words(words)] == [single(w) for w in words]


def test_pair_table(coder):
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    pairs = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(left, right, strict=True))}
    a, b = np.array(list(pairs)).T
    table = rounds.PairTable(a, b, np.array(list(pairs.values())))
    assert table.ranks(a, b).tolist() == list(pairs.values())
    x, y = rng.integers(-1, 50_000, 5000), rng.integers(-1, 50_000, 5000)
    assert all(r == pairs.get((int(p), int(q)), rounds._NEVER) for p, q, r in zip(x, y, table.ranks(x, y), strict=True))


def test_rounds_query(spark, documents, library):
    got = {r.doc_id: r for r in queries.op12_round_bpe(spark, DATA).collect()}
    for r in documents.collect():
        ids = library.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_rounds_on_odd_tables(odd_documents, no_documents):
    rows = rounds.encode_decode(odd_documents).collect()
    texts = Counter((r.doc_id, (r.text or "").encode()) for r in odd_documents.collect())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in rows) == texts
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert rounds.encode_decode(no_documents).count() == 0


# -- whitening ----------------------------------------------------------------------------------


def exact_polynomial(m):
    """Faddeev-LeVerrier over fractions."""
    d = len(m)
    a = [[Fraction(x) for x in row] for row in m]
    product = lambda x, y: [[sum(x[i][k] * y[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
    out, b = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = product(a, b)
        c = -sum(ab[i][i] for i in range(d)) / k
        out.append(c)
        b = [[ab[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(x) for x in out]


def scatter_like(rng, d, rank, top=1000):
    x = rng.integers(-top, top, (rank, d)).astype(object)
    return (x.T @ x).tolist()


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (2, 2), (5, 5), (7, 3), (9, 9)):
        m = scatter_like(rng, d, rank)
        assert whitening.characteristic_polynomial(spark, m) == exact_polynomial(m)
    zeros = [[4, 0, 0], [0, 0, 0], [0, 0, 9]]  # no entry below the diagonal to eliminate with
    assert whitening.characteristic_polynomial(spark, zeros) == [1, -13, 36, 0]


def poly_of(roots):
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([*c, 0], [0, *c], strict=True)]
    return c


@pytest.mark.parametrize("roots", [[5, 3, 1], [4, 4, 4, 1], [2**70, 2**70 + 1, 0, 0, 3], [8, 4, 2, 1], [7], [0, 0], [16, 16, 8, 8, 8, 1]])
def test_roots_with_multiplicity(roots):
    found = whitening.RealRoots(poly_of(roots)).greatest(10)
    got = [Fraction(a, 1) / Fraction(2) ** s for a, s in found]
    want = sorted((r for r in roots if r), reverse=True)
    assert len(got) == len(want)
    assert all(abs(g - w) <= w * Fraction(1, 10**70) for g, w in zip(got, want, strict=True))
    assert [x for x in whitening.RealRoots(poly_of(roots)).greatest(2)] == found[:2]


def test_irrational_roots():
    found = whitening.RealRoots([1, -4, 2]).greatest(2)  # 2 +- sqrt 2
    with decimal.localcontext(prec=100):
        for (a, s), want in zip(found, (2 + decimal.Decimal(2).sqrt(), 2 - decimal.Decimal(2).sqrt()), strict=True):
            assert abs(decimal.Decimal(a) / decimal.Decimal(2) ** s - want) < decimal.Decimal(10) ** -90


def test_exact_gram():
    rng = np.random.default_rng(4)
    for top in (10, 1 << 20, 1 << 40, 1 << 61):
        y = rng.integers(-top, top, (50, 3))
        assert whitening.exact_gram(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()


def check_whitening(rows, vectors, ids):
    """rows of whiten() against numpy in double, exact integers and the stated bounds."""
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.astype(object).sum(axis=0)
    v = np.cov(x.T - 1_000_000.0, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    count = min(32, int((e > 1e-9 * e[0]).sum()))
    assert {r.component for r in rows} == set(range(1, count + 1)) and len(rows) == n * count
    assert all(abs(r.identity_error) <= 1e-4 and r.n == n for r in rows)
    by = {(r.vec_id, r.component): r for r in rows}
    mean = np.array([float(Fraction(int(t), n)) for t in s])
    for k in range(count):
        got = np.array([by[i, k + 1].whitened for i in ids])
        assert all(abs(by[i, k + 1].explained - e[k] / np.trace(v)) < 1e-4 * e[k] / np.trace(v) for i in ids)
        if min(np.abs(np.delete(e, k) - e[k])) > 1e-6 * e[0]:
            want = (x - mean) @ u[:, k] / np.sqrt(e[k])
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
    for i, row in zip(ids, x.astype(object), strict=True):
        assert int(by[i, 1].deviation) == sum(d * d for d in (n * row - s).tolist())
    w = np.array([[by[i, k + 1].whitened for k in range(count)] for i in ids])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(count)).max() < 1e-6


def test_whitening_query(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    rows = queries.op13_embedding_whitening(spark, DATA).collect()
    check_whitening(rows, np.array([r.embedding for r in table], dtype=float), [r.vec_id for r in table])


def test_whitening_on_odd_tables(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.standard_normal((40, 4)) @ np.diag([3.0, 2.0, 1.0, 0.0])).tolist()  # one dimension is constant
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0, math.nan, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*enumerate(vectors), *odd], "vec_id long, embedding array<double>").withColumns({"component": F.lit("clash"), "vec": F.lit(1), "whitened": F.lit(None)})
    rows = whitening.whiten(df).collect()
    check_whitening(rows, np.array(vectors), list(range(40)))
    # rows with one id or none, and equal rows, each stand for themselves
    doubled = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [3.0, 5.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(doubled).count() == 4 * 2
    empty = whitening.whiten(df.filter("vec_id < 0"))
    assert empty.count() == 0 and empty.columns == whitening.whiten(df).columns
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<double>")).count() == 0


def test_whitening_of_equal_eigenvalues(spark):
    corners = [(float(a), float(b), float(c)) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    df = spark.createDataFrame([(k, list(v)) for k, v in enumerate(corners)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    check_whitening(rows, np.array(corners), list(range(8)))
    assert {round(r.explained, 12) for r in rows} == {round(1 / 3, 12)}


def test_deviation_beyond_a_long_is_null_in_the_query_only(spark):
    df = spark.createDataFrame([(k, [float(k) * 1e12, 1.0]) for k in range(50)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    y = [int(64 * k * 1e12) for k in range(50)]
    assert {(r.vec_id, int(r.deviation)) for r in rows if r.deviation is not None} <= {(k, (50 * y[k] - sum(y)) ** 2) for k in range(50)}
    assert all(r.deviation is not None for r in rows if (50 * y[r.vec_id] - sum(y)) ** 2 < 10**38)


# -- substring dedup: rows that share an id -----------------------------------------------------


def test_rows_with_one_id_and_one_hash(spark):
    """Texts of different lengths with equal 32-bit hashes, under one id and without ids."""
    base = " ".join(f"b{k}" for k in range(30))
    long = spark.range(400_000).select(F.concat(F.lit(base + " tail"), F.col("id").cast("string")).alias("a")).withColumn("h", F.hash("a"))
    short = spark.range(400_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("b")).withColumn("h", F.hash("b"))
    pair = long.join(short, "h").orderBy("a", "b").first()
    assert pair is not None
    for doc_id in (9, None):
        docs = spark.createDataFrame([(1, base), (doc_id, pair.a), (doc_id, pair.b), (doc_id, pair.a)], WORDS)
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect())
        tail = pair.a.split()[-1]
        assert got == sorted([(1, 30, 0, base), (doc_id or 0, 31, 30, tail), (doc_id or 0, 31, 30, tail), (doc_id or 0, 1, 0, pair.b)])


def test_texts_stay_verbatim_where_nothing_goes(spark):
    docs = spark.createDataFrame([(1, "a  b\n c "), (2, None), (3, "")], WORDS)
    assert {(r.doc_id, r.kept) for r in substrings.remove_repeats(docs, verbatim=True).collect()} == {(1, "a  b\n c "), (2, None), (3, "")}
    assert {(r.doc_id, r.kept) for r in substrings.remove_repeats(docs).collect()} == {(1, "a b c"), (2, ""), (3, "")}


# -- language: kernels and scores by sets of n-grams --------------------------------------------


def grams(text, n):
    folded = re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
    return {folded[k : k + n] for k in range(len(folded) - n + 1)}


def kernel(a, b):
    return sum(len(grams(a, n) & grams(b, n)) / math.sqrt(max(len(grams(a, n)), 1) * max(len(grams(b, n)), 1)) for n in (1, 2, 3)) / 3


def test_language_scores_equal_the_kernel_expansion(spark):
    texts = [("the cat sat on the mat", "en"), ("a dog and the old house", "en"), ("der hund und das alte haus", "de"), ("die katze sitzt auf der matte", "de"), ("le chat est sur la table", "fr")]
    labelled = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(texts)] + [(0, *texts[0]), (9, None, "en"), (10, "no label", None)], "doc_id long, text string, lang string")
    model = language.fit(labelled)
    assert model.languages == ["de", "en", "fr"]
    k = np.array([[kernel(a, b) for b, _ in texts] for a, _ in texts])
    values, vectors = np.linalg.eigh(k + 1e-6 * np.eye(5))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    y = np.array([[c == x for x in model.languages] for _, c in texts], dtype=float)
    weight = (y / y.sum(axis=0)).sum(axis=1)
    mapped = k @ root
    coefficients = root @ np.linalg.solve(mapped.T @ (mapped * weight[:, None]) + 1e-3 * np.eye(5), mapped.T @ (y * weight[:, None]))
    asked = ["the mat and the cat", "das haus", "la table est vieille", "zzz", "123"]
    want = np.array([[kernel(t, b) for b, _ in texts] for t in asked]) @ coefficients
    names, scores = model.score(asked)
    assert all(abs(model.score([t])[1][0] - s) < 1e-6 for t, s in zip(asked, scores, strict=True))  # wherever it stands in a batch
    assert names[4] == "und" and scores[4] == 0
    for n, s, w in zip(names[:4], scores[:4], want[:4], strict=True):
        assert n == model.languages[int(w.argmax())] and abs(s - min(max(w.max(), 0), 1)) < 1e-3


def test_language_sample_is_bounded_and_told_apart_by_text(spark):
    rows = [(7, f"english words number {k} of the house", "en") for k in range(40)] + [(7, "deutsche worte und das haus", "de")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=5)
    assert model.languages == ["de", "en"]
    got = language.predict(docs, model).groupBy("lang_pred").count().collect()
    assert {(r.lang_pred, r["count"]) for r in got} == {("en", 40), ("de", 40)}
    many = spark.createDataFrame([(k, chr(97 + k // 9) * 3 + chr(97 + k % 9) * 4, f"l{k:03d}") for k in range(200)], "doc_id long, text string, lang string")
    assert len(language.fit(many, landmarks=10).languages) == 200
