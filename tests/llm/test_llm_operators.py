"""The pipeline operators against brute force, exact round trips and held-out labels, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orthoweave.llm import ann, bpe, jaccard, language, packing, quality, queries, secrets, sql, substrings, tokens, toxicity, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- tokens and packing -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_encoder_equals_the_library(library):
    rng = np.random.default_rng(0)
    pieces = ["'", "s", "ll", "ve", " ", "  ", "\n", "\t", " ", "a", "é", "Z", "1", "!", "日本", "😀", "<|endoftext|>", "<|end", "'re", "ß", "́", "　", "."]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(20_000)]
    texts += [f"a{chr(c)}b {chr(c)}" for c in [*range(0x3000), *range(0xFE00, 0x10100), *range(0x1F300, 0x1F700)]] + ["x" * 5000, "ab" * 3000 + " " * 500]
    coder = bpe.SpeculativeBPE(tokens.default_vocabulary())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == want
    assert all(coder.decode(g) == library.decode(w, skip_special_tokens=False) for g, w in zip(got[:3000], want[:3000], strict=True))


def test_every_token_is_its_own_encoding():
    coder = bpe.SpeculativeBPE(tokens.default_vocabulary())
    words = [t for i, t in enumerate(coder.tokens) if i not in coder.special.values()]
    assert all(m == [coder.vocab[w]] for w, m in zip(words, coder.merge_all(words), strict=True))


def test_memo_limit_does_not_change_ids(documents):
    texts = [r.text for r in documents.limit(40).collect()]
    a, b = bpe.SpeculativeBPE(tokens.default_vocabulary()), bpe.SpeculativeBPE(tokens.default_vocabulary(), memo_words=10)
    for _ in range(2):
        assert all((x == y).all() for x, y in zip(a.encode(texts), b.encode(texts), strict=True))


def test_encode_decode_query(spark, documents, library):
    got = {r.doc_id: r for r in queries.op6_bpe_encode_decode(spark, DATA).collect()}
    for r in documents.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_odd_rows(odd_documents, no_documents):
    rows = tokens.encode_decode(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = Counter((r.doc_id, r.text or "") for r in odd_documents.collect())
    assert Counter((r.doc_id, r.decoded) for r in rows) == texts
    assert tokens.encode_decode(no_documents).count() == 0


def check_packing(docs, packed, library, capacity=2048):
    ids_of = defaultdict(list)
    for r in docs.collect():
        ids_of[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces = defaultdict(list)
    for r in packed:
        assert 0 < r.length <= capacity
        whole = ids_of[r.doc_id]
        assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for t in whole)
        pieces[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(t) for ts in ids_of.values() for t in ts)
    assert sum(r.length for r in packed) == total
    assert len(packed) == sum(-(-len(t) // capacity) for ts in ids_of.values() for t in ts)
    return len(pieces), total / capacity


def test_packing(spark, documents, library):
    used, least = check_packing(documents, queries.op4_best_fit_packing(spark, DATA).collect(), library)
    assert used <= least * 1.02 + 1


def test_packing_over_a_deep_tree(spark, documents, library):
    items = packing.pieces(documents.repartition(23), capacity=512)
    packed = packing.pack(items, 512, fan_in=2, rows_per_task=100).collect()
    check_packing(documents, packed, library, 512)


def lengths_table(spark, lengths, capacity):
    assert max(lengths) <= capacity
    return spark.createDataFrame([(k, 0, 0, int(n), k % 97) for k, n in enumerate(lengths)], packing._PIECE)


def sequences(packed, capacity, lengths):
    """Checks places without gaps and gives the number of sequences."""
    rows = packed.collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(k, n) for k, n in enumerate(lengths)]
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= capacity
    return len(held)


@pytest.mark.parametrize("seed", range(4))
def test_bins_that_stay_behind_cost_no_sequence(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = (rng.integers(1, 65, 900) if seed % 2 else rng.choice([7, 20, 33, 40, 51], 900)).tolist()
    items = lengths_table(spark, lengths, 64)
    used = [sequences(packing.pack(items, 64, nearly_full=1, fan_in=2, rows_per_task=40, hand_up=n), 64, lengths) for n in (None, 10**6)]
    assert used[0] == used[1]


def test_order_of_lengths_does_not_matter(spark):
    rng = np.random.default_rng(1)
    lengths = sorted(np.minimum(2048, 1 + rng.gamma(1.5, 500, 20_000).astype(int)).tolist())
    used = sequences(packing.pack(lengths_table(spark, lengths, 2048), rows_per_task=2500), 2048, lengths)
    assert used <= -(-sum(lengths) // 2048) * 1.02


def least_sequences(lengths, capacity):
    """The exact least number, by trying every bin for each item."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


def test_small_packings_against_the_exact_least_number(spark):
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = sorted(rng.integers(1, 11, 9).tolist(), reverse=True)
        used = len(packing.best_fit(lengths, 10)[2])
        assert least_sequences(lengths, 10) <= used <= least_sequences(lengths, 10) * 11 / 9 + 6 / 9
    lengths = [5, 5, 6, 4, 7, 3, 8, 2, 9, 1]
    assert sequences(packing.pack(lengths_table(spark, lengths, 10), 10), 10, lengths) == least_sequences(lengths, 10) == 5


def test_packing_odd_rows(odd_documents, no_documents, library):
    check_packing(odd_documents, packing.pack_documents(odd_documents).collect(), library)
    assert packing.pack_documents(no_documents).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert (bins.tolist(), offsets.tolist(), fills.tolist()) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8], [10, 10])


# -- substrings ---------------------------------------------------------------------------------


def brute_repeats(rows, width=20):
    docs = defaultdict(list)
    for i, t in rows:
        docs[float("inf") if i is None else i].append(WORD.findall(t or ""))
    first = {}
    for i in sorted(docs):
        for w in docs[i]:
            for k in range(len(w) - width + 1):
                first.setdefault(tuple(w[k : k + width]), (i, k))
                first[tuple(w[k : k + width])] = min(first[tuple(w[k : k + width])], (i, k))
    out = []
    for i in sorted(docs):
        for w in docs[i]:
            gone = set()
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] != (i, k):
                    gone.update(range(k, k + width))
            out.append((None if i == float("inf") else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    blocks = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (19, 20, 21, 45, 80)]
    rows = [(int(i), " ".join(rng.choice(blocks + ["p q", "r s t"], rng.integers(0, 8)))) for i in rng.permutation(120)]
    rows += [(500, "z " * 300), (501, "y z " * 100), (None, blocks[4]), (7, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).select("doc_id", "n_words", "n_removed", "kept")
    assert collected(got) == brute_repeats(rows)


def morse(n):
    """A word of a and b, and its complement: polynomial hashes modulo 2**64 take such pairs for each other."""
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < n:
        word += word.translate(swap)
    return word, word.translate(swap)


@pytest.mark.parametrize("n", [512, 1024, 2048, 8192])
def test_regular_words_are_told_apart(spark, library, n):
    x, y = morse(n)
    common = [f"w{k}" for k in range(25)]
    rows = [(1, " ".join([*common[:12], x, *common[12:]])), (2, " ".join([*common[:12], y, *common[12:]])), (3, x), (4, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert collected(substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept")) == brute_repeats(rows)
    assert {r.doc_id: r.n_links for r in jaccard.join_similar(docs).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    got = {r.doc_id: r for r in tokens.encode_decode(docs).collect()}
    assert all(got[i].ids == library.encode(t, add_special_tokens=False).ids and got[i].decoded == t for i, t in rows)


def test_words_with_one_key_are_compared(library, monkeypatch):
    monkeypatch.setattr(bpe, "byte_span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    coder = bpe.SpeculativeBPE(tokens.default_vocabulary())
    for texts in (["remember yesterday tomorrow afternoon"], ["somewhere nonsense <|endoftext|> everywhere"], ["remember nonsense"]):
        assert [g.tolist() for g in coder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_parse_takes_the_farthest_match_and_steps_past_it():
    rng = np.random.default_rng(3)
    for _ in range(300):
        m = int(rng.integers(1, 12))
        start, n = rng.integers(0, 30, m), rng.integers(1, 8, m)
        src_doc, shift = rng.integers(0, 3, m), rng.integers(100, 102, m)
        spans = list(zip(*(x.tolist() for x in substrings.parse(start, n, src_doc, start + shift, 20)), strict=True))
        # matches that go on in the same source count as one
        runs = []
        for key in set(zip(src_doc.tolist(), shift.tolist(), strict=True)):
            windows = sorted({k for a, c, d, h in zip(start, n, src_doc, shift, strict=True) if (d, h) == key for k in range(a, a + c)})
            for k in windows:
                if runs and runs[-1][0] == key and runs[-1][2] == k:
                    runs[-1][2] = k + 1
                else:
                    runs.append([key, k, k + 1])
        want, at = [], -1
        while rest := [(a, b, key) for key, a, b in runs if b > at]:
            at = max(at, min(a for a, _, _ in rest))
            end = max(b for a, b, _ in rest if a <= at)
            want.append(end)
            at = end
        assert [a + length - 19 for a, length, _, _ in spans] == want
        assert all(any(key == (d, c - a) and x <= a and a + length - 19 == y for key, x, y in runs) for a, length, d, c in spans)


def test_factors_cover_the_repeated_windows(spark):
    rng = np.random.default_rng(9)
    blocks = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (19, 22, 45, 80, 130)]
    rows = [(i, " ".join(rng.choice(blocks + ["p q", "r s t"], rng.integers(0, 8)))) for i in range(80)]
    words = {i: WORD.findall(t) for i, t in rows}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        w, covered, end = words[r.doc_id], set(), 0
        for s in r.spans:
            last = s.start + s.length - 19
            assert last > end and (s.src_doc, s.src_start) < (r.doc_id, s.start)  # goes past the one before, and copies from before
            assert w[s.start : s.start + s.length] == words[s.src_doc][s.src_start : s.src_start + s.length]
            covered |= set(range(s.start, last))
            end = last
        assert covered == {k for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (r.doc_id, k)}


def test_substrings_odd_rows(odd_documents, no_documents):
    got = substrings.remove_repeats(odd_documents, carry=tuple(odd_documents.columns))
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept")) == brute_repeats([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert got.select("row.n_words").first()[0] == "clash"
    assert substrings.remove_repeats(no_documents).count() == 0


def test_factors_point_at_equal_words(spark, documents):
    got = {r.doc_id: r for r in substrings.remove_repeats(documents).collect()}
    words = {r.doc_id: WORD.findall(r.text or "") for r in documents.collect()}
    spans = [(d, s) for d, r in got.items() for s in r.spans]
    assert spans
    for d, s in spans:
        assert s.length >= 20 and words[d][s.start : s.start + s.length] == words[s.src_doc][s.src_start : s.src_start + s.length]


# -- similarity join ----------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8, width=5):
    sets = []
    for i, t in rows:
        w = WORD.findall(t or "")
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    n = len(sets)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            x, y = sets[a][1], sets[b][1]
            if (not x and not y) or (x and y and len(x & y) >= threshold * len(x | y) - 1e-9):
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), sets[k][0]), sets[k][0])
    return sorted(((sets[k][0], least[find(k)], links[k]) for k in range(n)), key=repr)


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [[f"t{k}" for k in rng.integers(0, 5000, 120)] for _ in range(6)]
    rows = []
    for d in range(400):
        w = list(base[rng.integers(0, 6)]) if d % 2 else [f"t{k}" for k in rng.integers(0, 5000, rng.integers(0, 60))]
        for _ in range(rng.integers(0, 6)):
            if w:
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 9)}"
        rows.append((d, " ".join(w)))
    rows += [(1000, "one two"), (1001, "one  two"), (1002, ""), (1003, None), (1004, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard.join_similar(df)) == brute_classes(rows)
    # small limits: every bucket is split, every group is cut into blocks
    assert collected(jaccard.join_similar(df, small=4, block=16)) == brute_classes(rows)


def test_links_of_a_block_join_what_is_alike():
    rng = np.random.default_rng(6)
    sketch = rng.integers(0, 2, (30, 16)).astype(np.uint32)
    rows = [(1, 0, 0, 0, k, sketch[k].tobytes()) for k in range(8)] + [(1, 0, 0, 1, k, sketch[k].tobytes()) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["leaf", "i", "j", "side", "rep", "sketch"])
    links = [(u, v) for b in jaccard._block_links(16, 0.7)([batch]) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    close = [(i, j) for i in range(8) for j in range(30) if i != j and (sketch[i] == sketch[j]).mean() >= 0.7]

    def classes(pairs):
        label = list(range(30))
        for _ in range(30):
            for u, v in pairs:
                label[u] = label[v] = min(label[u], label[v])
        return label

    assert close and len(links) <= 38 + 8 and classes(links) == classes(close)


def test_join_of_texts_that_share_much(spark):
    """Crowded buckets of texts below the threshold: half of each text is common to all."""
    rng = np.random.default_rng(11)
    common = [f"c{k}" for k in range(60)]
    rows = [(d, " ".join(common + [f"u{d % 40}_{k}" for k in range(int(rng.integers(12, 30)))])) for d in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard.join_similar(df, small=3, block=16)) == brute_classes(rows)


def test_join_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"t{k}" for k in rng.integers(0, 5000, 60)) for _ in range(4)]
    rows = [(5, base[0]), (5, base[1]), (5, base[1]), (7, base[1] + " tail"), (7, base[2]), (3, base[2] + " tail"), (5, base[0] + " tail"), (9, base[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(jaccard.join_similar(df)) == brute_classes(rows)
    assert collected(jaccard.join_similar(df, small=1)) == brute_classes(rows)


def test_join_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    got = jaccard.join_similar(odd_documents)
    assert collected(got.filter("doc_id is not null")) == brute_classes(rows)
    assert collected(got.filter("doc_id is null")) == [(None, None, 0), (None, None, 0)]
    assert jaccard.join_similar(no_documents).count() == 0


def test_runs_reach_the_target():
    assert (1 - 0.8**4) ** jaccard.runs_for(0.8, 0.9995) <= 0.0005


# -- quality ------------------------------------------------------------------------------------


def test_quality_counts(documents, odd_documents, no_documents):
    for docs in (documents.filter("doc_id % 1 = 0"), odd_documents):
        got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.measure(docs.select("doc_id", "lang", "text")).collect())
        want = Counter()
        for r in docs.collect():
            t, w = r.text or "", WORD.findall(r.text or "")
            seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            rep = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)] += 1
        assert got == want
    assert quality.measure(no_documents).count() == 0


def test_binomial_tail(spark):
    from math import comb

    df = spark.createDataFrame([(50, 0), (50, 1), (400, 3), (400, 4), (10, 9), (0, 0)], "n long, k long")
    for r in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        want = 1.0 if r.k > r.n * 0.01 else sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9


def test_cutoffs_keep_their_bound(spark):
    bad = [(k, "en", " ".join(f"w{j}###" for j in range(20))) for k in range(3000)]
    good = [(10_000 + k, "en", " ".join(f"v{j}" for j in range(30))) for k in range(3000)]
    docs = spark.createDataFrame(bad + good, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 10_000).cast("int").alias("quality"))
    measured = quality.measure(docs)
    cut = quality.choose_cutoffs(measured, labels)
    judged = quality.judge(measured, cut)
    assert judged.filter("doc_id >= 10000 and not kept").count() == 0
    assert judged.filter("doc_id < 10000 and kept").count() == 0
    # too few labels certify nothing
    assert quality.choose_cutoffs(measured, labels.filter("doc_id % 100 = 0")).count() == 0
    assert quality.judge(measured, quality.choose_cutoffs(measured, labels.filter("false"))).filter("not kept").count() == 0


# -- toxicity and language ----------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("You 1d10t, cl0wn$$$ ídiоt ＩＤＩＯＴ") == " you idiot ciown idiot idiot "
    assert toxicity.fold(None) == toxicity.fold("") == " "


def test_folding_of_runs_of_substitutes():
    assert toxicity.fold("a$$hole a55 n1663r @$$h0le!!!") == " asshoie ass nigger asshoie "
    assert toxicity.fold("wow!!! cash$$$ C++ 455 $5 5+5 100%") == " wow cash c "


def test_toxicity_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    got = queries.op2_toxicity(spark, data).filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    hits = sum(r.predicted == r.toxic for r in got)
    assert hits / len(got) >= 0.9


def test_toxicity_exceptions_and_odd_rows(spark, odd_documents, no_documents):
    rows = [(k, f"what a grubby fool you are number{k}" if k % 2 else f"a kind word for all of you number{k}", k % 2) for k in range(400)]
    rows += [(1000 + k, f"april fool is a day of fun number{k}", 0) for k in range(400)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), least_ratio=1.2)
    assert "foog" not in model.lexicon and toxicity.fold("fool").strip() in model.lexicon
    assert toxicity.fold("april fool").strip() in model.exceptions
    ask = spark.createDataFrame([(1, "you grubby f00l"), (2, "april fool is here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(ask, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].predicted == 0
    assert toxicity.score(odd_documents, model).count() == odd_documents.count()
    assert toxicity.score(no_documents, model).count() == 0
    none = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.score(ask, none).filter("predicted = 1").count() == 0


def test_language(spark, documents, odd_documents, no_documents):
    got = queries.op8_language_id(spark, DATA).filter("held_out").join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95
    model = language.fit(documents)
    odd = language.predict(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and sum(r.lang_pred == "und" for r in odd) == 4
    assert all(0 <= r.score <= 1 for r in odd)
    assert language.predict(no_documents, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd_documents, language.fit(no_documents)).collect()} == {"und"}


def test_kernel_scores_equal_the_kernel_expansion(spark, documents):
    spectrum = language.Spectrum()
    x, _ = spectrum.presence(["The cat", "the CAT sat", ""])
    assert (x[:, 2] == 0).all() and (x[0, 0] <= x[0, 1]).all()


# -- neighbours ---------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    got = defaultdict(list)
    for r in queries.op10_cross_polytope_ann(spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -9
        true = ids[np.lexsort((ids, -s))[:20]]
        found = got[ids[k]]
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0])) and ids[k] not in dict(found)
        recall.append(len(set(true) & set(dict(found))) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    same = [0.6, 0.8, 0.0, 0.0]
    rows = [(k, same) for k in range(60)] + [(100, None), (120, [0.0] * 4), (140, [float("nan"), 1.0, 0.0, 0.0]), (160, [None, 1.0, 0.0, 0.0]), (180, [float("inf"), 0.0, 0.0, 0.0]), (None, same), (200, [1.0, 0.0])]
    base = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert base.count() == 61
    index = ann.fit(base, base.filter("id % 20 = 0"))
    got = ann.search(base, base.filter("id % 20 = 0"), index, block=7).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        assert [r.vec_id for r in got if r.query_id == q] == [k for k in range(21) if k != q][:20]
    assert ann.fit(base.filter("false"), base) is None


def test_neighbours_of_repeated_rows(spark):
    same = [0.6, 0.8, 0.0, 0.0]
    rows = [(0, same)] * 2 + [(1, same)] * 80 + [(k, [0.6, 0.8, 0.001 * k, 0.0]) for k in range(2, 30) for _ in range(2)]
    base = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).coalesce(1)
    queries = base.filter("id = 0")
    got = ann.search(base, queries, ann.fit(base, queries)).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(k, k) for k in range(1, 21)]


def test_an_id_with_many_near_rows_takes_one_place(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(5, [1.0, 1e-6 * k, 0.0, 0.0]) for k in range(100)] + [(k, [0.9, 0.01 * k, 0.1, 0.0]) for k in range(6, 36)]
    base = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    queries = base.filter("id = 0")
    for block in (2048, 16):
        got = ann.search(base, queries, ann.fit(base, queries, target=1.0), block=block).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [5, *range(6, 25)] and got[0].score == 1.0


def test_block_top_against_brute_force():
    rng = np.random.default_rng(4)
    c, ids = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(0, 150, 300)
    q, q_ids = c[:40], ids[:40]
    cells, probed = rng.integers(0, 9, 300), rng.random((40, 9)) < 0.5
    found = ann.block_top(q_ids, q, ids, c, 7, cells, probed).groupby(["query_id", "vec_id"])["score"].max()
    want = {}
    for i in range(40):
        for j in np.flatnonzero(probed[i, cells] & (ids != q_ids[i])):
            key = (q_ids[i], ids[j])
            want[key] = max(want.get(key, -1e9), float(q[i] @ c[j]))
    for i in set(q_ids.tolist()):
        best = sorted(((-s, v) for (w, v), s in want.items() if w == i))[:7]
        have = sorted(((-s, v) for (w, v), s in found.items() if w == i))[:7]
        assert have == best


def test_rotations_keep_lengths():
    v = np.random.default_rng(1).standard_normal((5, 6))
    f = ann.CrossPolytope(6)
    assert np.allclose(np.linalg.norm(f.rotate(v, 0, 1), axis=1), 1)
    assert (f.scores(v, 1, 0).argmax(axis=1) == f.hashes(v, 1, 0)).all()


# -- secrets ------------------------------------------------------------------------------------


def test_secrets(spark, documents, odd_documents, no_documents):
    found = secrets.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    by = {(r.doc_id, r.value) for r in found.filter("is_secret").collect()}
    want = {(r.doc_id, m) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() for m in re.findall(r"\b[0-9a-fA-F]{40}\b", r.text)}
    assert want and by == want
    assert secrets.scan(no_documents).count() == 0
    masked = secrets.redact(odd_documents, secrets.scan(odd_documents))
    assert masked.columns == odd_documents.columns and masked.count() == odd_documents.count()


def findings_to_label(spark):
    """Credentials and look-alikes, all behind the same keywords, in documents of common words."""
    rng = np.random.default_rng(21)
    common = ["river", "stone", "garden", "market", "winter", "letter", "window", "paper", "orange", "silver", "forest", "summer"]
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    rows, labels = [], []
    for d in range(800):
        secret = d % 2 == 0
        value = "".join(rng.choice(alphabet if d % 4 else list("0123456789abcdef"), rng.integers(20, 41))) if secret else rng.choice(["-", "_", "."]).join(rng.choice(common, rng.integers(3, 6)))
        lead = rng.choice(["token =", "password:", "api_key ="])
        rows.append((d, f'{" ".join(rng.choice(common, 30))} {lead} "{value}" {" ".join(rng.choice(common, 30))}', "src" if d % 3 else "docs/example"))
        labels.append((d, str(value), int(secret)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), labels


def test_forest_removes_false_findings_of_held_out_documents(spark):
    docs, labels = findings_to_label(spark)
    learn = spark.createDataFrame([r for r in labels if r[0] % 5], "doc_id long, value string, label int")
    found = {(r.doc_id, r.value): r for r in secrets.scan(docs, labels=learn).collect()}
    held_out = [(found[d, v].is_secret, label) for d, v, label in labels if d % 5 == 0]
    hits = sum(1 for p, label in held_out if p and label)
    assert all(found[d, v].status == "forest" for d, v, _ in labels)
    assert hits / sum(p for p, _ in held_out) >= 0.97 and hits / sum(label for _, label in held_out) >= 0.97


def test_self_labels_are_not_what_the_forest_sees(spark):
    assert not set(secrets.SHAPE) & set(secrets.CONTEXT)
    docs, labels = findings_to_label(spark)
    # unlabelled text gives long words without any keyword; findings that look like them are removed
    words = [t.split()[:8] for t, in docs.select("text").collect()]
    plain = [(10_000 + d, " ".join([*words[d], v, *words[d - 1], v, *words[d - 2], v, *words[d - 3]]), "src" if d % 3 else "docs/example") for d, v, label in labels if not label]
    plain = spark.createDataFrame(plain, "doc_id long, text string, source string")
    found = {(r.doc_id, r.value): r.is_secret for r in secrets.scan(docs.unionByName(plain)).collect()}
    assert np.mean([found[d, v] for d, v, label in labels if label]) >= 0.97
    assert np.mean([found[d, v] for d, v, label in labels if not label]) <= 0.1


def test_labels_of_findings_with_ties_and_nulls(spark):
    docs, labels = findings_to_label(spark)
    doubtful = [(d, v, 1 - label) for d, v, label in labels[:40]] + [(None, None, 1), (3, "x", None)] + labels
    found = secrets.scan(docs, labels=spark.createDataFrame(doubtful, "doc_id long, value string, label int"))
    assert found.filter("status = 'forest'").count() == found.count() >= len(labels)
    none = secrets.scan(docs, labels=spark.createDataFrame([], "doc_id long, value string, label int"))
    assert none.filter("status = 'no_model' and probability is null and is_secret").count() >= len(labels)


def test_secrets_of_odd_rows(spark, odd_documents):
    row = (5, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" ok', "en", "s", 5)
    more = spark.createDataFrame([row, row, (None, *row[1:]), (6, row[1] * 2000, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"n_words": F.lit("clash"), "row": F.lit(1), "doc": F.lit(2), "score": F.lit(0.5)})
    docs = odd_documents.unionByName(more)
    found = secrets.scan(docs)
    assert Counter(r.doc_id for r in found.filter("is_secret").collect()) == {5: 2, None: 1, 6: 2000}
    masked = secrets.redact(docs, found)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.filter("contains(text, 'f3ef4d6b')").count() == 0 and masked.filter("contains(text, '[SECRET]')").count() == 4


def test_short_and_signed_secrets(spark):
    rows = [(1, 'the password = "Tr0ub4dor&3" here', "a"), (2, "db_password: p@ss:w0rd! and more", "a"), (3, "see postgres://bob:s3cr#t!9@host/db now", "a"), (None, "pwd=hunt3r!2, ok", "a"), (None, "nothing hunt3r!2", "a"), (4, "a plain sentence: without any", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {'the password = "[SECRET]" here', "db_password: [SECRET] and more", "see postgres://bob:[SECRET]@host/db now", "pwd=[SECRET], ok", "nothing hunt3r!2", "a plain sentence: without any"}
    found = secrets.scan(docs)
    assert {r.value for r in found.collect()} >= {"Tr0ub4dor&3", "s3cr#t!9", "hunt3r!2"}
    masked = {r.text for r in secrets.redact(docs, found).collect()}
    assert masked == {t.replace("p@ss:w0rd!", "[SECRET]") for t in want}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "key = abc123abc123abc123 abc123abc123abc123 end", "x"), (2, None, "y")], "doc_id long, text string, source string")
    findings = spark.createDataFrame([(1, 2, "abc123abc123abc123", 0.9, True)], "doc_id long, position int, value string, probability double, is_secret boolean")
    assert collected(secrets.redact(docs, findings)) == [(1, "key = [SECRET] [SECRET] end", "x"), (2, None, "y")]


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html><title>T &amp; x</title><script>bad()</script><p>One</p><p>Two &lt;3</p></html>"), (2, None, None), (3, "http://b/", "plain é")], "page_id long, url string, html string")
    source = warc.responses_from_pages(pages)
    made = warc.derivatives(source)
    assert made.count() == 6 and made.select("record_id").distinct().count() == 6
    text = {r.refers_to: r.block for r in made.filter("type = 'conversion'").collect()}
    ids = {r.page_id: r.record_id for r in source.collect()}
    assert text[ids[1]] == "T & x\nOne\nTwo <3" and text[ids[2]] == "" and text[ids[3]] == "plain é"
    every = source.select(*warc.RECORD).unionByName(made.select(*warc.RECORD))
    warc.write_warc(every, f"{tmp_path}/w")
    back = warc.read_warc(spark, f"{tmp_path}/w").select(*warc.RECORD)
    key = lambda d: sorted((r.record_id, r.type, r.target_uri, r.refers_to, tuple(sorted((r.headers or {}).items())), r.block, r.block_digest) for r in d.collect())
    assert [tuple("" if v is None else v for v in r) for r in key(back)] == [tuple("" if v is None else v for v in r) for r in key(every)]
    for r in made.collect():
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.headers["WARC-Refers-To-Payload-Digest"].startswith("sha256:")
    assert warc.derivatives(source.filter("false")).count() == 0


# -- SQL ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = c.execute(sql.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collected(df.select(*names)) == sorted((tuple(r) for r in found.fetchall()), key=repr)
