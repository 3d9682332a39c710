"""Set-similarity join on word n-grams by chosen paths.

Every text is a set of word n-grams; its sketch has one min-hash token for each step of each run. In a
run, sets are split on sampled shared tokens: all sets take the token of the same step, and only sets
that share it stay together. Two steps always; buckets that are still large are split further. Small
buckets are brute-forced on the sketches with a wide margin. A bucket that stays large after the last
step is mostly one crowd of near copies: its sets are compared with its first one, and those that are
not, by then, in the first one's group are brute-forced against the whole bucket in blocks. So every pair
that meets in a run is either compared or already in one group. Runs repeat until the chance to miss a
pair at the threshold is below 1 - recall. Candidates are gathered into groups (components), and within a group
every pair of sets is compared exactly, by products of incidence matrices in blocks. Equal texts are
joined first and stand for one set; pairs are counted where they are found and never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import stage
from .vectors import Texts, chunks, mix, span_hashes

STEPS = 4
_PROFILE = "doc long, s1 long, s2 long, sketch binary, size long, key long"
#: n-grams of one block of a group: 32 MB
_BLOCK_GRAMS = 1 << 22


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met, with probability `recall`, if all runs take every step."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**STEPS)))


def _ngrams(words: Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each n-gram of a batch, and where each text begins among them.

    A text with fewer words than `width` has one n-gram, of all its words; one without words has none.
    """
    count = np.diff(words.first)
    whole = words.windows(width)
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(grams)))
    text = np.repeat(np.arange(len(count)), grams)
    at = words.first[text] + np.arange(begin[-1]) - begin[text]
    out = np.empty(len(at), dtype=np.uint64)
    full = count[text] >= width
    out[full] = whole[at[full]]
    if not full.all():
        short = text[~full]
        out[~full] = span_hashes(words.hashes[0], words.first[short], words.first[short + 1])
    return out, text, begin


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _fingerprints(words: Texts) -> list[np.ndarray]:
    """The sequence of words of each text as a 128-bit fingerprint, in two columns."""
    place = (np.arange(len(words.starts)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64)
    prints = []
    for h in words.hashes:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + place * np.uint64(0x9E3779B97F4A7C15)))))
        prints.append((sums[words.first[1:]] - sums[words.first[:-1]]).view(np.int64))
    return prints


def _profiles(width: int, tokens: int):
    def run(batches):
        factors = _multipliers(tokens)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 1 << 20):
                words = Texts(texts[a:b], 2)
                grams, _, begin = _ngrams(words, width)
                sketch = np.zeros((b - a, tokens), dtype=np.uint32)
                full = np.flatnonzero(np.diff(begin))
                if len(full):
                    for j, f in enumerate(factors):
                        sketch[full, j] = np.minimum.reduceat(((grams * f) >> np.uint64(32)).astype(np.uint32), begin[full])
                prints = _fingerprints(words)
                rows = [r.tobytes() for r in sketch]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints[0]), pa.array(prints[1]), pa.array(rows, type=pa.binary()), pa.array(np.diff(begin).astype(np.int64)), batch.column(2).slice(a, b - a)], names=["doc", "s1", "s2", "sketch", "size", "key"])

    return run


def _paths(runs: int):
    """For each set and run the keys of its buckets after two, three and four steps."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, runs, STEPS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, runs))
            keys = []
            for s in range(STEPS):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sketch[:, :, s] + np.uint64(1))
                keys.append(key.reshape(-1).view(np.int64))
            sets = batch.column(0).take(pa.array(np.repeat(np.arange(n), runs)))
            yield pa.RecordBatch.from_arrays([sets, *(pa.array(k) for k in keys[1:])], names=["rep", "k2", "k3", "k4"])

    return run


def _whole_groups(batches, key_columns: list[int]):
    """Batches of a sorted stream, cut so that no group is split between two; holds one group's rows over."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        batch = table.to_batches()[0]
        same = np.ones(batch.num_rows, dtype=bool)
        for k in key_columns:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if held is not None:
        yield held


def _bucket_links(tokens: int, least: float):
    """Brute force on sketches in each small bucket: pairs that may reach the threshold, once a bucket."""

    def run(batches):
        for batch in _whole_groups(batches, [0]):
            leaf = batch.column(0).to_numpy()
            rep = batch.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(len(leaf), tokens)
            us, vs = [], []
            apart = 1
            while apart < len(leaf):
                at = np.flatnonzero(leaf[apart:] == leaf[:-apart])
                if not len(at):
                    break
                alike = (sketch[at] == sketch[at + apart]).mean(axis=1) >= least
                us.append(rep[at[alike]])
                vs.append(rep[at[alike] + apart])
                apart += 1
            if us and sum(map(len, us)):
                pairs = np.unique(np.stack((np.concatenate(us), np.concatenate(vs)), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def _matrix(column, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, tokens)


def _alike_first(tokens: int, least: float):
    """Links of sets that may reach the threshold with the first set of their bucket: rows rep, sketch, least, its sketch."""

    def run(batches):
        for batch in batches:
            alike = (_matrix(batch.column(1), tokens) == _matrix(batch.column(3), tokens)).mean(axis=1) >= least
            keep = pa.array(alike)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], names=["u", "v"])

    return run


def _block_links(tokens: int, least: float):
    """Brute force on sketches of a block of some sets (side 0) with a block of their bucket: rows (leaf, i, j, side, rep, sketch) sorted by them.

    Each set of side 1 is linked once: links that join what is alike, never all pairs.
    """

    def run(batches):
        for batch in _whole_groups(batches, [0, 1, 2]):
            keys = [batch.column(k).to_numpy() for k in range(3)]
            side, rep, sketch = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5), tokens)
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.append(np.flatnonzero(new), batch.num_rows)
            us, vs = [rep[:0]], [rep[:0]]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                m = a + int((side[a:b] == 0).sum())
                parent = np.arange(b - m)  # of side 1, joined through the sets of side 0
                for i in range(a, m):
                    at = np.flatnonzero((sketch[m:b] == sketch[i]).mean(axis=1) >= least)
                    at = at[rep[m:b][at] != rep[i]]
                    if len(at):
                        us.append(np.full(1, rep[i]))
                        vs.append(rep[m + at[:1]])
                        fresh = at[np.isin(parent[at], parent[at[0]], invert=True)]
                        parent[np.isin(parent, parent[fresh])] = parent[at[0]]
                        us.append(rep[m + fresh])
                        vs.append(np.full(len(fresh), rep[m + at[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _sets(width: int):
    """The fingerprint of each text and its n-gram set as sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 1 << 20):
                words = Texts(texts[a:b], 2)
                grams, _, begin = _ngrams(words, width)
                rows = [np.unique(grams[i:j]).tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in _fingerprints(words)), pa.array(rows, type=pa.binary())], names=["s1", "s2", "grams"])

    return run


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity >= threshold; right None: left with itself.

    N-grams of one set only cannot be shared, so they get no column.
    """
    every = left if right is None else left + right
    sizes = np.array([len(s) for s in every], dtype=np.float64)
    tokens, column, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(every)), sizes.astype(np.int64))
    keep = shared[column]
    m = len(left)
    common = np.zeros((m, len(every) - (0 if right is None else m)))
    width = int(shared.sum())
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, width, 8192):  # columns in slices, so that memory is bounded
        i, j = np.searchsorted(column, (a, a + 8192))
        part = np.zeros((len(every), min(8192, width - a)), dtype=np.float32)
        part[row[i:j], column[i:j] - a] = 1
        common += part[:m] @ (part if right is None else part[m:]).T
    a, b = sizes[:m, None], (sizes if right is None else sizes[m:])[None, :]
    alike = common >= threshold * (a + b - common) - 1e-9
    alike &= (a > 0) & (b > 0)
    if right is None:
        np.fill_diagonal(alike, False)
    return alike


def _verify(threshold: float):
    """Exact comparison in each block: rows (group, i, j, side, rep, copies, grams) sorted by them.

    Gives for each set how many documents it is linked to in this block, and links that join what is linked.
    """

    def spanning(ids: np.ndarray, alike: np.ndarray) -> tuple[list[int], list[int]]:
        """For every linked set one link to the least set reachable in the block."""
        label = np.arange(len(ids))
        while True:
            least = np.where(alike, label[None, :], len(ids)).min(axis=1)
            new = np.minimum(label, least)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return ids[moved].tolist(), ids[label[moved]].tolist()

    def run(batches):
        for batch in _whole_groups(batches, [0, 1, 2]):
            keys = [batch.column(k).to_numpy() for k in range(3)]
            side, rep, copies = (batch.column(k).to_numpy() for k in (3, 4, 5))
            grams = batch.column(6)
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.append(np.flatnonzero(new), batch.num_rows)
            out_rep, out_links, out_to = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [np.frombuffer(g, dtype=np.uint64) for g in grams.slice(a, b - a).to_pylist()]
                ids, weight = rep[a:b], copies[a:b]
                m = int((side[a:b] == 0).sum())
                if m < b - a:
                    part = similar_pairs(sets[:m], sets[m:], threshold)
                    alike = np.zeros((b - a, b - a), dtype=bool)
                    alike[:m, m:] = part
                    alike[m:, :m] = part.T
                else:
                    alike = similar_pairs(sets, None, threshold)
                links = alike @ weight
                u, v = spanning(ids, alike)
                to = dict(zip(u, v, strict=True))
                for i in np.flatnonzero(links).tolist():
                    out_rep.append(int(ids[i]))
                    out_links.append(int(links[i]))
                    out_to.append(to.get(int(ids[i]), int(ids[i])))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (out_rep, out_links, out_to)], names=["rep", "links", "target"])

    return run


def text_key(text: Column) -> Column:
    """A hash of a whole text, which with the id tells rows of different texts apart."""
    return F.xxhash64(text.cast("string"))


def _linked(known: DataFrame, threshold: float, width: int, recall: float, small: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows doc, text, key (none null but text): profiles of the rows, the distinct texts, links and members.

    texts: rep (a number of its own for each fingerprint s1, s2), copies, and `first`, the least (doc, key) of
    its rows. links: rep, links. members: rep and component of each linked text.
    """
    runs = runs_for(threshold, recall)
    tokens = runs * STEPS
    profile = stage(known.mapInArrow(_profiles(width, tokens), _PROFILE), "jaccard-profiles")
    by_text = profile.groupBy("s1", "s2").agg(F.min(F.struct("doc", "key")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.max("size").alias("size"))
    # numbered before they are written, so the numbers stay
    reps = stage(by_text.withColumn("rep", F.monotonically_increasing_id()), "jaccard-texts")

    # split on sampled tokens; buckets of more than `small` sets take one step more
    with_words = reps.filter("not (s1 = 0 and s2 = 0)")
    paths = with_words.select("rep", "sketch").mapInArrow(_paths(runs), "rep long, k2 long, k3 long, k4 long")
    paths = stage(paths, "jaccard-paths")
    large = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small).select(key, F.lit(True).alias("large_" + key))
    two = paths.join(large(paths, "k2"), "k2", "left")
    wide = stage(two.filter("large_k2"), "jaccard-large")
    three = wide.join(large(wide, "k3"), "k3", "left")
    leaf = F.when(F.col("large_k3"), F.col("k4")).otherwise(F.col("k3"))
    deep = three.select("rep", leaf.alias("leaf"))
    leaves = two.filter("large_k2 is null").select("rep", F.col("k2").alias("leaf")).unionByName(deep)
    sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).filter("n > 1")
    met = stage(leaves.join(sizes, "leaf"), "jaccard-buckets")

    margin = max(0.0, threshold - 4 * math.sqrt(threshold * (1 - threshold) / tokens))
    sketched = met.filter(F.col("n") <= small).select("leaf", "rep").join(reps.select("rep", "sketch"), "rep").select("leaf", "rep", "sketch")
    close = sketched.repartition("leaf").sortWithinPartitions("leaf", "rep").mapInArrow(_bucket_links(tokens, margin), "u long, v long")
    # large leaves: every set with the first one, then what is not in its group yet with all, in blocks
    large_leaves = met.filter(F.col("n") > small)
    sketches = reps.select("rep", "sketch")
    first_ones = large_leaves.filter("rep = least").select("leaf", "least").join(sketches.withColumnRenamed("sketch", "first_sketch"), F.col("least") == F.col("rep")).select("leaf", "least", "first_sketch")
    beside = large_leaves.filter("rep <> least").select("leaf", "rep").join(sketches, "rep").join(first_ones, "leaf").select("rep", "sketch", "least", "first_sketch")
    seen = beside.mapInArrow(_alike_first(tokens, margin), "u long, v long").distinct()
    so_far = stage(connected_components(close.unionByName(seen)), "jaccard-groups")
    in_group = large_leaves.select("leaf", "rep", "least").join(so_far.withColumnRenamed("vertex", "rep"), "rep", "left").join(so_far.select(F.col("vertex").alias("least"), F.col("component").alias("of_least")), "least", "left")
    crowd = stage(in_group.select("leaf", "rep", (F.coalesce("component", "rep") != F.coalesce("of_least", "least")).alias("apart")), "jaccard-crowds")
    cuts = crowd.groupBy("leaf").agg(F.ceil(F.count_if("apart") / block).cast("int").alias("n_i"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_j")).filter("n_i > 0")
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cornered = crowd.join(cuts, "leaf")
    sides = cornered.filter("apart").select("leaf", spot("n_i").alias("i"), over("n_j").alias("j"), F.lit(0).alias("side"), "rep").unionByName(cornered.select("leaf", over("n_i").alias("i"), spot("n_j").alias("j"), F.lit(1).alias("side"), "rep"))
    met_late = sides.join(sketches, "rep").select("leaf", "i", "j", "side", "rep", "sketch").repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "side", "rep").mapInArrow(_block_links(tokens, margin), "u long, v long")
    late = stage(met_late, "jaccard-late")
    if not late.isEmpty():
        so_far = stage(connected_components(late.unionByName(so_far.select(F.col("vertex").alias("u"), F.col("component").alias("v")))), "jaccard-groups")
    groups = so_far.select(F.col("vertex").alias("rep"), F.col("component").alias("grp"))

    # exact comparison: groups of more than `block` sets, or of more n-grams than a block holds, as pairs of blocks
    by_count, by_size = F.count(F.lit(1)) / block, F.sum("size") / _BLOCK_GRAMS
    parts = groups.join(reps.select("rep", "size"), "rep").groupBy("grp").agg(F.ceil(F.greatest(by_count, by_size)).cast("int").alias("parts"))
    placed = groups.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    chosen = reps.select("rep", "copies", "s1", "s2", F.col("first.doc").alias("least")).join(placed, "rep")
    # the rows of a document may hold several texts; each set goes to the text with its fingerprint
    texts = known.join(chosen.select("least").distinct(), F.col("doc") == F.col("least"), "left_semi")
    sets = texts.mapInArrow(_sets(width), "s1 long, s2 long, grams binary").groupBy("s1", "s2").agg(F.first("grams").alias("grams"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j"), (q < F.col("part")).cast("int").alias("side")))
    dealt = chosen.join(sets, ["s1", "s2"]).select("grp", F.explode(pairs).alias("p"), "rep", "copies", "grams").select("grp", "p.i", "p.j", "p.side", "rep", "copies", "grams")
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "rep")
    found = stage(dealt.mapInArrow(_verify(threshold), "rep long, links long, target long"), "jaccard-links")

    members = stage(connected_components(found.select(F.col("rep").alias("u"), F.col("target").alias("v"))).select(F.col("vertex").alias("rep"), "component"), "jaccard-members")
    return profile, reps, found.groupBy("rep").agg(F.sum("links").alias("links")), members


def join_similar(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9995, small: int = 64, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id and n_links of every document.

    n_links: how many other documents have a Jaccard similarity >= threshold of word n-gram sets, equal
    texts included. class_id: the least id of the documents that links join, directly or through others.
    Words are runs of characters other than ASCII white space; a text of fewer than `width` words has
    one n-gram. Texts without words (null, empty, blank) are copies of each other and of nothing else.
    Rows with a null id take no part in classes of others: they get a null class and no links. Every row
    stands for itself: equal rows count as copies of each other, and rows with one id and different
    texts each have the class and links of their text (classes that share their least id share class_id).
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    known = plain.filter("doc is not null").withColumn("key", text_key(F.col("text")))
    profile, reps, links, members = _linked(known, threshold, width, recall, small, block)
    firsts = members.join(reps.select("rep", "first"), "rep").groupBy("component").agg(F.min("first.doc").alias("class_of"))
    classes = members.join(firsts, "component").select("rep", "class_of")
    named = reps.select("s1", "s2", "rep", "copies", "first").join(links, "rep", "left").join(classes, "rep", "left")
    named = named.select("s1", "s2", F.coalesce("class_of", "first.doc").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = profile.select("doc", "s1", "s2").join(named, ["s1", "s2"]).select(F.col("doc").alias(id_col), "class_id", "n_links")
    nameless = plain.filter("doc is null").select(F.col("doc").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def first_of_each(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9995, small: int = 64, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and key (text_key) of one row of each class of join_similar(): the least; null ids are left out."""
    known = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("key")).filter("doc is not null")
    _, reps, _, members = _linked(known, threshold, width, recall, small, block)
    linked = reps.select("rep", "first").join(members, "rep")
    alone = reps.select("rep", "first").join(members, "rep", "left_anti").select("first.doc", "first.key")
    return alone.unionByName(linked.groupBy("component").agg(F.min("first").alias("first")).select("first.doc", "first.key"))
