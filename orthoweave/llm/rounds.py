"""Byte-level BPE by rounds over padded matrices, with ranks as the tiktoken library reads them.

1. Split: the words are the matches of the split pattern (array rules over character classes, see bpe.py).
2. Words that are a token stand for it. The other distinct words of a batch are put, by length, into
   padded matrices, one row a word, one cell a byte at first.
3. In every round each row merges its leftmost pair of least rank; the pairs of all rows are looked up
   at once in a hash table (open addressing, linear probes) and the cells behind a merge move up. A row
   without a pair that merges is done and leaves its matrix, and a matrix that has become mostly
   padding gives its empty columns back.
   In words beyond 512 bytes a round merges the pairs of the least rank from left to right, up to the
   first whose new neighbours make a pair of a rank as low; that is what single merges would do.

Two tokens merge if their bytes together are a token; its id is its rank.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SpeculativeBPE
from .vectors import chunks, mix

_NEVER = np.int64(1 << 40)
#: rows of longer words merge several pairs of one rank in a round
_LONG = 512
#: upper ends of the classes of word length; beyond them they double
_WIDTHS = (4, 6, 8, 11, 15, 20, 28, 40, 64, 100, 160, 300, _LONG)
#: cells of a matrix
_CELLS = 1 << 20


class PairTable:
    """Ranks of pairs of ids by open addressing: slot by a hash of both ids, next slots while others are there."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NEVER, dtype=np.int64)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, waiting = self._slots(key), np.arange(len(key))
        while len(waiting):
            free = self.keys[slot[waiting]] == -1
            at = waiting[free]
            # of the keys that want one free slot the last written stays; the others go on
            self.keys[slot[at]] = key[at]
            settled = self.keys[slot[waiting]] == key[waiting]
            self.values[slot[waiting[settled]]] = rank[waiting[settled]]
            waiting = waiting[~settled]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NEVER where the two don't merge or one is -1 (padding)."""
        out = np.full(left.shape, _NEVER, dtype=np.int64)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left.ravel()[real].astype(np.int64) << 32) | right.ravel()[real]
        slot = self._slots(key)
        flat = out.reshape(-1)
        while len(real):
            here = self.keys[slot]
            hit = here == key
            flat[real[hit]] = self.values[slot[hit]]
            on = ~hit & (here != -1)
            real, key, slot = real[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class RoundBPE(SpeculativeBPE):
    """Encoder and decoder for a file of ranks: base64 of the bytes and the rank on each line.

    Splitting and the memo of words are those of the other encoder; words are encoded by rounds.
    """

    def __init__(self, path: str, memo_words: int = 500_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, r in self.rank.items():
            self.tokens[r] = token
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        left, right, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)
        lengths = np.fromiter(map(len, self.tokens), dtype=np.int64, count=size)
        self.token_data = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.token_from, self.token_len = np.cumsum(lengths) - lengths, lengths
        self.special, self.split_special = {}, None
        self.memo_words = memo_words
        self._clear()

    # -- merging --------------------------------------------------------------------------------

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by rounds of merges."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width_of = np.array(_WIDTHS, dtype=np.int64)
        longest = int(lengths.max(initial=0))
        while width_of[-1] < longest:
            width_of = np.append(width_of, 2 * width_of[-1])
        by_class = np.searchsorted(width_of, lengths)
        for c in np.unique(by_class).tolist():
            rows, width = np.flatnonzero((by_class == c) & (lengths > 0)), int(width_of[c])
            step = max(1, _CELLS // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                padded = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), dtype=np.uint8).reshape(len(part), width)
                ids = np.where(np.arange(width)[None, :] < lengths[part, None], self.byte_ids[padded], -1)
                rounds = self._rounds_at_once if width > _LONG else self._rounds
                for i, found in zip(part.tolist(), rounds(ids), strict=True):
                    out[i] = found
        return out

    def _rounds(self, ids: np.ndarray) -> list[np.ndarray]:
        """One merge a row and round."""
        n, width = ids.shape
        done: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n
        live = np.arange(n)
        ids = np.concatenate((ids, np.full((n, 1), -1, dtype=np.int64)), axis=1)  # a spare column: each cell has one behind it
        ranks = np.concatenate((self.pairs.ranks(ids[:, :-1], ids[:, 1:]), np.full((n, 1), _NEVER)), axis=1)
        while True:
            best = ranks.argmin(axis=1)  # the leftmost of the least
            value = ranks[np.arange(len(live)), best]
            ended = value >= _NEVER
            if ended.any():
                for i, row in zip(live[ended].tolist(), ids[ended], strict=True):
                    done[i] = row[row >= 0]
                live, ids, ranks, best, value = live[~ended], ids[~ended], ranks[~ended], best[~ended], value[~ended]
            if not len(live):
                return done
            # compaction: cells behind the merged pair move up by one, and columns empty in all rows go
            columns = np.arange(ids.shape[1])
            source = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ids[:, -1], ranks[:, -1] = -1, _NEVER
            used = int((ids >= 0).sum(axis=1).max()) + 1
            if 4 * used <= 3 * ids.shape[1]:
                ids, ranks = np.ascontiguousarray(ids[:, :used]), np.ascontiguousarray(ranks[:, :used])
            rows = np.arange(len(live))
            ids[rows, best] = value
            last = ids.shape[1] - 1
            after = ids[rows, np.minimum(best + 1, last)]
            before = np.where(best > 0, ids[rows, np.maximum(best - 1, 0)], -1)
            both = self.pairs.ranks(np.concatenate((value, before)), np.concatenate((after, value)))
            ranks[rows, best] = both[: len(live)]
            inner = best > 0
            ranks[rows[inner], best[inner] - 1] = both[len(live) :][inner]

    def _rounds_at_once(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of long words, one after the other; a round goes on through the pairs of the least rank, from left to right.

        It ends with the first merge that makes a pair of the same or a lower rank: up to there single
        merges of the leftmost least pair do the same.
        """
        done = []
        for row in ids:
            row = row[row >= 0]
            ranks = self.pairs.ranks(row[:-1], row[1:])
            while len(ranks) and (least := int(ranks.min())) < _NEVER:
                at = np.flatnonzero(ranks == least)
                # of pairs that share a cell the first, third, ... of each run merge
                run = np.concatenate(([True], np.diff(at) != 1))
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
                # neighbours of each new token when it is made: the cell behind is as it was, the one before may be new
                joined = np.concatenate(([False], at[1:] == at[:-1] + 2))
                before = np.where(at > 0, row[np.maximum(at - 1, 0)], -1)
                before[joined] = least
                after = np.where(at + 2 < len(row), row[np.minimum(at + 2, len(row) - 1)], -1)
                token = np.full(len(at), least)
                low = np.flatnonzero((self.pairs.ranks(before, token) <= least) | (self.pairs.ranks(token, after) <= least))
                if len(low):
                    at = at[: low[0] + 1]
                row[at] = least
                keep = np.ones(len(row), dtype=bool)
                keep[at + 1] = False
                row = row[keep]
                ranks = np.append(ranks, _NEVER)[keep][: len(row) - 1]
                fresh = at - np.arange(len(at))  # places of the new tokens
                touched = np.concatenate((fresh, fresh - 1))
                touched = touched[(touched >= 0) & (touched < len(row) - 1)]
                ranks[touched] = self.pairs.ranks(row[touched], row[touched + 1])
            done.append(row)
        return done

    # -- whole texts ----------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words: those that are a token stand for it, the others are merged."""
        whole = [self.rank.get(w) for w in words]
        merged = iter(self.merge_words([w for w, r in zip(words, whole, strict=True) if r is None]))
        return [next(merged).tolist() if r is None else [r] for r in whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered token by token."""
        n = self.token_len[ids]
        past = np.cumsum(n)
        return self.token_data[np.arange(int(past[-1]) if len(n) else 0) + np.repeat(self.token_from[ids] - (past - n), n)].tobytes()


_loaded: dict[str, RoundBPE] = {}


def load(path: str) -> RoundBPE:
    """The encoder of a file, built once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = RoundBPE(path)
    return _loaded[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode_decode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded binary: the bytes of those ids.

    Each match of the split pattern is encoded separately and without special tokens, as the tiktoken
    library does. Null and empty texts give no ids and no bytes; each row stands for itself, so repeated
    rows and null or repeated ids are kept; other columns are not read. There is no shuffle: a task holds
    one Arrow batch at a time and the texts of a chunk of it.
    """

    def run(batches):
        coder = load(ranks or default_ranks())  # each machine has its own place for the file
        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks(texts.to_pylist(), 1 << 21):
                ids = coder.encode(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(list(map(len, ids)), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of what encode_decode returns."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
