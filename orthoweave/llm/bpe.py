"""Byte-level BPE, encoded by speculate and verify.

1. Split: the GPT-2 split pattern, evaluated as array rules over character classes.
2. Speculate: every distinct word gets a greedy longest-match tokenisation.
3. Verify: a tokenisation is the one that the merges give exactly when each adjacent pair of its
   tokens is compatible, that is, when merging the bytes of the two gives these two tokens back.
   All pairs of all new words are looked up at once in a sorted table of pairs already judged.
4. Merge: only words with an incompatible pair go through the merges one by one.

Distinct words are kept with their ids between batches (a memo, emptied when it is full; results
do not depend on it).
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex

from .vectors import byte_span_hashes, chunks

LETTER, NUMBER, SPACE, OTHER, NONE = 1, 2, 3, 0, 4
_NEVER = np.int64(1 << 62)
#: words of at most so many bytes are merged together as rows of a matrix
_SHORT = 32
#: words of at most so many bytes are their own keys
_PLAIN = 7
_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        shift = lambda i: i if i < 0xD800 else i + 0x800
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, every):
                a, b = shift(m.start()), shift(m.end() - 1) + 1
                table[a:b] = value
        table[0xD800:0xE000] = OTHER
        _classes = table
    return _classes


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder and decoder for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, memo_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for k, v in vocab.items():
            self.tokens[v] = k
        for k, v in self.special.items():
            self.tokens[v] = k.encode()
        self.vocab = vocab
        #: longest token that starts with these two bytes: no longer match need be tried
        self.longest: dict[bytes, int] = {}
        for k in vocab:
            self.longest[k[:2]] = max(len(k), self.longest.get(k[:2], 1))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes_ids = [vocab[bytes([b])] for b in range(256)]
        self.byte_table = np.asarray(self.bytes_ids, dtype=np.int64)
        keys = np.fromiter((a * self.size + b for a, b in self.merges), dtype=np.int64, count=len(self.merges))
        order = np.argsort(keys)
        #: sorted pair keys with rank * size + merged id, for lookups of many pairs at once
        self.merge_keys = keys[order]
        self.merge_values = np.fromiter((r * self.size + m for r, m in self.merges.values()), dtype=np.int64, count=len(keys))[order]
        self.decimal = [str(i).encode() for i in range(self.size)]
        self.split_special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: pairs judged so far: key a * size + b, sorted, and the verdicts
        self.pair_keys = np.zeros(0, dtype=np.int64)
        self.pair_ok = np.zeros(0, dtype=bool)
        self.pair_limit = 1 << 20
        self.memo_words = memo_words
        self._clear()

    # -- exact merging ------------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """The merges applied in rank order, leftmost first, with a heap: O(n log n)."""
        ids = [self.bytes_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i] = self.merges[a, b][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (r := self.merges.get((ids[k], ids[i]))):
                heapq.heappush(heap, (r[0], k, ids[k], ids[i]))
        return [i for i in ids if i >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank * size + merged id of each pair; a huge number where the two never merge."""
        keys = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == keys, self.merge_values[at], _NEVER)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: short ones advance together, one merge a round."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(lengths > _SHORT):
            out[i] = self.merge(words[i])
        for low, high in ((0, 8), (8, 12), (12, 18), (18, _SHORT)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(rows):
                done = self._merge_rows(b"".join(words[i].ljust(high, b"\0") for i in rows), lengths[rows], high)
                for i, ids in zip(rows.tolist(), done, strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, padded: bytes, lengths: np.ndarray, width: int) -> list[list[int]]:
        n = len(lengths)
        # one spare column, so that the pair after the last always exists
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width] = self.byte_table[np.frombuffer(padded, dtype=np.uint8)].reshape(n, width)
        columns = np.arange(width + 1)
        ids[columns[None, :] >= lengths[:, None]] = -1
        ranks = np.full((n, width + 1), _NEVER, dtype=np.int64)
        ranks[:, :width] = self._ranks(ids[:, :-1], ids[:, 1:])
        result = np.empty((n, width + 1), dtype=np.int64)
        live = np.arange(n)
        while True:
            best = ranks.argmin(axis=1)
            value = ranks[np.arange(len(live)), best]
            go = value < _NEVER
            if not go.all():
                result[live[~go]] = ids[~go]
                live, ids, ranks, best, value = live[go], ids[go], ranks[go], best[go], value[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            # close the gap of the merged pair
            shift = columns[None, :] + (columns[None, :] > best[:, None])
            np.minimum(shift, width, out=shift)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[:, width] = -1
            ranks = np.take_along_axis(ranks, shift, axis=1)
            ranks[:, width] = _NEVER
            ids[rows, best] = value % self.size
            ranks[rows, best] = self._ranks(ids[rows, best], ids[rows, np.minimum(best + 1, width)])
            left = best > 0
            r, c = rows[left], best[left] - 1
            ranks[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        keep = result >= 0
        flat = result[keep].tolist()
        ends = np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    # -- speculate and verify -----------------------------------------------------------------

    def _greedy(self, word: bytes) -> list[int]:
        get, longest = self.vocab.get, self.longest
        if (whole := get(word)) is not None:
            return [whole]
        out, i, n = [], 0, len(word)
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """For keys a * size + b of adjacent tokens: are they what the merges give for their bytes?"""
        if not len(keys):
            return np.zeros(0, dtype=bool)
        new = np.unique(keys)
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, new), len(self.pair_keys) - 1)
            new = new[self.pair_keys[at] != new]
        if len(new):
            if len(self.pair_keys) > self.pair_limit:  # judged again where they come back
                self.pair_keys, self.pair_ok = self.pair_keys[:0], self.pair_ok[:0]
                new = np.unique(keys)
            pairs = [divmod(k, self.size) for k in new.tolist()]
            merged = self.merge_all([self.tokens[a] + self.tokens[b] for a, b in pairs])
            verdicts = np.fromiter((m == [*p] for m, p in zip(merged, pairs, strict=True)), dtype=bool, count=len(new))
            every = np.concatenate((self.pair_keys, new))
            order = np.argsort(every, kind="stable")
            self.pair_keys, self.pair_ok = every[order], np.concatenate((self.pair_ok, verdicts))[order]
        return self.pair_ok[np.searchsorted(self.pair_keys, keys)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words that the split has made."""
        guess = [self._greedy(w) for w in words]
        counts = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        flat = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(counts.sum()))
        owner = np.repeat(np.arange(len(guess)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ok = self._compatible(flat[inner] * self.size + flat[inner + 1])
        failing = np.unique(owner[inner[~ok]]).tolist()
        for w, ids in zip(failing, self.merge_all([words[w] for w in failing]), strict=True):
            guess[w] = ids
        return guess

    # -- splitting ----------------------------------------------------------------------------

    @staticmethod
    def _starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where words start; points: code points of texts that begin at `firsts`.

        The split pattern tries, at each place: a contraction, then an optional blank with letters,
        with numbers or with other characters, then white space up to the last one before a word.
        """
        n = len(points)
        cls = character_classes()[points]
        begin = np.zeros(n + 1, dtype=bool)
        begin[firsts] = True
        begin[n] = True
        prev = np.empty(n, dtype=np.uint8)
        prev[1:] = cls[:-1]
        prev[begin[:-1]] = NONE
        nxt = np.empty(n, dtype=np.uint8)
        nxt[:-1] = cls[1:]
        nxt[begin[1:]] = NONE
        blank = points == 0x20
        after_blank = np.zeros(n, dtype=bool)
        after_blank[1:] = blank[:-1]
        after_blank &= prev == SPACE
        space = cls == SPACE
        start = np.where(space, (prev != SPACE) | ((nxt != SPACE) & (nxt != NONE)), (prev != cls) & ~after_blank)
        quote = np.flatnonzero((points == 0x27) & start & (nxt == LETTER))
        if len(quote):
            padded = np.concatenate((points, np.zeros(3, dtype=points.dtype)))
            a, b = padded[quote + 1], padded[quote + 2]
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = ~two & ~begin[np.minimum(quote + 2, n)] & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
            for q, length in ((quote[two], 2), (quote[three], 3)):
                start[q + 1] = False
                end = q + length
                end = end[end < n]
                end = end[(cls[end] == LETTER) & ~begin[end]]
                start[end] = True
        return start

    def _clear(self) -> None:
        self.memo: dict[int, int] = {}
        #: the bytes of every word kept, to be compared whenever its hash is met
        self.memo_data, self.memo_used = np.zeros(1 << 14, dtype=np.uint8), 0
        self.memo_from, self.memo_len = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.memo_at = np.zeros(1 << 12, dtype=np.int64)
        self.memo_n = np.zeros(1 << 12, dtype=np.int64)
        self.flat = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def _remember(self, keys: list[int], words: list[bytes], encoded: list[list[int]]) -> None:
        def grown(a: np.ndarray, n: int) -> np.ndarray:
            return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)))

        base = len(self.memo)
        counts = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        total = int(counts.sum())
        self.memo_at, self.memo_n = grown(self.memo_at, base + len(keys)), grown(self.memo_n, base + len(keys))
        self.flat = grown(self.flat, self.used + total)
        self.memo_n[base : base + len(keys)] = counts
        self.memo_at[base : base + len(keys)] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + total] = np.fromiter((t for e in encoded for t in e), dtype=np.int32, count=total)
        self.used += total
        self.memo.update(zip(keys, range(base, base + len(keys)), strict=True))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        size = int(lengths.sum())
        self.memo_from, self.memo_len = grown(self.memo_from, base + len(keys)), grown(self.memo_len, base + len(keys))
        self.memo_data = grown(self.memo_data, self.memo_used + size)
        self.memo_len[base : base + len(keys)] = lengths
        self.memo_from[base : base + len(keys)] = self.memo_used + np.cumsum(lengths) - lengths
        self.memo_data[self.memo_used : self.memo_used + size] = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.memo_used += size

    @staticmethod
    def _same(data: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, other_at: np.ndarray, other_n: np.ndarray) -> bool:
        """Are data[at:at + n] and other[other_at:other_at + other_n] the same bytes, for all of them?"""
        if (n != other_n).any():
            return False
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return bool((data[np.repeat(at, n) + inside] == other[np.repeat(other_at, n) + inside]).all())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32 arrays) of each text, as the tokenizers library gives them; null counts as empty."""
        out: list[np.ndarray] = []
        for a, b in chunks(texts):
            out += self._encode([t or "" for t in texts[a:b]])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > self.memo_words:
            self._clear()
        parts, of_text, is_special = texts, None, None
        if self.split_special and any(s in t for t in texts for s in self.special):
            parts, of_text, is_special = [], [], []
            for i, t in enumerate(texts):
                for p in self.split_special.splititer(t) if self.split_special.search(t) else (t,):
                    if p:
                        parts.append(p)
                        of_text.append(i)
                        is_special.append(p in self.special)
        text = "".join(parts)
        if not text:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        firsts = np.cumsum(lengths) - lengths
        full = lengths > 0
        start = self._starts(points, firsts[full])
        if is_special and any(is_special):
            for k in np.flatnonzero(is_special):
                start[firsts[k] : firsts[k] + lengths[k]] = False
                start[firsts[k]] = True
        words = np.flatnonzero(start)
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, dtype=np.uint8)
        if len(data) == len(points):
            at = words
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(width) - width)[words]
        ends = np.append(at[1:], len(data))
        special = {} if not is_special else self.special
        ids, past = self._known(raw, data, at, ends, special) or self._by_bytes(raw, at, ends, special)
        # the words of part i are those from the first that starts at firsts[i]
        edge = np.concatenate((np.searchsorted(words, firsts), [len(words)]))
        bounds = np.concatenate(([0], past))[edge]
        if of_text is None:
            return [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        marks = np.searchsorted(np.asarray(of_text), np.arange(len(texts) + 1))
        return [ids[bounds[marks[i]] : bounds[marks[i + 1]]] for i in range(len(texts))]

    def _new(self, words: list[bytes], special: dict[str, int]) -> list[list[int]]:
        encoded = self.encode_words(words)
        return [[special[s]] if special and (s := w.decode("utf-8", "replace")) in special else e for w, e in zip(words, encoded, strict=True)]

    @staticmethod
    def _keys(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit key of each word, and which of them are hashes: up to 7 bytes are a key as they are."""
        eight = np.ndarray(shape=(len(data),), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, dtype=np.uint8))), strides=(1,))
        short = np.minimum(n, _PLAIN).astype(np.uint64) << np.uint64(3)
        keys = (eight[at] & ((np.uint64(1) << short) - np.uint64(1))) | (n.astype(np.uint64) << np.uint64(56))
        hashed = np.flatnonzero(n > _PLAIN)
        if len(hashed):
            size = n[hashed]
            past = np.cumsum(size)
            inside = np.repeat(at[hashed] - (past - size), size) + np.arange(int(past[-1]))
            keys[hashed] = byte_span_hashes(data[inside], past - size, past) | np.uint64(1 << 63)
        return keys, hashed

    def _known(self, raw: bytes, data: np.ndarray, at: np.ndarray, ends: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the words of a batch, and how many there are up to each word, by keys.

        Every hashed word is compared byte by byte with the one that stands for its key, in the batch
        and in the memo; None if two words share a key.
        """
        n = ends - at
        by_word, checked = self._keys(data, at, n)
        keys, first, inverse = np.unique(by_word, return_index=True, return_inverse=True)
        lead = first[inverse[checked]]
        if not self._same(data, at[checked], n[checked], data, at[lead], n[lead]):
            return None
        memo, key_list = self.memo, keys.tolist()
        index = np.fromiter((memo.get(k, -1) for k in key_list), dtype=np.int64, count=len(key_list))
        hit = np.flatnonzero((index >= 0) & (n[first] > _PLAIN))
        if not self._same(data, at[first[hit]], n[first[hit]], self.memo_data, self.memo_from[index[hit]], self.memo_len[index[hit]]):
            return None
        missing = np.flatnonzero(index < 0)
        if len(missing):
            spans = [raw[at[first[i]] : ends[first[i]]] for i in missing]
            base = len(memo)
            self._remember([key_list[i] for i in missing], spans, self._new(spans, special))
            index[missing] = np.arange(base, base + len(missing))
        of_word = index[inverse]
        counts = self.memo_n[of_word]
        past = np.cumsum(counts)
        return self.flat[np.arange(int(past[-1])) + np.repeat(self.memo_at[of_word] - (past - counts), counts)], past

    def _by_bytes(self, raw: bytes, at: np.ndarray, ends: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """As _known, by the words themselves."""
        words = [raw[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self._new(distinct, special), strict=True))
        past = np.cumsum([len(ids[w]) for w in words])
        return np.fromiter((t for w in words for t in ids[w]), dtype=np.int32, count=int(past[-1])), past

    # -- decoding -----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def ids_sha256(self, ids: np.ndarray) -> str:
        """Lower-case hex digest of the decimal ids joined by commas."""
        return hashlib.sha256(b",".join(map(self.decimal.__getitem__, ids.tolist()))).hexdigest()


_loaded: dict[str, SpeculativeBPE] = {}


def load(path: str) -> SpeculativeBPE:
    """The encoder of a file, built once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]
