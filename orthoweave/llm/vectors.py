"""Array helpers that run inside Spark tasks: texts as byte arrays, word spans, rolling hashes."""

from __future__ import annotations

import hashlib

import numpy as np

#: words of more bytes are hashed by BLAKE2b, so that the table of multipliers has a fixed size
_LONG_WORD = 4096
_PRIME = (1 << 61) - 1
_P, _M31, _M30 = np.uint64(_PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_ONE, _B30, _B31, _B61 = np.uint64(1), np.uint64(30), np.uint64(31), np.uint64(61)
# Bases of the polynomial hashes of spans of words, drawn once.
_BASES = (0x0D1B54A32D192ED03 % _PRIME, 0x1A0761D6478BD642F % _PRIME)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & _P) + (x >> _B61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of numbers below it, by halves of 30 and 31 bits."""
    au, ad, bu, bd = a >> _B31, a & _M31, b >> _B31, b & _M31
    middle = ad * bu + au * bd
    return _reduced(((au * bu) << _ONE) + (middle >> _B30) + ((middle & _M30) << _B31) + ad * bd)


def _running(x: np.ndarray) -> np.ndarray:
    """0 and the running sums of x modulo 2**61 - 1."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    high = _reduced(np.cumsum(x >> _B31))
    out[1:] = _reduced((((high << _B31) & _P) | (high >> _B30)) + _reduced(np.cumsum(x & _M31)))
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**61 - 1, kept between calls and grown by doubling."""
    for inverse in (0, 1):
        have = _powers.get((base, inverse), np.ones(1, dtype=np.uint64))
        step = base if not inverse else pow(base, -1, _PRIME)
        while len(have) < n:
            have = np.concatenate((have, _times(have, np.uint64(pow(step, len(have), _PRIME)))))
        _powers[base, inverse] = have
    return _powers[base, 0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(n: int, seed: int) -> np.ndarray:
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed))


_BYTE_CODES = [_drawn(256, 0x632BE59BD9B4E019 + k) for k in range(2)]
_PLACE_CODES = [_drawn(_LONG_WORD, 0x2545F4914F6CDD1D + k) for k in range(2)]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of codes[start:end] for all spans at once: a polynomial modulo the prime 2**61 - 1."""
    base = _BASES[which]
    n = len(codes)
    up = powers(base, n + 1)
    sums = _running(_times(_reduced(codes), up[:n]))
    h = _times(_reduced(sums[ends] + (_P - sums[starts])), _powers[base, 1][starts])
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for sorted spans that do not overlap.

    Each place in a span has a multiplier of its own (a multilinear hash), so no pattern of bytes makes
    sums equal; a polynomial modulo 2**64 would take regular words of 512 bytes for each other.
    """
    place = np.zeros(len(data), dtype=np.int64)
    place[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[which][data] * _PLACE_CODES[which][np.minimum(place, _LONG_WORD - 1)], out=sums[1:])
    lengths = ends - starts
    h = mix(sums[ends] - sums[starts] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which]))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def ascii_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside {0x20, 0x09..0x0D}."""
    gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


class Texts:
    """A batch of texts as one byte buffer: words, their document, and their hashes.

    Texts are joined by one space, so that no word spans two texts.
    """

    def __init__(self, texts: list[str | None], hashes: int = 1):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(encoded), dtype=np.uint8)
        lengths = np.fromiter((len(e) for e in encoded), dtype=np.int64, count=len(encoded))
        self.offsets = np.zeros(len(encoded) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.offsets[1:])
        self.starts, self.ends = ascii_words(self.data)
        #: first[i]:first[i + 1] are the words of text i
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = [byte_span_hashes(self.data, self.starts, self.ends, k) for k in range(hashes)]

    def windows(self, width: int, which: int = 0) -> np.ndarray:
        """Hash of words i .. i+width-1 for each i of the whole batch; callers drop those that leave a text."""
        n = max(0, len(self.starts) - width + 1)
        at = np.arange(n)
        return span_hashes(self.hashes[which], at, at + width, which)


def chunks(texts: list[str | None], limit: int = 1 << 20):
    """Ranges (a, b) of a list of texts of about `limit` characters each; a longer text is alone."""
    a, total = 0, 0
    for b, t in enumerate(texts):
        n = len(t or "") + 1
        if total and total + n > limit:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(texts):
        yield a, len(texts)
