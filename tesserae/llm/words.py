"""Word and shingle hashes of whole texts, computed over arrays of bytes inside tasks.

Texts arrive as UTF-8 bytes. `bytes.lower` changes A-Z only. A word's hash is a polynomial over random
64-bit values of its bytes, read off a running sum, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; arrays of 64-bit values of this length stay small.
PIECE = 1 << 18
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of words: all but space and \t..\r, or all but ASCII other than letters and digits.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        if size > 2 * PIECE:
            return tuple(np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, _INVERSE))
        _powers[size] = tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE))
    return tuple(p[:n] for p in _powers[size])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = is_word[raw]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(text: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of text, in order; texts beyond PIECE are cut between words."""
    hashes, firsts, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and is_word[text[end]]:
            end += 1
        raw = np.frombuffer(text[at:end].lower(), np.uint8)
        first, last = _spans(raw, is_word)
        if len(first):
            power, inverse = _power(len(raw))
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUE[raw] * power, out=total[1:])
            hashes.append(mix((total[last] - total[first]) * inverse[first]))
            firsts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each place where k words stand in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + n]
    return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence that is shorter than a shingle."""
    return mix(grams(words, len(words)) + np.uint64(len(words)))


def batch_words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the n + 1 places where texts begin in it."""
    joined = b"\n".join(texts)
    hashes, firsts = word_hashes(joined, is_word)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return hashes, np.searchsorted(firsts, edges)


def parcels(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of about size bytes of text each (one row at least), with their texts; null is empty."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(column):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at), [t or b"" for t in column.slice(at, to - at).to_pylist()]
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Memory:
    """What was found for strings met before, in two generations: when the younger one is full it becomes the older, so
    what keeps coming up stays. The size bounds memory only; what isn't here is found again."""

    def __init__(self, entries: int = 200_000, characters: int = 8_000_000):
        self.entries, self.characters = entries, characters
        self.young, self.old, self.held = {}, {}, 0

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.entries or self.held > self.characters:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += len(key)

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those that aren't known; known ones move to the younger generation."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out
