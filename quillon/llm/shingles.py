"""Sets of hashed shingles, and MinHash signatures of them: circulant ones and plain ones."""

from __future__ import annotations

import numpy as np
import xxhash


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply steps)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def mixed_short(x: np.ndarray) -> np.ndarray:
    """The same for 32-bit numbers."""
    x = x.astype(np.uint32, copy=True)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return x ^ (x >> np.uint32(16))


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    MEMO = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_shingles(text: str | None, words: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text.

    A-Z are lower-cased; words are what ASCII white space delimits. A text with fewer words is one shingle, one without
    words has none.
    """
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = len(h) - k + 1
    if n < 1:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + x)
        return out
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


def char_shingles(lines: list[str], k: int = 5, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of k characters of each line, repeats kept, and the line that each is of.

    A line of fewer characters is one stretch, filled up with what is no character. ``short`` hashes have 32 bits, which
    take a third of the time and are all that a ``MinHash`` looks at.
    """
    # A lone surrogate stands in no text, so it can fill up short lines.
    lines = [x if len(x) >= k else x.ljust(k, "\ud800") for x in lines]
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32 if short else np.uint64)
    factor = codes.dtype.type(0x9E3779B1 if short else 0x9E3779B97F4A7C15)
    out = codes.copy()
    for i in range(1, k):  # a polynomial of the codes, whose bits are spread below
        out *= factor
        out[: len(out) - i] += codes[i:]
    inside = np.ones(len(out), bool)
    for i in range(1, k):
        inside[ends - i] = False
    return (mixed_short if short else mixed)(out[inside]), np.repeat(np.arange(len(lines), dtype=np.int32), sizes - k + 1)


class CirculantMinHash:
    """Two permutations of D positions give all coordinates of a signature.

    The first scatters the elements, the second ranks them; coordinate j ranks with the second permutation shifted by
    j places round the circle. The ranks of one element in all coordinates are thus neighbours in one array.
    """

    def __init__(self, coordinates: int, bits: int = 20, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        size = 1 << bits
        self.k, self.mask = coordinates, np.uint64(size - 1)
        self.scatter = rng.permutation(size).astype(np.uint32)
        rank = rng.permutation(size).astype(np.uint32)
        circle = np.concatenate([rank, rank[: coordinates - 1]])
        self.rows = np.lib.stride_tricks.sliding_window_view(circle, coordinates)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of coordinates for each set; those of an empty set are all the largest number."""
        elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return self.of(elements, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))

    def of(self, elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """A row of coordinates for each of n sets: owner tells an element's set and does not fall."""
        out = np.full((n, self.k), np.iinfo(np.uint32).max, np.uint32)
        step = max(256, (1 << 20) // self.k)
        at = self.scatter[(elements & self.mask).astype(np.int64)]
        for i in range(0, len(at), step):
            own = owner[i : i + step]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            low = np.minimum.reduceat(self.rows[at[i : i + step]], starts, axis=0)
            out[own[starts]] = np.minimum(out[own[starts]], low)
        return out


class MinHash:
    """Each coordinate ranks hashed elements by the product of an odd number of its own and their lower 32 bits.

    The ranks of a coordinate for many sets are one array, so a coordinate is two passes of whole-array arithmetic.
    """

    #: Elements that are ranked together, so that they stay in the processor's cache.
    TOGETHER = 1 << 16

    def __init__(self, coordinates: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 32, coordinates, dtype=np.uint32) | np.uint32(1)

    def of(self, elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """A row of coordinates for each of n sets: owner tells an element's set and does not fall."""
        out = np.full((n, len(self.factor)), np.iinfo(np.uint32).max, np.uint32)
        low = elements.astype(np.uint32)
        for i in range(0, len(low), self.TOGETHER):
            part, own = low[i : i + self.TOGETHER], owner[i : i + self.TOGETHER]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rank, least = np.empty_like(part), np.empty((len(self.factor), len(starts)), np.uint32)
            for factor, row in zip(self.factor, least, strict=True):
                np.multiply(part, factor, out=rank)
                np.minimum.reduceat(rank, starts, out=row)
            out[own[starts]] = np.minimum(out[own[starts]], least.T)
        return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; keys of different bands differ."""
    n, k = signatures.shape
    parts = signatures[:, : k // rows * rows].reshape(n, k // rows, rows).astype(np.uint64)
    key = np.tile(np.arange(k // rows, dtype=np.uint64), (n, 1))
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def digest(elements: np.ndarray) -> bytes:
    """16 bytes that tell sets apart; the elements are sorted."""
    return xxhash.xxh3_128_digest(elements.tobytes())
