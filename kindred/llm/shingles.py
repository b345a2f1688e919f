"""Shingle sets and their min-max signatures, in numpy."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
from xxhash import xxh64_intdigest

from kindred.llm.words import LOWER, UPPER, WORD

RECENT_WORDS = 1 << 17
TO_LOWER = str.maketrans(UPPER, LOWER)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def scatter(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * MIX[0]
    values = (values ^ (values >> np.uint64(27))) * MIX[1]
    return values ^ (values >> np.uint64(31))


class _Recent(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= RECENT_WORDS:
            self.clear()
        number = self[word] = xxh64_intdigest(word)
        return number


class Shingler:
    """Sets of hashed shingles of ``size`` words, and signatures of such sets.

    Each permutation is one multiplication; both its minimum and its maximum are kept, so
    ``bands * 4`` values need ``bands * 2`` hash evaluations. A band is the minima and maxima of
    two permutations.
    """

    def __init__(self, size: int, bands: int, seed: int = 11):
        self.size, self.bands = size, bands
        self.words_of, self.known = re.compile(WORD).findall, _Recent()
        draw = np.random.default_rng(seed)
        self.factors = draw.integers(1 << 62, 1 << 63, 2 * bands, dtype=np.uint64) | np.uint64(1)

    def words(self, text: str) -> list[str]:
        return self.words_of(text.translate(TO_LOWER))

    @staticmethod
    def digest(words: list[str]) -> tuple[int, int]:
        """128 bits of the word sequence as two signed numbers."""
        found = blake2b(" ".join(words).encode(errors="surrogatepass"), digest_size=16).digest()
        return tuple(np.frombuffer(found, np.int64).tolist())

    def set_of(self, words: list[str]) -> np.ndarray:
        """Distinct hashes, sorted; a shorter text is one shingle, no words are none."""
        if not words:
            return np.zeros(0, np.uint64)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        total = np.full(len(words) - size + 1, size, np.uint64)
        for step in range(size):
            total = total * FACTOR + numbers[step : step + len(total)]
        return np.unique(scatter(total))

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        """One signed 64-bit hash per band."""
        ends = np.empty((2 * self.bands, 2), np.uint64)
        for row, factor in zip(ends, self.factors):
            permuted = shingles * factor
            row[0], row[1] = permuted.min(), permuted.max()
        values = scatter(ends).reshape(self.bands, 4)
        total = np.arange(self.bands, dtype=np.uint64)
        for column in values.T:
            total = scatter(total * FACTOR + column)
        return total.view(np.int64)
