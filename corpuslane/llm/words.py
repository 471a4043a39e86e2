"""Words, their 64-bit values, and flat batches of them; shared by the operators of this package."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}]+")
FORMAT_CHARACTERS = regex.compile(r"\p{Cf}+")
#: Odd 64-bit multipliers for positions in a window, made from one seed.
MULTIPLIERS = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def folded_words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC, removal of format characters and lower-casing."""
    if not text.isascii():
        text = FORMAT_CHARACTERS.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())


class WordValues:
    """Word -> 64-bit value, the same in every process. The cache is emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        self.cache, self.most = {}, most

    def __call__(self, words: list[str]) -> list[int]:
        cache = self.cache
        try:
            return [cache[w] for w in words]
        except KeyError:
            if len(cache) > self.most:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            return [cache[w] for w in words]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), for values whose bits are to be spread."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def windows(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` values inside each text of a flat batch, and the number of runs of each text."""
    runs = np.maximum(lengths - size + 1, 0)
    if len(values) < size:
        return np.zeros(0, np.uint64), runs
    h = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        h += values[k : k + len(h)] * MULTIPLIERS[k]
    starts = np.cumsum(lengths) - lengths
    keep = np.ones(len(values), bool)
    for k in range(1, size):  # the last size-1 places of a text begin no run of it
        ends = (starts + lengths - k)[lengths >= k]
        keep[ends] = False
    return mixed(h[keep[: len(h)]]), runs
