"""Word shingles of a text as sorted distinct 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task remembers; a worker keeps them for the tasks that follow, other operators' too.
_KNOWN = 50_000
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Five words at a time, A-Z in lower case; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at ASCII space only
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < 5:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    x = h[: n - 4] * _FACTORS[0]
    for i in range(1, 5):
        x += h[i : n - 4 + i] * _FACTORS[i]
    return np.unique(mixed(x))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))
