"""Word-shingle sets of whole texts as 64-bit hashes, vectorised over many texts.

A-Z are lower-cased and words are runs without the six ASCII separators (U+0009 to U+000D, U+0020), so all
work is on UTF-8 bytes. A word's hash is a sum of its bytes times pseudo-random odd numbers by position,
a shingle's a mix of its words' hashes. Sets are compared by these hashes: that two of n different
shingles of two texts fall together has odds of about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """``count`` pseudo-random odd 64-bit numbers, the same everywhere."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = odd_numbers(4096, 11)
_ORDER = odd_numbers(64, 23)


def _word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words that lie one behind the other in ``data``, without anything between."""
    global _PLACES
    if len(lengths) and lengths.max() > len(_PLACES):
        _PLACES = odd_numbers(int(lengths.max()), 11)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    value = _PLACES[place] * (data.astype(np.uint64) + np.uint64(1))
    return mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts one behind the other, and how many each text has."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.concatenate([[False], ~gap, [False]])
    first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    lengths = last - first
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
    hashes = _word_hashes(data[~gap], starts, lengths)
    # How many words stand before the end of each text.
    sizes = np.asarray([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    ends = np.searchsorted(first, np.cumsum(sizes))
    return hashes, np.diff(np.concatenate([[0], ends])).astype(np.int64)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, a text without words none."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    count = max(0, len(hashes) - words + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(words):
        rolled += mixed(hashes[k : k + count] * _ORDER[k])
    rolled = mixed(rolled + np.uint64(words))
    out = []
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        if end - begin >= words:
            out.append(np.unique(rolled[begin : end - words + 1]))
        elif end > begin:
            few = hashes[begin:end] * _ORDER[: end - begin]
            out.append(mixed(np.asarray([mixed(few).sum(dtype=np.uint64) + np.uint64(end - begin)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
