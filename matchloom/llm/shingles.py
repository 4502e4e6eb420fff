"""Bags of word shingles as sorted 64-bit hashes with counts, for batches of texts at once.

Words are runs of `[^\\x20\\x09-\\x0D]` in lower case. A text of one to four words has one shingle, of all its words;
a null or blank text has none.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalise(text: str | None) -> bytes:
    """Lower-case words with single blanks between."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step up to n and their inverses, kept between batches."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.full(2 * n, base, np.uint64)) for base in (_STEP, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word of normalised texts, in order.

    A word's hash is its bytes as a polynomial in the step, from differences of one running sum.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _power(len(data) + 1)
    space = data == 32
    ends = np.flatnonzero(space)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, side="right")
    real = ends > starts  # an empty text leaves an empty word
    return hashes[real], owner[real]


def bags(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), once per text and shingle, ordered by text number."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - first[owner]
    width = np.minimum(counts, size)[owner]  # of the windows of each word's text
    opens = place + width <= counts[owner]
    at = np.flatnonzero(opens & (width > 0))
    total = np.zeros(len(at), np.uint64)
    steps = np.arange(1, size + 1, dtype=np.uint64) * _STEP
    for k in range(size):
        inside = width[at] > k
        step = mix(words[np.minimum(at + k, max(len(words) - 1, 0))] + steps[k])
        total = total * np.uint64(0xD1342543DE82EF95) + np.where(inside, step, np.uint64(k))
    shingle, text = mix(total), owner[at]
    both = shingle + mix(text.astype(np.uint64) + _STEP)  # one key for (text, shingle)
    _, index, n = np.unique(both, return_index=True, return_counts=True)
    order = np.lexsort((shingle[index], text[index]))
    index = index[order]
    return text[index], shingle[index], n[order]


def bag(text: bytes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, counts) of one normalised text."""
    _, hashes, counts = bags([text], size)
    return hashes, counts


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags: sum of least counts over sum of greatest."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
