"""Words and word shingles of many texts at once, hashed in numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for n positions or more; those of one size are kept, unless a long text needed it."""
    size = 1 << max(16, (n - 1).bit_length())
    kept = max(_powers, default=0)
    if kept >= size:
        return _powers[kept]
    both = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.empty(size, np.uint64)
        p[0], done = 1, 1
        while done < size:
            p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        both.append(p)
    if size <= 1 << 22:
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return both[0], both[1]


#: Words as runs without ASCII spaces, and as runs of ASCII letters, digits and bytes beyond ASCII.
SPACED = ~_SPACE
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True


def spans_and_sums(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end of the words of all texts, put end to end and lower-cased, running sums that give any stretch's hash, inverse powers, and the text of each word."""
    raw = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    within = np.concatenate([[False], inside[raw], [False]])
    edge = np.flatnonzero(within[1:] != within[:-1])
    start, end = edge[0::2], edge[1::2]
    power, inverse = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return start, end, total, inverse, np.searchsorted(bounds, start, side="right")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, lower-cased and split at ASCII spaces, and the text each belongs to."""
    start, end, total, inverse, owner = spans_and_sums(texts, SPACED)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), owner


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of n words; a text of fewer words, but not none, has one of all its words."""
    word, owner = word_hashes(texts)
    if len(word) == 0:
        return word, owner
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    rank = np.arange(len(word)) - first[owner]
    left = count[owner] - rank  # words from here to the text's end
    take = np.flatnonzero((left >= n) | (rank == 0))
    acc = np.zeros(len(take), np.uint64)
    for k in range(n):
        there = left[take] > k
        nxt = word[np.minimum(take + k, len(word) - 1)]
        acc = np.where(there, mix(acc * np.uint64(0xA0761D6478BD642F) + nxt), acc)
    return acc, owner[take]
