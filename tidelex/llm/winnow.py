"""Winnowed anchors of symbol sequences, on numpy arrays.

A sequence is an array of 64-bit symbols. Every window of `t` symbols selects, among its k-grams,
the one with the smallest hash (the last of equals). Equal windows select at equal offsets wherever
they stand, so whoever shares a window shares an anchor: anchors find all common passages of at
least `t` symbols while only about 2 of each t - k + 2 positions are kept.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOCAL = 24  # low bits of a sort key that hold the position inside a stretch
_STRETCH = 1 << 23


class Powers:
    """Powers of the base, grown as sequences need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
                for base in (np.uint64(_BASE), np.uint64(_INVERSE)))


POWERS = Powers()


class Rolling:
    """Hashes of any stretch of a sequence, from prefix sums of symbol * base^position."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        POWERS.upto(n + 1)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * POWERS.up[:n], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        """Hashes of symbols [start, stop), for arrays of starts and stops."""
        start, stop = np.asarray(start), np.asarray(stop)
        return mixed((self.sums[stop] - self.sums[start]) * POWERS.down[start])

    def grams(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:m]) * POWERS.down[:m])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = np.minimum(out[:-more], out[more:])
    return out


def anchors(grams: np.ndarray, width: int,
            counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): each selected gram and the windows of `width` grams that select it,
    as the positions of their first grams. Where sequences stand one after the other, `counts` is
    true for each window that lies inside one of them; the others select nothing."""
    windows = len(grams) - width + 1
    if windows <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    chosen = np.empty(windows, np.int64)
    mask = np.uint64((1 << _LOCAL) - 1)
    for at in range(0, windows, _STRETCH):
        part = grams[at:at + _STRETCH + width - 1]
        place = mask - np.arange(len(part), dtype=np.uint64)
        least = _least((part & ~mask) | place, width)
        chosen[at:at + len(least)] = (mask - (least & mask)).astype(np.int64) + at
    at = np.arange(windows) if counts is None else np.flatnonzero(counts)
    chosen = chosen[at]
    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])[:len(at)])
    ends = np.concatenate([starts[1:], [len(at)]])[:len(starts)] - 1
    return chosen[starts], at[starts], at[ends]


#: A 64-bit symbol for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def word_symbols(text: bytes, inside: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each word of `text`, in order: a word is a longest run of bytes whose
    value is true in `inside` (256 booleans). All words are hashed at once, from prefix sums."""
    data = np.frombuffer(text, np.uint8)
    edges = np.zeros(len(data) + 2, np.int8)
    edges[1:-1] = inside[data]
    at = np.flatnonzero(np.diff(edges))
    return Rolling(BYTES[data]).of(at[::2], at[1::2])


def words_of_texts(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple:
    """`word_symbols` of many texts at once, text i being the bytes from edges[i] to edges[i + 1] of
    `data`: the symbols, one text after the other, and the number of each text's words."""
    within = inside[data]
    begins, ends = within.copy(), within.copy()
    begins[1:] &= ~within[:-1]
    ends[:-1] &= ~within[1:]
    # Words end where their texts do.
    cut = edges[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut], ends[cut - 1] = within[cut], within[cut - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return (Rolling(BYTES[data]).of(start, stop),
            np.diff(np.searchsorted(start, edges)))


class WordHashes(dict):
    """64-bit symbols of words (bytes), remembered up to a bound."""

    limit = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
