"""Suffix arrays of byte strings in numpy, to find windows that occur more than once."""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(padded: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like them."""
    return np.ndarray((count,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def sorted_depth(depth: int) -> int:
    """The bytes by which a suffix array of this depth is sorted: a word, doubled until it is enough."""
    known = WORD
    while known < depth:
        known *= 2
    return known


def padded(data: np.ndarray, depth: int) -> np.ndarray:
    """The bytes with enough zeros behind them to read the sorted depth anywhere."""
    return np.concatenate((data, np.zeros(sorted_depth(depth) + 2 * WORD, np.uint8)))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by ``sorted_depth(depth)`` bytes (zeros behind the end), by doubling.

    A suffix's rank is the first place of its group of equal prefixes. Every round sorts the
    groups that are not single by the rank of what follows the prefix, which doubles its
    length; single groups are never touched again.
    """
    n = len(data)
    words = _words(padded(data, depth), n)
    array = np.argsort(words, kind="stable")
    rank = np.zeros(n + sorted_depth(depth), dtype=np.int64)

    def regroup(places: np.ndarray, differs: np.ndarray) -> np.ndarray:
        """Set ranks of array[places]; the places whose groups still have several members."""
        start = np.maximum.accumulate(np.where(differs, places, 0))
        rank[array[places]] = start + 1  # zero is what lies behind the end
        single = differs & np.append(differs[1:], True)
        return places[~single]

    ordered = words[array]
    open_ = regroup(np.arange(n), np.concatenate(([True], ordered[1:] != ordered[:-1]))) if n else np.arange(0)
    known = WORD
    while known < depth and len(open_):
        members = array[open_]
        groups, following = rank[members], rank[members + known]
        order = np.argsort(groups * (n + 2) + following)
        array[open_] = members[order]
        groups, following = groups[order], following[order]
        differs = np.concatenate(([True], (groups[1:] != groups[:-1]) | (following[1:] != following[:-1])))
        open_ = regroup(open_, differs)
        known *= 2
    return array


def _agreeing(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many leading bytes of two eight-byte numbers are equal."""
    apart = words ^ other
    upper = apart >> np.uint64(32)
    # The bit length of 32 bits is the exponent of their exact value as a double.
    half = np.where(upper > 0, upper, apart & np.uint64(0xFFFFFFFF))
    bits = np.frexp(half.astype(np.float64))[1]
    return np.where(upper > 0, 0, 4) + (32 - bits) // 8


def common_prefixes(data: np.ndarray, array: np.ndarray, depth: int, lanes: int = 4096) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, up to ``depth``.

    In text order a suffix shares at least one byte less with its predecessor than the suffix
    one byte earlier does with its own, as long as those two differ within the bytes by which
    the array is sorted. Lanes of the text walk through it side by side.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    deepest = sorted_depth(depth)
    words = _words(padded(data, depth), n + deepest + WORD)
    before = np.empty(n, dtype=np.int64)
    before[array[0]] = -1
    before[array[1:]] = array[:-1]
    shared = np.zeros(n, dtype=np.int64)
    length = -(-n // min(lanes, n))
    first = np.arange(0, n, length)
    height = np.zeros(len(first), dtype=np.int64)
    for step in range(length):
        here = first + step
        inside = here < n
        here = here[inside]
        there = before[here]
        height = np.maximum(height[inside] - 1, 0)
        height[(there < 0) | (height >= deepest - 1)] = 0
        active = np.flatnonzero(there >= 0)
        while len(active):
            more = _agreeing(words[here[active] + height[active]], words[there[active] + height[active]])
            height[active] += more
            active = active[(more == WORD) & (height[active] < deepest)]
        first = first[inside]
        shared[here] = np.minimum(height, depth)
    return shared[array]


def _compare(words: np.ndarray, one: np.ndarray, other_words: np.ndarray, other: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0 or 1: how ``depth`` bytes at ``one`` sort against those at ``other``."""
    result = np.zeros(len(one), dtype=np.int8)
    active = np.arange(len(one))
    for at in range(0, depth, WORD):
        left, right = words[one[active] + at], other_words[other[active] + at]
        if depth - at < WORD:
            cut = np.uint64(8 * (WORD - (depth - at)))
            left, right = left >> cut, right >> cut
        result[active] = np.where(left < right, -1, np.where(left > right, 1, 0))
        active = active[left == right]
        if not len(active):
            break
    return result


class Shard:
    """The sorted windows of one byte string: those that start at ``valid`` positions."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, depth: int):
        self.depth, self.words = depth, _words(padded(data, depth), len(data) + depth)
        array = suffix_array(data, depth)
        kind = np.cumsum(common_prefixes(data, array, depth) < depth)
        taken = valid[array]
        self.windows, kinds = array[taken], kind[taken]
        # Windows of a kind are equal; kinds are numbered in sorted order.
        _, self.first, self.kind, counts = np.unique(kinds, return_index=True, return_inverse=True, return_counts=True)
        self.repeated = counts > 1

    def meet(self, other: Shard) -> None:
        """Mark the kinds that both shards have, found by binary search of one in the other."""
        mine, theirs = self.windows[self.first], other.windows[other.first]
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        while (low < high).any():
            active = np.flatnonzero(low < high)
            middle = (low[active] + high[active]) // 2
            after = _compare(self.words, mine[active], other.words, theirs[middle], self.depth) > 0
            low[active] = np.where(after, middle + 1, low[active])
            high[active] = np.where(after, high[active], middle)
        there = np.flatnonzero(low < len(theirs))
        same = there[_compare(self.words, mine[there], other.words, theirs[low[there]], self.depth) == 0]
        self.repeated[same] = True
        other.repeated[low[same]] = True

    def repeated_windows(self) -> np.ndarray:
        return self.windows[self.repeated[self.kind]]
