"""Hashes of words and word shingles of whole texts, in numpy.

Words are stretches of anything but ASCII white space, A-Z lower-cased; a shingle is a
stretch of k words, and a text of fewer words is one shingle as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

# Bytes worked on at once; longer texts are read in pieces cut between words.
PIECE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over all bits (multiply and shift twice)."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(_MIX[0])
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(_MIX[1])
    return keys ^ (keys >> np.uint64(31))


@cache
def byte_keys() -> np.ndarray:
    """A random 64-bit number per byte value."""
    return np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


# The longest powers so far, of the factor and of its inverse.
_powers: dict[bool, np.ndarray] = {}


def powers(count: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to count - 1 (at least) of an odd factor, or of its inverse, modulo 2**64."""
    kept = _powers.get(inverse)
    if kept is None or len(kept) < count:
        factor = pow(_FACTOR, -1, 1 << 64) if inverse else _FACTOR
        steps = np.full(1 << max(0, count - 1).bit_length(), factor, dtype=np.uint64)
        steps[0] = 1
        kept = _powers[inverse] = np.multiply.accumulate(steps)
    return kept


@cache
def _gaps() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``, which starts and ends with a gap."""
    values = np.frombuffer(data, np.uint8)
    gap = _gaps()[values]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    sums = np.cumsum(byte_keys()[values] * powers(len(values))[: len(values)], dtype=np.uint64)
    found = (sums[ends - 1] - sums[starts - 1]) * powers(len(values), True)[starts]
    return mixed(found + (ends - starts).astype(np.uint64)), starts


def word_starts(data: bytes) -> np.ndarray:
    """First byte of every word of a text."""
    gap = np.concatenate(([True], _gaps()[np.frombuffer(data, np.uint8)]))
    return np.flatnonzero(gap[:-1] & ~gap[1:])


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while len(data) - start > PIECE:
        end = max(data.rfind(gap, start + 1, start + PIECE) for gap in (b" ", b"\n", b"\t"))
        end = end if end > start else start + PIECE
        # A word longer than a piece is read to its end.
        while end < len(data) and not _gaps()[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and how many each text has."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    waiting: list[bytes] = []
    places: list[int] = []

    def flush() -> None:
        if not waiting:
            return
        found, starts = _word_hashes(b"\n" + b"\n".join(waiting) + b"\n")
        edges = np.cumsum([len(data) + 1 for data in waiting])
        np.add.at(counts, places, np.diff(np.searchsorted(starts, edges, side="right"), prepend=0))
        hashes.append(found)
        waiting.clear()
        places.clear()

    held = 0
    for at, text in enumerate(texts):
        for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
            if held + len(piece) > PIECE:
                flush()
                held = 0
            waiting.append(piece)
            places.append(at)
            held += len(piece) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles; none without words."""
    words, counts = words_of(texts)
    chained = words.copy()
    for step in range(1, k):
        chained[: len(words) - step] = mixed(chained[: len(words) - step] * np.uint64(_FACTOR) + words[step:])
    result, start = [], 0
    for count in counts.tolist():
        if count >= k:
            result.append(np.unique(chained[start : start + count - k + 1]))
        elif count:
            whole = words[start : start + 1]
            for word in words[start + 1 : start + count]:
                whole = mixed(whole * np.uint64(_FACTOR) + word)
            result.append(mixed(whole + np.uint64(count)))
        else:
            result.append(np.zeros(0, np.uint64))
        start += count
    return result
