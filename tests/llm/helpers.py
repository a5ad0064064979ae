"""Plain versions of the operators, row by row, to compare with."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, lang)."""
    full = [(row[0], row[1], row[2] if len(row) > 2 else None, "src", len(row[1] or "")) for row in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    own = words(text)
    if len(own) < k:
        return {tuple(own)} if own else set()
    return {tuple(own[at : at + k]) for at in range(len(own) - k + 1)}


def linked_components(texts, k, pct):
    """Per position the smallest position reachable by links."""
    sets = [shingles(text, k) for text in texts]
    parent = list(range(len(texts)))

    def find(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for one in range(len(texts)):
        for other in range(one):
            if sets[one] and sets[other] and 100 * len(sets[one] & sets[other]) >= pct * len(sets[one] | sets[other]):
                low, high = sorted((find(one), find(other)))
                parent[high] = low
    return [find(at) for at in range(len(texts))], [len(own) for own in sets]


def without_repeats(texts, window):
    """(bytes, removed, spans, digest) of each text."""
    data = [(text or "").encode() for text in texts]
    seen = Counter(own[at : at + window] for own in data for at in range(len(own) - window + 1))
    result = []
    for own in data:
        gone = bytearray(len(own))
        for at in range(len(own) - window + 1):
            if seen[own[at : at + window]] > 1:
                gone[at : at + window] = b"\1" * window
        kept = bytes(byte for byte, flag in zip(own, gone) if not flag)
        spans = sum(1 for at in range(len(own)) if gone[at] and not (at and gone[at - 1]))
        result.append((len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def sentence(seed, count, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(count))


def edited(text, seed, changes):
    draw = random.Random(seed)
    own = text.split(" ")
    for at in draw.sample(range(len(own)), changes):
        own[at] = f"x{seed}y{at}"
    return " ".join(own)


def grouped(rows, key, value):
    found = defaultdict(list)
    for row in rows:
        found[row[key]].append(row[value])
    return found
