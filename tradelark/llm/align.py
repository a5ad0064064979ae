"""Alignment of two tokenizers on the bytes of a text.

Both token streams of a text end at byte offsets. Offsets where a token of either ends are
cuts; between two neighbouring cuts lies a group of tokens that cannot be aligned more
finely. Cuts are found by divide and conquer: in an interval the end of a token of A near
the middle is looked up among the ends of B by bisection, the search widening to both
sides until an end is common; then both halves are searched the same way. An interval
without a common end is a leaf, one group. All intervals of many texts are halved side by
side in numpy.

Tokens whose ends are common are linked. How often a pair of ids is linked is counted over
the corpus: texts are kept in blocks, each with its distinct pairs, and the totals come
back once per block and pair. A block is written as several rows, and rows in small groups.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelark.plans.staging import lasting, staged, workspace

# Links of a block, and characters of text that are aligned side by side.
BLOCK_LINKS, TOGETHER = 1 << 20, 1 << 19
# Links (and texts) of a row of a block, and such rows that are written, and read again, at once: a task
# never holds all blocks of its texts.
ROW_LINKS, ROWS = 1 << 17, 16
# A pair of ids as one number.
PAIR_BITS = 32
_SPACE = "▁"
# The pattern and the settings of the byte-level tokenizers that ``tiktoken`` reproduces (fixed values).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer stretches of white space overflow the stack of its pattern matcher.
_LONG_BLANKS = re.compile(r"\s{10000}")


# ---------------------------------------------------------------- tokenizers


def visible_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Bytes that print stand for themselves, the others follow behind the first 256 characters.
    """
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(printing)]
    return {**{chr(byte): byte for byte in printing}, **{chr(256 + at): byte for at, byte in enumerate(hidden)}}


class ByteLevel:
    """Ids and their bytes by a byte-level file in the format of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are plain text
        letters = visible_bytes()
        vocabulary = spec["model"]["vocab"]
        added = {one["id"]: one["content"].encode() for one in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocabulary.values(), *added]) + 1)
        for entry, id_ in vocabulary.items():
            self.bytes[id_] = bytes(letters[char] for char in entry)
        for id_, content in added.items():
            self.bytes[id_] = self.bytes[id_] or content
        self.fast = self._fast(spec, vocabulary) if self._plain(spec) else None

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether merging in the order of ids is all that the file asks for."""
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))] for merge in merges]
        cut = spec["pre_tokenizer"] or {}
        return (
            made == sorted(made)
            and spec["normalizer"] is None and spec["post_processor"] is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and not any(spec["model"].get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )

    def _fast(self, spec: dict, vocabulary: dict[str, int]):
        import tiktoken

        ranks = {self.bytes[id_]: id_ for id_ in vocabulary.values()}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _LONG_BLANKS.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """Ids and their bytes by a ``sentencepiece`` model, which puts a space in front of a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(id_) else piece.replace(_SPACE, " ").encode()
            for id_, piece in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """This worker's tokenizers, kept between tasks."""
    return ByteLevel(path_a), Pieces(path_b)


# ---------------------------------------------------------------- cuts


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, tops_a: np.ndarray, tops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``ends_a`` and in ``ends_b`` (both ascending) of all ends common to both.

    ``tops_a`` and ``tops_b`` are the positions of ends known to be common, the last ones among
    them: with them the search starts, an interval for each.
    """
    cuts_a, cuts_b = [tops_a], [tops_b]
    # Tokens [low, high) of an interval; its own last end is a cut already. ``shell``: distance
    # from the middle up to which its ends have been looked up without success.
    low_a, low_b = np.append(0, tops_a[:-1] + 1), np.append(0, tops_b[:-1] + 1)
    high_a, high_b = tops_a + 1, tops_b + 1
    shell = np.zeros(len(low_a), dtype=np.int64)
    while True:
        # A group of one token on either side is a leaf.
        searched = (high_a - low_a > 1) & (high_b - low_b > 1)
        low_a, high_a, low_b, high_b, shell = (one[searched] for one in (low_a, high_a, low_b, high_b, shell))
        if not len(low_a):
            break
        # The ends from ``shell`` up to twice as far on both sides of the middle.
        middle, far = (low_a + high_a - 2) // 2, 2 * shell + 1
        right_from, right_to = middle + shell, np.minimum(middle + far, high_a - 1)
        left_from, left_to = np.maximum(middle - far + 1, low_a), middle - np.maximum(shell, 1) + 1
        n_right, n_left = np.maximum(right_to - right_from, 0), np.maximum(left_to - left_from, 0)
        counts = np.stack((n_right, n_left), axis=1).ravel()
        firsts = np.stack((right_from, left_from), axis=1).ravel()
        owner = np.repeat(np.arange(len(low_a)), n_right + n_left)
        probe = np.arange(len(owner)) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)
        wanted = ends_a[probe]
        place = np.searchsorted(ends_b, wanted)
        hit = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] == wanted)
        # Of the common ends of an interval the one nearest to the middle.
        near = np.lexsort((np.abs(probe[hit] - middle[owner[hit]]), owner[hit]))
        hit = hit[near]
        hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
        at, cut_a, cut_b = owner[hit], probe[hit], place[hit]
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        # Without success: look further, if any end of the interval is left.
        missed = np.ones(len(low_a), dtype=bool)
        missed[at] = False
        missed &= (right_to < high_a - 1) | (left_from > low_a)
        halves = (
            (low_a[at], cut_a + 1, low_a[missed]),
            (cut_a + 1, high_a[at], high_a[missed]),
            (low_b[at], cut_b + 1, low_b[missed]),
            (cut_b + 1, high_b[at], high_b[missed]),
        )
        # Left halves, right halves, and those still searched as a whole.
        low_a, high_a = np.concatenate((halves[0][0], halves[0][1], halves[0][2])), np.concatenate((halves[1][0], halves[1][1], halves[1][2]))
        low_b, high_b = np.concatenate((halves[2][0], halves[2][1], halves[2][2])), np.concatenate((halves[3][0], halves[3][1], halves[3][2]))
        shell = np.concatenate((np.zeros(2 * len(at), np.int64), far[missed]))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


# ---------------------------------------------------------------- texts of one batch


class _Texts:
    """The aligned texts of a batch: token counts, groups, digests and links of each."""

    def __init__(self, texts: list[str | None], own: tuple[ByteLevel, Pieces], lengths: tuple[np.ndarray, np.ndarray], names: tuple):
        a, b = own
        ids_a, ids_b = [], []
        for text in texts:
            one = two = []
            if text:
                whole = (" " + text).encode("utf-8", "surrogatepass")
                one, two = a.encode(" " + text), b.encode(text)
                if b"".join(map(a.bytes.__getitem__, one)) != whole or b"".join(map(b.bytes.__getitem__, two)) != whole:
                    one = two = []
            ids_a.append(one)
            ids_b.append(two)
        self.n_a = np.array([len(one) for one in ids_a], dtype=np.int64)
        self.n_b = np.array([len(one) for one in ids_b], dtype=np.int64)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        some = self.n_a > 0
        last_a, last_b = (np.cumsum(n)[some] - 1 for n in (self.n_a, self.n_b))
        # Both streams of a text have the same bytes, so ends may be counted on over all texts.
        cut_a, cut_b = common_cuts(np.cumsum(lengths[0][flat_a]), np.cumsum(lengths[1][flat_b]), last_a, last_b) if some.any() else (last_a, last_b)
        self.n_groups = np.diff(np.searchsorted(cut_a, np.append(0, np.cumsum(self.n_a))))
        self.pairs = flat_a[cut_a] << PAIR_BITS | flat_b[cut_b]
        self.digests = self._digests(flat_a, flat_b, cut_a, cut_b, names)

    def _digests(self, flat_a: np.ndarray, flat_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names: tuple) -> list[str]:
        """SHA-256 of the groups in order, each with its ids of A, then those of B."""
        inner, last = names
        written = np.empty(len(flat_a) + len(flat_b), dtype=object)
        # In the text a token of A stands behind all tokens of B of earlier groups, one of B behind
        # all tokens of A up to its own group's last.
        place_a = np.arange(len(flat_a)) + np.repeat(np.append(0, cut_b + 1)[: len(cut_b)], np.diff(cut_a, prepend=-1))
        place_b = np.arange(len(flat_b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))
        written[place_a], written[place_b] = inner[flat_a], inner[flat_b]
        written[place_a[cut_a]], written[place_b[cut_b]] = last[0][flat_a[cut_a]], last[1][flat_b[cut_b]]
        result, start = [], 0
        for size in (self.n_a + self.n_b).tolist():
            text = "".join(written[start : start + size].tolist())[:-1]
            result.append(hashlib.sha256(text.encode("ascii")).hexdigest() if size else "")
            start += size
        return result


def _names(size: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Decimal ids followed by a comma, and by what ends the ids of A and of B in a group."""
    inner, middle, end = (np.array([f"{id_}{mark}" for id_ in range(size)], dtype=object) for mark in ",|;")
    return inner, (middle, end)


def _text_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of about ``size`` characters together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            text = text.as_py()
            ids.append(doc_id.as_py())
            texts.append(text)
            held += len(text or "") + 16
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "links binary, pairs array<long>, counts array<long>"
)


def _blocks(docs: DataFrame, path_a: str, path_b: str, block: int, together: int) -> DataFrame:
    """Rows of the blocks of texts: what is known of each text, and its links as places in its block's distinct pairs.

    A block has a row for about ROW_LINKS links; the first one has its pairs and how often each occurs.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        lengths = tuple(np.array([len(one) for one in side.bytes], dtype=np.int64) for side in own)
        names = _names(max(len(side.bytes) for side in own))
        number = TaskContext.get().partitionId() << 32
        doc_ids, parts, held = [], [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            pairs, links, counts = np.unique(np.concatenate([one.pairs for one in parts]), return_inverse=True, return_counts=True)
            lists = {name: np.concatenate([getattr(one, name) for one in parts]) for name in ("n_a", "n_b", "n_groups")}
            digests = [digest for one in parts for digest in one.digests]
            # Texts whose links begin in the same stretch of ROW_LINKS share a row.
            ends = np.cumsum(lists["n_groups"])
            begun = (ends - lists["n_groups"] + np.arange(len(ends))) // ROW_LINKS
            edges = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), len(ends)]
            at = np.append(0, ends)[edges].tolist()
            for place, (first, last) in enumerate(zip(edges, edges[1:])):
                own = slice(0 if place else None)
                yield pa.record_batch({
                    "block": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([doc_ids[first:last]], pa.list_(pa.int64())),
                    **{name: pa.array([values[first:last]], pa.list_(pa.int64())) for name, values in lists.items()},
                    "digests": pa.array([digests[first:last]], pa.list_(pa.string())),
                    "links": pa.array([links[at[place] : at[place + 1]].astype("<i4").tobytes()], pa.binary()),
                    "pairs": pa.array([pairs[own]], pa.list_(pa.int64())),
                    "counts": pa.array([counts[own].astype(np.int64)], pa.list_(pa.int64())),
                })

        for ids, texts in _text_batches(batches, together):
            parts.append(_Texts(texts, own, lengths, names))
            doc_ids.extend(ids)
            held += len(parts[-1].pairs) + len(ids)
            if held >= block:
                yield from finished()
                number, doc_ids, parts, held = number + 1, [], [], 0
        if doc_ids:
            yield from finished()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(gather, _BLOCKS)


# ---------------------------------------------------------------- counts over the corpus


def _pair_weights(blocks: DataFrame) -> DataFrame:
    """Per block, as one row (block, weights): 2 * count of each of its pairs, + 1 if no pair of that id of B has more."""
    entries = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "entry"))
    entries = entries.select("block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.counts").alias("n"))
    counts = entries.groupBy("pair").agg(F.sum("n").alias("n"))
    # One id of B meets at most the vocabulary of A.
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)))
    weights = counts.withColumn("most", most).select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("weight"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def row() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array([current], pa.int64()), "weights": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

        for batch in batches:
            numbers, found = batch.column("block").to_numpy(), batch.column("weight").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                if parts and numbers[first] != current:
                    yield row()
                    parts = []
                current = int(numbers[first])
                parts.append(found[first:last].astype("<i8"))
        if parts:
            yield row()

    back = entries.select("block", "place", "pair").join(weights, "pair").select("block", "place", "weight")
    return back.repartition("block").sortWithinPartitions("block", "place").mapInArrow(gather, "block long, weights binary")


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many values."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            n_groups = batch.column("n_groups")[at].values
            sizes = n_groups.to_numpy()
            links, weights = (
                np.zeros(0, kind) if (buffer := batch.column(name)[at].as_buffer()) is None else np.frombuffer(buffer, kind)
                for name, kind in (("links", "<i4"), ("weights", "<i8"))
            )
            own = weights[links] if len(links) else np.zeros(0, np.int64)
            columns = {name: batch.column(name)[at].values for name in ("doc_ids", "n_a", "n_b", "digests")}
            yield pa.record_batch({
                "doc_id": columns["doc_ids"], "n_a": columns["n_a"], "n_b": columns["n_b"],
                "n_groups": n_groups, "n_links": n_groups,
                "n_best": pa.array(_sums(own & 1, sizes)), "count_sum": pa.array(_sums(own >> 1, sizes)),
                "groups_sha256": columns["digests"],
            })


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, block: int = BLOCK_LINKS, together: int = TOGETHER) -> DataFrame:
    """Alignment of the byte-level tokenizer of ``path_a`` (A) and the piece model of ``path_b`` (B) on every row of ``docs`` (doc_id, text).

    doc_id (as a long), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A is given a space and the text,
    B the text, in front of which it puts a space itself. A null or empty text has no tokens, nor has one whose
    bytes A or B does not give back: counts are zero and the digest is empty. Each group holds one link, of
    the last tokens of A and B in it, as every token has bytes. Repeated rows are aligned and counted each,
    rows with null or repeated ids too. Other columns are ignored. An empty table gives no rows.
    """
    with workspace(docs.sparkSession):
        blocks = staged(_blocks(docs, path_a, path_b, block, together), "align-blocks", rows=ROWS)
        weights = staged(_pair_weights(blocks), "align-weights", settle=True)
        rows = blocks.drop("pairs", "counts").join(weights.hint("shuffle_hash"), "block", "left").drop("block")
        found = rows.mapInArrow(
            _documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        )
        return lasting(found, "align")
