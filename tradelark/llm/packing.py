"""Best-fit packing of documents into sequences, with certified repacking.

Documents are packed where they are read: each task fills windows of a bounded number of
tokens by best-fit decreasing. Dual feasible functions give a lower bound of the sequences
that a window's pieces need; a window that meets its bound is certified. The open
sequences of all other windows, and the emptiest one of each certified window, go into a
pool. Groups of pooled sequences, of a window's tokens each, exchange their pieces, are
packed anew and certified the same way, dealt differently in every round, until no group
misses its bound, one group holds all, or a round saves no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelark.llm.tokens import encoder
from tradelark.plans.staging import lasting, staged, workspace

LENGTH, END = 4096, 1
# Tokens a task packs together, and pieces, where they are short.
WINDOW, WINDOW_PIECES = 1 << 23, 1 << 20


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size (1 to capacity): largest first, each into the fullest bin it fits."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    rooms = count = 0  # bit r of rooms: some bin has room r
    for at in np.argsort(-sizes, kind="stable"):
        size = int(sizes[at])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, count = capacity, count, count + 1
        bins[at], offsets[at] = chosen, capacity - room
        left = room - size
        if left:
            free[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these sizes needs."""
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int, most: int = 64) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    ``counts`` has the number of pieces of every size from 0 to capacity. The first counts sizes above capacity - k whole and those below k not at all; the second
    rounds size * (k + 1) / capacity down to whole k-ths unless it is whole.
    """
    count = counts.astype(np.int64)
    if not count.any():
        return 0
    weight = count * np.arange(capacity + 1)
    below, weighed = np.cumsum(count), np.cumsum(weight)
    k = np.arange(capacity // 2 + 1)
    large = below[capacity] - below[capacity - k]
    middle = weighed[capacity - k] - np.where(k > 0, weighed[np.maximum(k - 1, 0)], 0)
    best = int((large - (-middle // capacity)).max())
    every = np.arange(capacity + 1)
    for k in range(1, most):
        scaled = every * (k + 1)
        whole = scaled % capacity == 0
        # In units of 1 / (k * capacity).
        value = np.where(whole, every * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def _open(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Which pieces go back into the pool."""
    if not len(sizes):
        return np.zeros(0, bool)
    room = capacity - np.bincount(bins, sizes).astype(np.int64)
    missed = len(room) - lower_bound(sizes, capacity)
    reopened = room > 0 if missed > 0 else (room == room.max()) & (room > 0)
    return reopened[bins]


def _cut(ids: bytes, length: int) -> list[bytes]:
    return [ids[at : at + 4 * length] for at in range(0, len(ids), 4 * length)]


def _packed(docs: DataFrame, path: str, end: int, length: int, window: int, most: int) -> DataFrame:
    """Pieces of all documents, placed within their window, which holds ``most`` of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = int(end).to_bytes(4, "little")

    def placed(rows: list[tuple], number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(ids) // 4 for _, _, ids in rows], dtype=np.int64)
        bins, offsets = best_fit_decreasing(sizes, length)
        reopened = _open(bins, sizes, length)
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            span = slice(at, at + len(some))
            pieces = np.array([piece for _, piece, _ in some], dtype=np.int64)
            yield pa.record_batch({
                "window": pa.array([number] * len(some), pa.int64()),
                "item": pa.array(np.arange(at, at + len(some))),
                "doc_id": pa.array([doc_id for doc_id, _, _ in some], id_type),
                "piece": pa.array(pieces.astype(np.int32)),
                "start": pa.array(pieces * length),
                "length": pa.array(sizes[span]),
                "ids": pa.array([ids for _, _, ids in some], pa.binary()),
                "sequence_id": pa.array((number << 24) + bins[span]),
                "offset": pa.array(offsets[span]),
                "reopened": pa.array(reopened[span]),
            })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = encoder(path), TaskContext.get().partitionId() << 16
        rows, held = [], 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for piece, ids in enumerate(_cut(own.encode(text) + tail, length)):
                    if rows and (held + len(ids) // 4 > window or len(rows) >= most):
                        yield from placed(rows, number, id_type)
                        rows, held, number = [], 0, number + 1
                    rows.append((doc_id, piece, ids))
                    held += len(ids) // 4
        if rows:
            yield from placed(rows, number, id_type)

    return docs.select("doc_id", "text").mapInArrow(
        pack,
        f"window long, item long, doc_id {kind}, piece int, start long, length long, ids binary, "
        "sequence_id long, offset long, reopened boolean",
    )


_PLACED = ["window", "item", "length", "sequence_id", "offset"]


def _group_packer(length: int, base: int, *, certify: bool):
    """Pack a group's pieces anew, keep the result if it saves a sequence, reopen what misses its bound."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["window", "item"], ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, length)
        if bins.max() + 1 < rows["sequence_id"].nunique():
            rows["sequence_id"], rows["offset"] = base + (int(key[0]) << 24) + bins, offsets
        else:
            _, bins = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        reopened = _open(bins, sizes, length) if certify else np.zeros(len(rows), bool)
        return rows[_PLACED].assign(reopened=reopened)

    return pack


def _repack(pool: DataFrame, length: int, window: int) -> DataFrame:
    """window, item, sequence_id, offset of all pooled pieces after the exchange rounds."""
    done, open_, number = None, staged(pool.select(*_PLACED), "packing-pool"), 0
    while True:
        number += 1
        tokens, before = open_.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
        groups = max(1, -(-(tokens or 0) // window))
        # Pieces of one sequence stay together until they are packed anew.
        dealt = open_.withColumn("group", F.pmod(F.xxhash64(F.col("sequence_id"), F.lit(number)), F.lit(groups)))
        result = staged(
            dealt.groupBy("group").applyInPandas(
                _group_packer(length, (1 << 62) + (number << 48), certify=groups > 1),
                "window long, item long, length long, sequence_id long, offset long, reopened boolean",
            ),
            "packing-round",
        )
        last = groups == 1 or result.agg(F.count_distinct("sequence_id")).first()[0] >= before
        closed = result if last else result.where("NOT reopened")
        done = closed.select(*_PLACED) if done is None else done.unionByName(closed.select(*_PLACED))
        if last:
            return done.select("window", "item", "sequence_id", "offset")
        open_ = result.where("reopened").select(*_PLACED)


def certificate(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequences, bound, above: how many sequences there are, and how many more than any packing of these pieces needs.

    One row, from ``packed`` (length, sequence_id). The bound comes from counts per size, of
    which there are at most ``length``. No piece: all three are 0.
    """
    counts = np.zeros(length + 1, np.int64)
    for size, count in packed.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[size] = count
    bound = F.lit(bound_of_counts(counts, length)).cast("long")
    sequences = F.count_distinct("sequence_id")
    return packed.agg(sequences.alias("sequences"), bound.alias("bound"), (sequences - bound).alias("above"))


def pack_documents(docs: DataFrame, path: str, *, end: int = END, length: int = LENGTH, window: int = WINDOW, most: int = WINDOW_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    A document is its ids and the end id; a null or empty text has the end id only. Longer
    ones are cut after every ``length`` ids. ids is binary (little-endian 32 bits). Ids of
    documents may have any type that Arrow batches carry. A task packs up to ``window`` tokens and ``most`` pieces together; what that
    costs, the rounds between windows win back. Rows that share an id are packed each; other columns are ignored; an empty table gives no rows.
    """
    pieces = staged(_packed(docs, path, end, length, window, most), "packed-pieces")
    made = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    closed = pieces.where("NOT reopened").select(*made)
    again = pieces.where("reopened")
    with workspace(docs.sparkSession):
        anew = lasting(_repack(again, length, window), "packing-moves")
    moved = again.drop("sequence_id", "offset").join(anew, ["window", "item"])
    return closed.unionByName(moved.select(*made))
