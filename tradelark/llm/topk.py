"""Exact top-k by inner product from an impact-ordered index, score at a time.

Vectors are indexed in blocks. A block keeps, for every dimension, its vectors ordered into
segments of equal quantised value. For a query, a segment's impact is the most that it can
add to a score beyond the least its dimension can add; segments are processed by
descending impact. After a stretch of segments every vector has proven bounds: at most
what its processed segments add plus the impact still open in each dimension, and at least
what they add less the width of a segment in each dimension. Processing stops when the
vectors whose upper bound reaches the k-th lower bound are few, or at the end; these
possible members, all of them, are scored exactly.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelark.plans.staging import staged

BLOCK, QUERY_BLOCK = 8192, 512
# Values of one segment lie within this width.
WIDTH = 8
# Floor of a scaled component is exact below this; a larger one is an error.
MOST_VALUE = 1 << 53
# Stretches of segments between two proofs, and the possible members that end the search.
STRETCHES, FEW = 4, 64


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and value (floor of scale * component) of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("value")
    )


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """block, ids, dims, values: up to ``most`` vectors of one length in one row, as bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, values = waiting.pop(dims)
            values = np.array(values, "<i8")
            if values.max(initial=0) >= MOST_VALUE or values.min(initial=0) <= -MOST_VALUE:
                raise ValueError(f"a vector has a component of {MOST_VALUE} or more after scaling; its scores would not be exact")
            number += 1
            return pa.record_batch({
                "block": pa.array([number - 1], pa.int64()),
                "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                "dims": pa.array([dims], pa.int32()),
                "values": pa.array([values.tobytes()], pa.binary()),
            })

        for batch in batches:
            for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("value").to_pylist()):
                ids, values = waiting.setdefault(len(value), ([], []))
                ids.append(vec_id)
                values.append(value)
                if len(ids) == most:
                    yield block(len(value))
        for dims in list(waiting):
            yield block(dims)

    return rows.mapInArrow(gather, "block long, ids binary, dims int, values binary")


class Index:
    """Impact-ordered postings of one block of vectors (n by dims, long)."""

    def __init__(self, values: np.ndarray, width: int = WIDTH):
        self.values = values
        self.largest = int(np.abs(values).max(initial=0))
        self.least, self.most = values.min(axis=0), values.max(axis=0)
        order, dim, low, high, start = [], [], [], [], [0]
        for at in range(values.shape[1]):
            level = (values[:, at] - self.least[at]) // width
            by_level = np.argsort(level, kind="stable")
            edges = np.flatnonzero(np.diff(level[by_level], prepend=-1))
            for first, last in zip(edges, np.append(edges[1:], len(level))):
                own = by_level[first:last]
                order.append(own)
                dim.append(at)
                low.append(values[own, at].min())
                high.append(values[own, at].max())
                start.append(start[-1] + len(own))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.dim, self.low, self.high = np.array(dim, np.int64), np.array(low, np.int64), np.array(high, np.int64)
        self.start = np.array(start, np.int64)
        self.widest = np.zeros(values.shape[1], np.int64)
        np.maximum.at(self.widest, self.dim, self.high - self.low)
        # The bounds of each posting's segment; a dimension's postings rise by segment.
        self.posted_low, self.posted_high = (np.repeat(bound.astype(float), np.diff(self.start)) for bound in (self.low, self.high))

    def _most(self, query: np.ndarray) -> int:
        """The size that no score passes."""
        return len(query) * self.largest * int(np.abs(query).max(initial=0))

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """All vectors that can be among the k best, ties with the k-th included."""
        n, dims = self.values.shape
        # Bounds are sums of whole numbers in doubles: without rounding, or not used.
        if n <= max(k, FEW) or not len(self.dim) or 8 * self._most(query) >= 1 << 53:
            return np.arange(n)
        weight = query[self.dim]
        one, other = weight * self.low, weight * self.high
        base = np.minimum(query * self.least, query * self.most)
        impact = np.maximum(one, other) - base[self.dim]
        width = np.abs(query) * self.widest
        by_impact = np.argsort(-impact, kind="stable")
        lengths = np.diff(self.start)[by_impact]
        ends = np.searchsorted(np.cumsum(lengths), np.linspace(0, lengths.sum(), STRETCHES + 1)[1:], side="left") + 1
        added, done = np.zeros(n), 0
        weights, bases = query.astype(float), base.astype(float)
        taken = np.zeros(dims, np.int64)
        for end in np.unique(np.minimum(ends, len(by_impact))):
            # Within a dimension, impact falls from one end of its postings to the other.
            more = taken + np.bincount(self.dim[by_impact[done:end]], lengths[done:end], dims).astype(np.int64)
            at = np.arange(dims) * n
            first, last = np.where(query < 0, at + taken, at + n - more), np.where(query < 0, at + more, at + n - taken)
            for d in np.flatnonzero(more > taken):
                span = slice(first[d], last[d])
                bounds = self.posted_high if query[d] >= 0 else self.posted_low
                # A vector has one posting in a dimension: no index is added to twice.
                added[self.order[span]] += weights[d] * bounds[span] - bases[d]
            done, taken = end, more
            left = by_impact[done:]
            open_ = np.zeros(dims)
            open_[self.dim[left[::-1]]] = impact[left[::-1]]  # the last written is the largest
            gap = width.sum() + open_.sum()
            possible = np.flatnonzero(added >= np.partition(added, n - k)[n - k] - gap)
            if len(possible) <= FEW:
                break
        return possible

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) but for the query's own row, ties to the smaller vec_id."""
        where = self.candidates(query, k + int((ids == own).sum()))
        where = where[ids[where] != own]
        if self._most(query) < 1 << 63:
            scores = self.values[where] @ query
            best = np.lexsort((ids[where], -scores))[:k]
        else:
            # Python integers where a long would overflow.
            scores = [sum(map(operator.mul, own, query.tolist())) for own in self.values[where].tolist()]
            best = sorted(range(len(scores)), key=lambda at: (-scores[at], ids[where[at]]))[:k]
        return [(int(ids[where[at]]), int(scores[at])) for at in best]


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding; other columns are ignored. A vector takes part unless its
    id, itself or a component is null, or a component is not finite. Scores are exact inner
    products of floor(scale * component); a floor of 2**53 or more in size, and a score among
    the best that does not fit a long, is an error. Vectors are compared with queries of their own
    length. A row with the query's vec_id is not its candidate. Ties go to the smaller vec_id.
    Queries meet the blocks of the index in blocks, never row by row.
    """
    index = staged(_blocks(scaled(vectors, scale), block), "topk-index")
    asked = staged(_blocks(scaled(queries, scale).distinct(), QUERY_BLOCK), "topk-queries")
    # Every block of queries goes to every block of vectors of its length.
    places = index.select("dims", F.col("block").alias("place"))
    sent = asked.select("dims", F.col("ids").alias("query_ids"), F.col("values").alias("query_values"))
    pairs = sent.join(places, "dims").join(index.select(F.col("block").alias("place"), "ids", "values"), "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, np.ndarray, Index] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if kept is None or kept[0] != row["place"]:
                    values = _numbers(row["values"]).reshape(-1, row["dims"]) if row["dims"] else None
                    ids = _numbers(row["ids"])
                    values = np.zeros((len(ids), 0), np.int64) if values is None else values
                    kept = (row["place"], ids, Index(values))
                query_ids = _numbers(row["query_ids"])
                found = []
                for number, query in zip(query_ids, _numbers(row["query_values"]).reshape(len(query_ids), -1)):
                    found += [(int(number), *one) for one in kept[2].search(query, kept[1], number, k)]
                columns = zip(*found) if found else ((), (), ())
                kinds = (pa.int64(), pa.int64(), pa.decimal128(38))
                yield pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.col("score").between(F.lit(-(1 << 63)), F.lit((1 << 63) - 1))
    wrong = F.raise_error(F.concat(F.lit("score beyond a long, query "), F.col("query_id").cast("string"))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.when(fits, F.col("score").cast("long")).otherwise(wrong).alias("score"))
