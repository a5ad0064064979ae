"""Hidden Markov language model: trained by Baum-Welch over all partitions, scored exactly.

A hidden state emits the class of a word, the class emits the word. The class follows from
the word's spelling alone, so the states' tables have a fixed size; a word's share of its
class comes from its exact count in the whole training text, with one more count for each
word and for what the class has not seen. The states start as rough clusters of documents.

Texts are kept in blocks with their own small dictionaries, so that the counts of all words
are summed and brought back per block and word, not per token. Documents are cut into
stretches of tokens; the product of a stretch's transition and emission matrices carries
the forward variable across it, so that all stretches of a block are worked on side by
side and the result is the exact, scaled forward recursion over the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelark.llm.langid import remainder
from tradelark.plans.staging import lasting, staged, workspace

STATES, CLASSES, ROUNDS = 4, 4096, 4
# Tokens of a block, of a batch worked on at once, and of a stretch.
BLOCK, BATCH, STRETCH = 1 << 22, 1 << 19, 64
# No word: words hold no white space.
END = b" "
# Expected counts are summed as whole multiples of this, in any order with the same result.
UNIT = 1 << 16
RESCALE = 16


def _class_of(word: bytes, classes: int) -> int:
    """The end symbol has class 0 to itself; a word's class mixes its first and last bytes."""
    return 0 if word == END else 1 + zlib.crc32(word[:3] + b" " + word[-3:]) % classes


class _Dictionary(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def _blocks(docs: DataFrame, classes: int, block: int) -> DataFrame:
    """One row per block: ids, training flags, lengths, tokens, and the block's dictionary.

    ``docs`` has doc_id, text and training. counts are of training documents only.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words, doc_ids, training, tokens, held = _Dictionary({END: 0}), [], [], [], 0

        def finished() -> pa.RecordBatch:
            every = np.concatenate(tokens)
            taught = np.concatenate([own for own, taken in zip(tokens, training) if taken] or [np.zeros(0, np.int32)])
            counts = np.bincount(taught, minlength=len(words)).astype(np.int64)
            kinds = np.array([_class_of(word, classes) for word in words], dtype=np.int32)
            return pa.record_batch({
                "block": pa.array([number], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "training": pa.array([np.array(training, np.uint8).tobytes()], pa.binary()),
                "lengths": pa.array([np.array([len(own) for own in tokens], "<i4").tobytes()], pa.binary()),
                "tokens": pa.array([every.astype("<i4").tobytes()], pa.binary()),
                "classes": pa.array([kinds.tobytes()], pa.binary()),
                "words": pa.array([list(words)], pa.list_(pa.binary())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
            })

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "text", "training"))
            for doc_id, text, taken in zip(*columns):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                tokens.append(np.fromiter(map(words.__getitem__, found + [END]), np.int32, len(found) + 1))
                doc_ids.append(doc_id)
                training.append(bool(taken))
                held += len(found) + 1
                if held >= block:
                    yield finished()
                    number += 1
                    words, doc_ids, training, tokens, held = _Dictionary({END: 0}), [], [], [], 0
        if doc_ids:
            yield finished()

    return docs.mapInArrow(
        gather,
        "block long, doc_ids array<long>, training binary, lengths binary, tokens binary, classes binary, "
        "words array<binary>, counts array<long>",
    )


@dataclass
class Model:
    """start[state], move[state, next state], emit[class, state]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class _Batch:
    """Classes of some documents, laid out as stretches: columns of at most STRETCH tokens."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        parts = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(lengths)), parts)
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(lengths[owner] - ordinal * STRETCH, STRETCH)
        begin = (np.cumsum(lengths) - lengths)[owner] + ordinal * STRETCH
        order = np.argsort(-size, kind="stable")  # longest first: each step takes a prefix of them
        self.size, self.begin, self.first = size[order], begin[order], (ordinal == 0)[order]
        self.active = np.searchsorted(-self.size, -np.arange(STRETCH), side="left")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.place, self.parts, self.classes = place, parts, classes
        self.head = np.cumsum(parts) - parts

    def column(self, step: int) -> np.ndarray:
        return self.classes[self.begin[: self.active[step]] + step]

    def steps(self) -> range:
        return range(int(self.size[0]) if len(self.size) else 0)

    def transfers(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Matrix over each stretch, scaled, and the logarithm of its scale."""
        states = len(model.start)
        matrix = np.broadcast_to(np.eye(states), (len(self.size), states, states)).copy()
        scale = np.zeros(len(self.size))
        for step in self.steps():
            emitted = model.emit[self.column(step)][:, None, :]
            own = matrix[: len(emitted)]
            moved = (own.reshape(-1, states) @ model.move).reshape(own.shape)
            if step == 0:
                moved[self.first] = np.eye(states)  # the start vector stands before a document's first token
            np.multiply(moved, emitted, out=own)
            if step % RESCALE == RESCALE - 1 or step == STRETCH - 1:
                total = own.sum(axis=(1, 2))
                own /= total[:, None, None]
                scale[: len(total)] += np.log(total)
        total = matrix.sum(axis=(1, 2))
        return matrix / total[:, None, None], scale + np.log(total)

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of each document; forward vector before, matrix over each stretch."""
        matrix, scale = self.transfers(model)
        vector = np.tile(model.start, (len(self.parts), 1))
        total = np.zeros(len(self.parts))
        before = np.empty((len(self.size), len(model.start)))
        for part in range(int(self.parts.max(initial=0))):
            docs = np.flatnonzero(self.parts > part)
            at = self.place[self.head[docs] + part]
            before[at] = vector[docs]
            moved = np.einsum("ni,nij->nj", vector[docs], matrix[at])
            size = moved.sum(axis=1)
            vector[docs] = moved / size[:, None]
            total[docs] += np.log(size) + scale[at]
        return total, before, matrix

    def expected(self, model: Model) -> Model:
        """Expected starts, moves and emissions of the documents."""
        states = len(model.start)
        _, before, matrix = self.forward(model)
        after = np.ones((len(self.size), states))
        vector = np.ones((len(self.parts), states))
        for part in range(int(self.parts.max(initial=0)) - 1, -1, -1):
            docs = np.flatnonzero(self.parts > part)
            at = self.place[self.head[docs] + part]
            after[at] = vector[docs]
            moved = np.einsum("nij,nj->ni", matrix[at], vector[docs])
            vector[docs] = moved / moved.sum(axis=1, keepdims=True)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
        ahead = []
        now = before
        for step in self.steps():
            kinds = self.column(step)
            moved = now[: len(kinds)] @ model.move
            if step == 0:
                moved[self.first] = now[self.first]
            moved *= model.emit[kinds]
            now = moved / moved.sum(axis=1, keepdims=True)
            ahead.append(now)
        behind = after
        kept = []
        for step in reversed(self.steps()):
            kinds = self.column(step)
            behind_now = behind[: len(kinds)]
            share = ahead[step] * behind_now
            share /= share.sum(axis=1, keepdims=True)
            kept.append((kinds, share))
            if step == 0:
                start += share[self.first].sum(axis=0)
            earlier = before[: len(kinds)] if step == 0 else ahead[step - 1][: len(kinds)]
            coming = model.emit[kinds] * behind_now
            back = coming @ model.move.T
            weight = (earlier * back).sum(axis=1)
            inner = earlier / weight[:, None]
            if step == 0:
                inner[self.first] = 0
            move += inner.T @ coming
            behind[: len(kinds)] = back / back.sum(axis=1, keepdims=True)
        if kept:
            kinds = np.concatenate([one for one, _ in kept])
            share = np.concatenate([one for _, one in kept])
            for state in range(states):
                emit[:, state] = np.bincount(kinds, share[:, state], len(emit))
        return Model(start, move * model.move, emit)


def _batches_of(lengths: np.ndarray) -> Iterator[slice]:
    """Consecutive documents of about BATCH tokens together."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + BATCH, side="right")))
        yield slice(first, last)
        first = last


def _training_batches(batch: pa.RecordBatch) -> Iterator[_Batch]:
    for at in range(batch.num_rows):
        row = {name: np.frombuffer(batch.column(name)[at].as_buffer(), kind) for name, kind in (("training", np.uint8), ("lengths", "<i4"), ("tokens", "<i4"), ("classes", "<i4"))}
        lengths = row["lengths"].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        for some in _batches_of(lengths):
            taken = row["training"][some] > 0
            if not taken.any():
                continue
            first, last = starts[some.start], starts[some.stop - 1] + lengths[some.stop - 1]
            mask = np.repeat(taken, lengths[some])
            yield _Batch(row["classes"][row["tokens"][first:last][mask]], lengths[some][taken])


def _summed(blocks: DataFrame, count: Callable[[_Batch], np.ndarray]) -> pa.Table:
    """at, value: sum over all partitions of the array that ``count`` makes of their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for own in _training_batches(batch):
                found = count(own)
                total = found if total is None else total + found
        if total is not None:
            whole = np.rint(total * UNIT).astype(np.int64)
            filled = np.flatnonzero(whole)
            yield pa.record_batch({"at": pa.array(filled.astype(np.int32)), "value": pa.array(whole[filled])})

    rows = blocks.select("training", "lengths", "tokens", "classes").mapInArrow(run, "at int, value long")
    return rows.groupBy("at").agg(F.sum("value").alias("value")).toArrow()


def _table(found: pa.Table, size: int) -> np.ndarray:
    table = np.zeros(size)
    table[found.column("at").to_numpy()] = found.column("value").to_numpy() / UNIT
    return table


def _first_model(blocks: DataFrame, states: int, classes: int) -> Model:
    """States that emit like clusters of documents: by the signs of random projections."""
    draws = np.random.default_rng(7).standard_normal((classes + 1, max(1, (states - 1).bit_length())))
    overall = _table(_summed(blocks, lambda own: np.bincount(own.classes, minlength=classes + 1).astype(float)), classes + 1)
    share = (overall + 0.1) / (overall + 0.1).sum()
    centre = share @ draws

    def count(own: _Batch) -> np.ndarray:
        lengths = np.diff(np.append(_document_starts(own), len(own.classes)))
        sums = np.add.reduceat(draws[own.classes], _document_starts(own), axis=0) if len(own.classes) else np.zeros((0, draws.shape[1]))
        cluster = ((sums / lengths[:, None] > centre) @ (1 << np.arange(draws.shape[1]))) % states
        table = np.zeros((classes + 1) * states)
        np.add.at(table, own.classes * states + np.repeat(cluster, lengths), 1.0)
        return table

    found = _table(_summed(blocks, count), (classes + 1) * states).reshape(-1, states)
    # Mixed with the whole, so that no state is empty and none is certain.
    emit = found + 0.2 * share[:, None] * max(found.sum(), 1) / states
    move = np.full((states, states), 0.02) + np.eye(states) * (1 - 0.02 * states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _document_starts(own: _Batch) -> np.ndarray:
    return own.begin[own.place[own.head]]


def train(blocks: DataFrame, *, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: ``rounds`` passes over all training documents."""
    spark = blocks.sparkSession
    model = _first_model(blocks, states, classes)
    ends = np.cumsum([states, states * states])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(own: _Batch, shared=shared) -> np.ndarray:
            found = own.expected(shared.value)
            return np.concatenate((found.start, found.move.ravel(), found.emit.ravel()))

        total = _table(_summed(blocks, count), ends[1] + (classes + 1) * states)
        start = total[: ends[0]] + 1
        move = total[ends[0] : ends[1]].reshape(states, states) + 1
        emit = total[ends[1] :].reshape(-1, states) + 0.1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def _word_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training counts of all words (word, c), and those of each block's dictionary as one row (block, known)."""
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry"))
    entries = entries.select("block", "place", "entry.words", "entry.counts").toDF("block", "place", "word", "n")
    counts = entries.groupBy("word").agg(F.sum("n").alias("c"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def row() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array([current], pa.int64()), "known": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

        for batch in batches:
            blocks_, found = batch.column("block").to_numpy(), batch.column("c").to_numpy()
            edges = np.flatnonzero(np.diff(blocks_)) + 1
            for first, last in zip([0, *edges], [*edges, len(blocks_)]):
                if first == last:
                    continue
                if blocks_[first] != current and parts:
                    yield row()
                    parts = []
                current = int(blocks_[first])
                parts.append(found[first:last].astype("<i8"))
        if parts:
            yield row()

    back = entries.select("block", "place", "word").join(counts, "word").select("block", "place", "c")
    dealt = back.repartition("block").sortWithinPartitions("block", "place")
    return counts, dealt.mapInArrow(gather, "block long, known binary")


def score_documents(
    docs: DataFrame, *, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, parts: int = 7, held: int = 2, block: int = BLOCK
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Learns from the rows whose id does not fall in part ``held`` of ``parts``; rows without an id
    are scored but taught nothing and count as not held out. A null or empty text is its end
    symbol alone. Scores are base-10 logarithms: base_score of the smoothed word frequencies,
    score of the hidden Markov model. Repeated rows are scored (and taught) each; other columns
    are ignored. Without training rows every word is as likely as no other: both scores are finite.
    """
    with workspace(docs.sparkSession):
        return lasting(_scored(docs, states, classes, rounds, parts, held, block), "lm-scores")


def _scored(docs: DataFrame, states: int, classes: int, rounds: int, parts: int, held: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    part = remainder(F.col("doc_id"), parts)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(part != held, F.lit(False)).alias("training"))
    blocks = staged(_blocks(taught, classes, block), "lm-blocks")
    model = train(blocks, states=states, classes=classes, rounds=rounds)
    counts, known = _word_counts(blocks)
    known = staged(known, "lm-known")

    # Totals per class, from each block's dictionary: a word counts as known once over all blocks.
    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_class_of(one, classes) for one in batch.column("word").to_pylist()], dtype=np.int32)
            c = batch.column("c").to_numpy()
            tokens = np.bincount(found, c, classes + 1).astype(np.int64)
            filled = np.flatnonzero(tokens)
            yield pa.record_batch({
                "class": pa.array(filled.astype(np.int32)), "tokens": pa.array(tokens[filled]),
                "words": pa.array(np.bincount(found, minlength=classes + 1)[filled].astype(np.int64)),
            })

    totals = counts.where("c > 0").select("word", "c").mapInArrow(kinds, "class int, tokens long, words long")
    totals = totals.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    in_class = np.zeros(classes + 1)
    tokens, words = totals.column("tokens").to_numpy(), totals.column("words").to_numpy()
    in_class[totals.column("class").to_numpy()] = tokens + words
    n, v = int(tokens.sum()), int(words.sum())
    shared = spark.sparkContext.broadcast((model, np.log10(in_class + 1), np.log10(n + v + 1), n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, class_total, total, n = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: np.frombuffer(batch.column(name)[at].as_buffer(), kind) for name, kind in (("lengths", "<i4"), ("tokens", "<i4"), ("classes", "<i4"), ("known", "<i8"))}
                doc_ids = batch.column("doc_ids")[at].values
                lengths = row["lengths"].astype(np.int64)
                ends = np.cumsum(lengths)
                weight = np.log10(row["known"] + 1.0)
                inside = weight - class_total[row["classes"]]
                for some in _batches_of(lengths):
                    first, last = ends[some.start] - lengths[some.start], ends[some.stop - 1]
                    own, size = row["tokens"][first:last], lengths[some]
                    starts = np.cumsum(size) - size
                    hidden, _, _ = _Batch(row["classes"][own], size).forward(model)
                    yield pa.record_batch({
                        "doc_id": doc_ids.slice(some.start, len(size)),
                        "n_tokens": pa.array(size),
                        "n_known": pa.array(np.add.reduceat((row["known"][own] > 0).astype(np.int64), starts)),
                        "train_tokens": pa.array([n] * len(size), pa.int64()),
                        "base_score": pa.array(np.add.reduceat(weight[own] - total, starts)),
                        "score": pa.array(hidden / np.log(10) + np.add.reduceat(inside[own], starts)),
                    })

    rows = blocks.select("block", "doc_ids", "lengths", "tokens", "classes").join(known.hint("shuffle_hash"), "block").drop("block")
    scored = rows.mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    held_out = F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
