"""Removal of repeated passages: every byte covered by a window that also starts elsewhere.

Windows are told apart by anchors. The anchor of a window is its 32-byte string of
smallest hash (the first of equals); neighbouring windows with the same anchor form a run.
Equal windows have equal anchors at equal places, so they are only ever sought among runs
of one anchor. Runs with all bytes equal are counted as a whole. Where an anchor has runs
that differ, one copy of each is cut out of its text and sent to the anchor's task, which
settles what is equal as a whole and builds suffix arrays over the rest: sorted by doubling,
common prefixes of neighbours, and shards of one anchor merged by binary search. The core
that neighbouring windows share is written as a number there.
The windows of an anchor with more runs than a task should hold are counted by their own
hash instead, spread over all tasks.

A text is known by a 64-bit hash; texts that occur several times are repeated as a whole.

Windows of a number of words are found the same way, in the texts written as word hashes of
equal width; they and their anchors start at words only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.llm.suffixes import Shard
from tradelark.llm.words import byte_keys, mixed, powers, word_starts, words_of
from tradelark.plans.staging import lasting, staged, workspace

WINDOW, ANCHOR = 400, 32
# Bytes of text worked on at once; the low bits of an anchor's key hold its place in them.
PIECE_BITS = 20
# Bytes of a suffix array, and runs of one anchor that a task takes on.
SHARD, MOST_RUNS = 2 << 20, 8192
# Windows of a run are compared with others in stretches of this many.
STRETCH = 64
# Digits of the number that stands for a stretch's core: bytes that UTF-8 does not have.
CORE_DIGITS = 8
# Bytes of a word's hash in texts that are searched by words.
WORD = 6
# Words of a passage where passages are sought by words as well.
PASSAGE_WORDS = 51


def _sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate(([np.uint64(0)], np.cumsum(byte_keys()[data] * powers(len(data))[: len(data)], dtype=np.uint64)))


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hash of the bytes between two places of each pair, whatever the place."""
    value = (sums[end] - sums[start]) * powers(len(sums), True)[start]
    return mixed(value + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _pieces(texts: list[bytes], window: int, step: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Stretches of texts together: text number, place in the text, first byte in the stretch, bytes.

    Pieces of a long text overlap by a window less one step, so each window is in one of them.
    """
    most = ((1 << PIECE_BITS) - 1) // step * step
    number, place, start, parts, held = [], [], [], [], 0
    for at, data in enumerate(texts):
        for first in range(0, max(1, len(data) - window + 1), most - window + step):
            piece = data[first : first + most]
            if len(piece) < window:
                continue
            if held + len(piece) > most:
                yield np.array(number), np.array(place), np.array(start), b"".join(parts)
                number, place, start, parts, held = [], [], [], [], 0
            number.append(at)
            place.append(first)
            start.append(held)
            parts.append(piece)
            held += len(piece)
    if parts:
        yield np.array(number), np.array(place), np.array(start), b"".join(parts)


def _runs(texts: list[bytes], window: int, anchor: int, step: int = 1) -> dict[str, np.ndarray]:
    """All runs: text (number), first and last window, place of the anchor, its hash, the run's hash.

    Windows and anchors start at multiples of ``step``, which the texts and windows have as lengths.
    """
    found: list[tuple] = []
    for number, place, start, data in _pieces(texts, window, step):
        values = np.frombuffer(data, np.uint8)
        sums = _sums(values)
        at = np.arange(0, len(values) - anchor + 1, step)
        keys = _hashes(sums, at, at + anchor)
        full = keys.copy()
        low = np.uint64((1 << PIECE_BITS) - 1)
        keys = (keys & ~low) | at.astype(np.uint64)
        # Smallest key of every stretch of `width` places: of two neighbouring blocks' ends.
        width = (window - anchor) // step + 1
        blocks = -(-len(keys) // width) + 1
        room = np.full(blocks * width, np.iinfo(np.uint64).max)
        room[: len(keys)] = keys
        room = room.reshape(blocks, width)
        ahead = np.minimum.accumulate(room, axis=1).ravel()
        behind = np.minimum.accumulate(room[:, ::-1], axis=1)[:, ::-1].ravel()
        first = np.arange((len(values) - window) // step + 1)
        anchors = (np.minimum(behind[first], ahead[first + width - 1]) & low).astype(np.int64)
        first *= step
        ends = np.append(start[1:], len(values))
        owner = np.searchsorted(start, first, side="right") - 1
        inside = first + window <= ends[owner]
        first, owner, anchors = first[inside], owner[inside], anchors[inside]
        change = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]))))
        last = first[np.append(change[1:], len(first)) - 1]
        head, anchors, owner = first[change], anchors[change], owner[change]
        shift = place[owner] - start[owner]
        run = _hashes(sums, head, last + window, ((anchors - head) << 20) + last - head)
        found.append((number[owner], head + shift, last + shift, anchors + shift, full[anchors // step], run))
    names = ("text", "first", "last", "anchor", "key", "run")
    columns = [np.concatenate(parts) for parts in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
    return dict(zip(names, columns))


def _bytes(texts: list) -> list[bytes]:
    return [text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"" for text in texts]


def _slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _find_runs(base: DataFrame, window: int, anchor: int, step: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            runs = _runs(_bytes(batch.column("text").to_pylist()), window, anchor, step)
            yield pa.record_batch({
                "t": batch.column("t").take(pa.array(runs["text"].astype(np.int64))),
                "key": pa.array(runs["key"].view(np.int64)),
                "run": pa.array(runs["run"].view(np.int64)),
                **{name: pa.array(runs[name].astype(np.int32)) for name in ("first", "last", "anchor")},
            })

    return base.select("t", "text").mapInArrow(find, "t long, key long, run long, first int, last int, anchor int")


def _cut_out(texts: DataFrame, window: int) -> DataFrame:
    """The bytes of every wanted run (column runs of ``texts``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for text, t, runs in zip(_bytes(batch.column("text").to_pylist()), batch.column("t").to_pylist(), batch.column("runs").to_pylist()):
                rows += [(x["key"], x["run"], t, x["first"], x["anchor"], x["n"], x["large"], text[x["first"] : x["last"] + window]) for x in runs]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            names = ["key", "run", "t", "first", "anchor", "n", "large", "bytes"]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, kinds)], names)

    return texts.mapInArrow(
        cut, "key long, run long, t long, first int, anchor int, n long, large boolean, bytes binary"
    )


def _spans(t: list, start: list, end: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["t", "start", "end"])


def _stretch(window: int, step: int) -> int:
    """Bytes by which the first and the last start in a stretch differ, and a step."""
    return max(step, min(STRETCH, window // 2) // step * step)


def _core_number(number: int) -> bytes:
    return bytes(0xF8 | number >> 3 * digit & 7 for digit in range(CORE_DIGITS))


def _stretches(runs: list[dict], window: int, step: int, cores: Iterator[int]) -> tuple[list[tuple], list[tuple]]:
    """Stretches of windows (run, first, last) known to be repeated, and those to be compared, with their bytes.

    Windows of an anchor are cut into stretches by the place of the anchor in them; all
    windows of a stretch share a core. Only stretches with a core that another run has can
    hold repeated windows. Where two runs have the same bytes all over, their windows are
    repeated as a whole. What is left to compare is one of each content of a core. There a
    number stands for the core, which makes all its windows shorter by as much: windows are
    only ever equal to others with the same core at the same place.
    """
    stretch = _stretch(window, step)
    length = window - stretch + step
    found: dict[tuple, dict[tuple, list[tuple]]] = {}
    for at, run in enumerate(runs):
        lead = run["anchor"] - run["first"]  # the anchor's place in the first window
        data = run["bytes"]
        for number in range(lead // stretch, -1, -1):
            most = min(lead, number * stretch + stretch - step)
            least = max(lead - (len(data) - window), number * stretch, 0)
            if most < least:
                continue
            start = lead - number * stretch
            core = data[start : start + length]
            content = (most, data[lead - most : start], data[start + length : lead - least + window])
            found.setdefault((number, core), {}).setdefault(content, []).append((at, lead - most, lead - least))
    known, compared = [], []
    for contents in found.values():
        name = _core_number(next(cores)) if len(contents) > 1 else b""
        for (_, before, behind), places in contents.items():
            if len(places) > 1:
                known += places
            if len(contents) > 1:
                compared.append((*places[0], before + name + behind))
    return known, compared


def _shards(groups: Iterator[list[tuple]], window: int, shard: int, step: int) -> Iterator[tuple[list, list[Shard]]]:
    """Suffix arrays of the stretches to compare; anchors share a shard until it is full.

    The stretches of one anchor that do not fit a shard make several, yielded together.
    """
    waiting: list[tuple[dict, int, int, bytes]] = []
    held = 0
    depth = _stretch(window, step) - step + CORE_DIGITS

    def build(items: list[tuple[dict, int, int, bytes]]) -> tuple[list, Shard]:
        data = np.frombuffer(b"".join(written for *_, written in items), np.uint8)
        lengths = np.array([len(written) for *_, written in items])
        starts = np.cumsum(lengths) - lengths
        valid = np.zeros(len(data), bool)
        for start, (_, first, last, _) in zip(starts, items):
            valid[start : start + last - first + 1 : step] = True
        return [items, starts], Shard(data, valid, depth)

    for kept in groups:
        size = sum(len(written) for *_, written in kept)
        if size > shard:
            parts, some, used = [], [], 0
            for item in kept:
                if used > shard:
                    parts.append(build(some))
                    some, used = [], 0
                some.append(item)
                used += len(item[3])
            parts.append(build(some))
            yield [part[0] for part in parts], [part[1] for part in parts]
            continue
        if held + size > shard and waiting:
            place, one = build(waiting)
            yield [place], [one]
            waiting, held = [], 0
        waiting += kept
        held += size
    if waiting:
        place, one = build(waiting)
        yield [place], [one]


def _by_suffixes(cut: DataFrame, window: int, shard: int, step: int) -> DataFrame:
    """t, start, end of what is repeated in runs that occur once, by suffix arrays."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: dict[int, dict] = {}
        current = None
        for batch in _slices(batches, 1024):
            for row in batch.to_pylist():
                if row["key"] != current and held:
                    yield list(held.values())
                    held = {}
                current = row["key"]
                held.setdefault(row["run"], row)
        if held:
            yield list(held.values())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[tuple[int, int, int]] = []
        cores = count()

        def open_groups() -> Iterator[list[tuple]]:
            for runs in groups(batches):
                known, compared = _stretches(runs, window, step, cores)
                for at, first, last in known:
                    if runs[at]["n"] == 1:
                        settled.append((runs[at]["t"], runs[at]["first"] + first, runs[at]["first"] + last + window))
                if compared:
                    yield [(runs[at], *rest) for at, *rest in compared]

        for places, shards in _shards(open_groups(), window, shard, step):
            if settled:
                yield _spans(*zip(*settled))
                settled.clear()
            for at, one in enumerate(shards):
                for other in shards[at + 1 :]:
                    one.meet(other)
            for (items, starts), one in zip(places, shards):
                t, start, end = [], [], []
                windows = np.sort(one.repeated_windows())
                if not len(windows):
                    continue
                breaks = np.flatnonzero(np.diff(windows, prepend=-2 * step) != step)
                for first, last in zip(windows[breaks], windows[np.append(breaks[1:], len(windows)) - 1]):
                    # A stretch of repeated windows lies within one run: runs' last windows are longer than a step.
                    run, offset, *_ = items[np.searchsorted(starts, first, side="right") - 1]
                    begin = starts[np.searchsorted(starts, first, side="right") - 1]
                    if run["n"] == 1:
                        t.append(run["t"])
                        start.append(run["first"] + offset + int(first - begin))
                        end.append(run["first"] + offset + int(last - begin) + window)
                yield _spans(t, start, end)
        if settled:
            yield _spans(*zip(*settled))

    dealt = cut.where("NOT large").repartition("key").sortWithinPartitions("key", "run")
    return dealt.mapInArrow(search, "t long, start int, end int")


def _by_windows(cut: DataFrame, window: int, step: int) -> DataFrame:
    """The same for anchors with too many runs: every window is counted under its own hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                at = np.arange(0, len(data) - window + 1, step)
                value = _hashes(_sums(data), at, at + window, at * 0 + window).view(np.int64)
                size = len(at)
                yield pa.record_batch({
                    "key": pa.array([row["key"]] * size, pa.int64()), "value": pa.array(value), "n": pa.array([row["n"]] * size, pa.int64()),
                    "t": pa.array([row["t"]] * size, pa.int64()), "start": pa.array((row["first"] + at).astype(np.int32)),
                })

    windows = cut.where("large").dropDuplicates(["key", "run"]).mapInArrow(explode, "key long, value long, n long, t long, start int")
    often = windows.groupBy("key", "value").agg(F.sum("n").alias("often")).where("often > 1")
    single = windows.where("n = 1").join(often, ["key", "value"])
    return single.select("t", "start", (F.col("start") + window).alias("end"))


def _passage_spans(
    base: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD, most_runs: int = MOST_RUNS, step: int = 1
) -> DataFrame:
    """t and spans (start, end) of every text of ``base`` (doc_id, text, t, n_bytes) that loses something."""
    long_ = base.where(F.col("n_bytes") >= window).withColumn("_id", F.col("doc_id").cast("string"))
    copies = staged(long_.groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.min("_id").alias("one_id")), "text-copies")
    runs = staged(_find_runs(long_, window, anchor, step), "runs", settle=True)
    same = runs.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "first", "last", "anchor")).alias("one"))
    shared = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    met = staged(same.join(shared, "key"), "shared-runs", settle=True)
    known = runs.join(met.where("n > 1").select("key", "run"), ["key", "run"]).select("t", F.col("first").alias("start"), (F.col("last") + window).alias("end"))
    open_keys = met.where("kinds > 1")
    wanted = open_keys.select("key", "run", F.least("n", F.lit(2)).alias("n"), (F.col("kinds") > most_runs).alias("large"), "one.*")
    by_text = wanted.groupBy("t").agg(F.collect_list(F.struct("key", "run", "first", "last", "anchor", "n", "large")).alias("runs"))
    # Texts that occur several times go as a whole; runs that occur once are in others.
    single = copies.where("copies = 1").select("t")
    known = staged(known.join(single, "t", "left_semi"), "known-spans", settle=True)
    # One row of each text with wanted runs is read: the texts are the large side of a hashed
    # join, dealt by text and id, so that copies are spread and dropped there.
    one_id = F.coalesce("one_id", F.lit("")).alias("one_id")
    taking_part = by_text.join(copies.select("t", one_id), "t")
    texts = long_.select("t", F.coalesce("_id", F.lit("")).alias("one_id"), "text")
    texts = texts.join(taking_part.hint("shuffle_hash"), ["t", "one_id"]).select("t", "text", "runs")
    cut = staged(_cut_out(texts, window), "cut-runs", settle=True)
    found = _by_suffixes(cut, window, shard, step).unionByName(_by_windows(cut, window, step))
    spans = known.unionByName(found).distinct().groupBy("t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return spans.unionByName(copies.where("copies > 1").select("t", all_of_it.alias("spans")))


def _with_text_key(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"t": F.xxhash64(data), "n_bytes": F.octet_length(data).cast("long")})


def _as_words(base: DataFrame, words: int) -> DataFrame:
    """``base`` with each text of ``words`` words or more written as word hashes; t stays that of the text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes, counts = words_of(batch.column("text").to_pylist())
            data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()
            ends = np.cumsum(counts) * WORD
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "t": batch.column("t"),
                "text": pa.array([data[end - n * WORD : end] for n, end in zip(counts.tolist(), ends.tolist())], pa.binary()),
                "n_bytes": pa.array(counts * WORD, pa.int64()),
            })

    # Words and the gaps between them take two bytes each, but for one gap.
    long_ = base.where(F.col("n_bytes") >= 2 * words - 1).select(F.col("doc_id").cast("string").alias("doc_id"), "t", "text")
    return long_.mapInArrow(write, "doc_id string, t long, text binary, n_bytes long").where(F.col("n_bytes") >= words * WORD)


def _all_spans(base: DataFrame, words: int | None, **options) -> DataFrame:
    """t, spans and, with ``words``, word_spans (in word hashes) of the texts of ``base`` that lose something."""
    with workspace(base.sparkSession):
        spans = lasting(_passage_spans(base, **options), "byte-spans")
    if not words:
        return spans.withColumn("word_spans", F.lit(None).cast(spans.schema["spans"].dataType))
    anchor = min(ANCHOR // WORD, words) * WORD
    with workspace(base.sparkSession):
        coded = staged(_as_words(base, words), "texts-as-words")
        found = _passage_spans(coded, **{**options, "window": words * WORD, "anchor": anchor, "step": WORD})
        found = lasting(found.withColumnRenamed("spans", "word_spans"), "word-spans")
    return spans.join(found, "t", "full")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted((span["start"], span["end"]) for span in spans or ()):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _outside(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in sorted(gone):
        parts.append(text[at:start])
        at = max(at, end)
    return b"".join([*parts, text[at:]])


def _without(text: bytes, gone: list[tuple[int, int]], word_spans: list[dict] | None) -> bytes:
    """The text without merged spans of bytes and spans of word hashes; a gap goes with the word before it."""
    if word_spans:
        places = np.append(word_starts(text), len(text))
        gone = gone + [(int(places[start // WORD]), int(places[end // WORD])) for start, end in _merged(word_spans)]
    return _outside(text, gone)


_GONE = "struct<n_removed: long, n_spans: long, kept_sha256: string, kept: binary>"


def _gone(text: pa.Array, spans: pa.Array, word_spans: pa.Array) -> pa.Array:
    """What the spans of bytes remove, and the text without spans of words as well; null where there are none."""
    rows = []
    for at, (byte, word) in enumerate(zip(spans.to_pylist(), word_spans.to_pylist())):
        if not byte and not word:
            rows.append(None)
            continue
        (own,) = _bytes([text[at].as_py()])
        gone = _merged(byte)
        left = _outside(own, gone)
        rows.append({
            "n_removed": len(own) - len(left), "n_spans": len(gone), "kept_sha256": hashlib.sha256(left).hexdigest(),
            "kept": _without(own, gone, word) if word else left,
        })
    kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.array(rows, pa.struct(list(kinds.items())))


def passage_digest(docs: DataFrame, *, words: int | None = None, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, a null text is empty. Removed is each byte covered by a string of
    ``window`` bytes that also starts anywhere else, in another row or the same; repeated
    rows of that length so lose everything. The digest is of all bytes left. text is what is
    left (a null text stays null), without bytes of a character that was cut in two; with
    ``words`` it also loses strings of that many words that start anywhere else, which the
    other columns do not count. Other columns are ignored.
    """
    base = _with_text_key(docs.select("doc_id", "text"))
    rows = base.join(_all_spans(base, words, **options).hint("shuffle_hash"), "t", "left")
    gone = F.arrow_udf(_gone, _GONE)
    whole = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    taking_part = F.col("spans").isNotNull() | F.col("word_spans").isNotNull()
    rows = rows.select("doc_id", "n_bytes", "text", gone(F.when(taking_part, F.col("text")), "spans", "word_spans").alias("gone"))
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "n_bytes", "text", whole.alias("whole"), "gone.*").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), _text_left(),
    )


def _text_left() -> Column:
    """``kept`` as text where it is known, else ``text``; a null text stays null."""
    kept = F.col("kept").cast("string")
    # Only where a character was cut: a replacement character of the text's own stays.
    repaired = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    return F.when(F.col("text").isNotNull(), F.coalesce(repaired, "text")).alias("text")


def without_passages(docs: DataFrame, *, words: int | None = None, **options) -> DataFrame:
    """All rows and columns of ``docs``, the text without its repeated passages.

    With ``words``, strings of that many words that also start anywhere else go as well, in
    whatever case and white space. Both kinds are sought in the whole texts. Bytes of a
    character that a passage cut in two are left out. A null text stays null.
    """
    others = F.struct(*(name for name in docs.columns if name != "text"), F.lit(0).alias("_")).alias("others")
    base = _with_text_key(docs.select("doc_id", "text", others))
    spans = _all_spans(base.drop("others"), words, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            kept = []
            for at, (byte, word) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("word_spans").to_pylist())):
                kept.append(_without(*_bytes([batch.column("text")[at].as_py()]), _merged(byte), word) if byte or word else None)
            yield pa.record_batch({
                "others": batch.column("others"), "text": batch.column("text"), "kept": pa.array(kept, pa.binary()),
            })

    rows = base.select("t", "text", "others").join(spans, "t", "left").select("others", "text", "spans", "word_spans")
    schema = rows.select("others", "text").schema.add("kept", "binary")
    rows = rows.mapInArrow(cut, schema)
    return rows.select(*(_text_left() if name == "text" else F.col("others").getField(name).alias(name) for name in docs.columns))
