"""Token ids of whole texts, and files of ids in variable-length codes.

Encoding: the tokenizer of a file in the format of the ``tokenizers`` library. White
space only separates, so a text's ids are the ids of its words one after the other. Words
repeat, so each worker keeps the ids of those it has seen. Plain texts (printable ASCII and
the accented letters below) are cut by the tokenizer's own pattern and each part goes
straight to the library's model; other texts are cut at white space only, and each chunk
goes through the library's whole pipeline unless it is plain itself.

Files: ids are ranked by their frequency in the corpus, and each rank is stored in one to
four bytes, low byte first, without leading zero bytes. Four lengths share one control
byte (two bits each, first in the lowest); control and data bytes are separate columns.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelark.plans.staging import discard, staged, staging_path

# Words a worker keeps; then it starts anew. Texts it has in hand at once.
MOST_WORDS, TEXTS = 3 << 18, 256
# Token ids a file holds, roughly.
FILE_TOKENS = 1 << 23

# White space the tokenizer's pattern and Python's split agree on.
_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")
# White space (or not) that they treat differently.
_ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# Characters whose normal form is themselves and whose lower case is one letter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-į \t\n\r\x0b\x0c]+")
# The tokenizer's own pattern, for lower-case text of those characters.
_PARTS = re.compile("[a-zß-öø-į]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9ß-öø-į \t\n\r\x0b\x0c]+")


class _Kept(dict):
    """A dictionary that works out what it lacks."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key):
        found = self[key] = self.work(key)
        return found


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, *, split_words: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_words = split_words
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.packed = _Kept(struct.Struct("<I").pack)
        self.letters = _Kept(lambda char: visible.pre_tokenize_str(char)[0][0])
        self.chunks = _Kept(self._chunk)
        self.parts = _Kept(self._part)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        word = part if part.isascii() else "".join(map(self.letters.__getitem__, part))
        return b"".join([self.packed[token.id] for token in self.model.tokenize(word)])

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(token in text for token in self.special)

    def _chunk(self, chunk: str) -> bytes:
        return self._cut(chunk) if self._plain(chunk) else self._whole(chunk)

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.split_words:
            return self._whole(text)
        for kept in (self.chunks, self.parts):
            if len(kept) > MOST_WORDS:
                kept.clear()
        if self._plain(text):
            return self._cut(text)
        chunks = _BLANKS.split(text) if _ODD_BLANKS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, filter(None, chunks)))


def _splits_at_blanks(path: str) -> bool:
    """Whether the file describes the kind of tokenizer that this module takes apart."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    return (
        [step["type"] for step in steps] == ["NFC", "Replace", "Lowercase"]
        and [cut["type"] for cut in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": pattern}
        and spec.get("post_processor") is None
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder for the file, kept between tasks."""
    return Encoder(path, split_words=_splits_at_blanks(path))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def encode_documents(docs: DataFrame, path: str, end: int | None, *, halves: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian 32 bits) of every row of ``docs`` (doc_id, text).

    With ``halves``, all low 16 bits of a row come before all high 16 bits, which are nearly
    always equal and so compress to nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for some in _slices(batches):
            ids = [own.encode(text) + tail for text in some.column("text").to_pylist()]
            if halves:
                ids = [np.frombuffer(one, "<u2").reshape(-1, 2).T.tobytes() for one in ids]
            yield pa.record_batch([some.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary")


def _from_halves(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2").reshape(2, -1).astype("<u4")
    return low | high << 16


# ---------------------------------------------------------------- variable-length codes


@cache
def _stored() -> np.ndarray:
    """Which of the 16 bytes of four numbers are stored under each control byte."""
    codes = np.stack([np.arange(256) >> shift & 3 for shift in (0, 2, 4, 6)], axis=1)
    return (np.arange(4) <= codes[:, :, None]).reshape(256, 16)


def pack_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers; the last group is filled with zeros."""
    padded = np.zeros(-(-len(values) // 4) * 4, dtype="<u4")
    padded[: len(values)] = values
    first, second, third, fourth = sum((padded > most).view(np.uint8) for most in (0xFF, 0xFFFF, 0xFFFFFF)).reshape(-1, 4).T
    control = first | second << 2 | third << 4 | fourth << 6
    return control.tobytes(), padded.view(np.uint8)[_stored()[control].ravel()].tobytes()


def unpack_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again: the places of their bytes come from a table look-up of the control bytes."""
    stored = _stored()[np.frombuffer(control, np.uint8)].ravel()
    every = np.zeros(len(stored), dtype=np.uint8)
    every[stored] = np.frombuffer(data, np.uint8)
    return every.view("<u4")[:count]


def _encoded_and_counted(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, ids (in halves) and counts: null but in one last row per task, which counts its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = int(end).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, doc_type = encoder(path), np.zeros(0, dtype=np.int64), None
        for some in _slices(batches):
            doc_type = some.schema.field("doc_id").type
            parts = [own.encode(text) + tail for text in some.column("text").to_pylist()]
            counts = np.bincount(np.frombuffer(b"".join(parts), "<u4"))
            if len(counts) > len(total):
                counts, total = total, counts
            total[: len(counts)] += counts
            ids = [np.frombuffer(one, "<u2").reshape(-1, 2).T.tobytes() for one in parts]
            yield pa.record_batch([some.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "counts"])
        if doc_type is not None:
            yield pa.record_batch([pa.nulls(1, doc_type), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary, counts binary")


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.column("counts").to_pylist():
            found = np.frombuffer(row, "<i8")
            ids = np.flatnonzero(found)
            yield pa.record_batch({"id": pa.array(ids.astype(np.int64)), "n": pa.array(found[ids])})


def write_token_files(docs: DataFrame, folder: str, path: str, *, end: int, file_tokens: int = FILE_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write ``folder``/tokens and ``folder``/ranks.

    tokens holds one row per document in ascending doc_id order, file by file: position
    (its place in that order), doc_id, n_tokens, control, data. ranks maps each rank to its
    id, the most frequent id first. A null text counts as empty and has the end id only. Null ids
    come first; rows that share an id are all kept, next to each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    written = staged(_encoded_and_counted(docs, path, end), "token-ids")
    encoded = written.where("counts IS NULL")
    counted = written.select("counts").where("counts IS NOT NULL").mapInArrow(_sum_counts, "id long, n long")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted((-row["n"], row["id"]) for row in counts.collect())  # at most the vocabulary
    order = np.array([id_ for _, id_ in found], dtype="<u4")
    rank = np.zeros(int(order.max(initial=0)) + 1, dtype="<u4")
    rank[order] = np.arange(len(order))
    ranks = [(at, int(id_)) for at, id_ in enumerate(order)]
    spark.createDataFrame(ranks, "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")

    files = max(1, -(-sum(-n for n, _ in found) // file_tokens))
    cuts = encoded.agg(F.percentile_approx("doc_id", [at / files for at in range(1, files)] or [0.5], 100 * files + 10_000))
    bounds = np.unique(np.array((cuts.first()[0] or []) if files > 1 else [], dtype=np.int64))
    shared = spark.sparkContext.broadcast((rank, bounds))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bounds = shared.value
        for batch in _slices(batches):
            numbers = [rank[_from_halves(ids)] for ids in batch.column("ids").to_pylist()]
            packed = [pack_numbers(values) for values in numbers]
            doc_ids = batch.column("doc_id")
            low = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.record_batch({
                "file": pa.array(np.searchsorted(bounds, low, side="left").astype(np.int32)),
                "doc_id": doc_ids,
                "n_tokens": pa.array([len(values) for values in numbers], pa.int64()),
                "control": pa.array([control for control, _ in packed], pa.binary()),
                "data": pa.array([data for _, data in packed], pa.binary()),
            })

    rows = encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        encode, "file int, doc_id long, n_tokens long, control binary, data binary"
    )
    dealt = rows.repartitionById(len(bounds) + 1, "file").sortWithinPartitions("file", "doc_id", "n_tokens", F.xxhash64("data"))
    numbered = dealt.select((F.shiftleft(F.col("file").cast("long"), 40) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("position"), "doc_id", "n_tokens", "control", "data")
    numbered.write.option("compression", "none").parquet(f"{folder}/tokens")
    for place in {name.rsplit("/", 1)[0] for name in written.inputFiles()}:
        discard(spark, place)  # only the files are read from here on


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """position, doc_id, n_tokens, ids (binary, little-endian 32 bits) of every stored document."""
    table = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toArrow()  # at most the vocabulary
    shared = spark.sparkContext.broadcast(table.column("id").to_numpy().astype("<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in _slices(batches):
            stored = zip(*(batch.column(name).to_pylist() for name in ("control", "data", "n_tokens")))
            found = [ids[unpack_numbers(*one)].tobytes() for one in stored]
            yield pa.record_batch(
                [*(batch.column(name) for name in ("position", "doc_id", "n_tokens")), pa.array(found, pa.binary())],
                ["position", "doc_id", "n_tokens", "ids"],
            )

    return spark.read.parquet(f"{folder}/tokens").mapInArrow(
        decode, "position long, doc_id long, n_tokens long, ids binary"
    )


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    read = read_token_files(spark, folder).select(
        "position", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.shiftright("position", 40).alias("file")
    )
    stored = spark.read.parquet(f"{folder}/tokens").select("n_tokens", F.shiftright("position", 40).alias("file"))
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, "file")
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, *, end: int = 2) -> DataFrame:
    """Write the files of ``docs`` to the session's shared folder and digest them from there."""
    folder = staging_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, path, end=end)
    return token_digest(docs.sparkSession, folder)

