"""Language identification with bit-sliced Bloom filters of character n-grams.

Every letter of a lower-cased text gives one n-gram: itself with its two neighbours,
where anything but a letter counts as a word boundary. One table of bit masks holds a
Bloom filter per language side by side, so a single look-up of an n-gram answers for all
languages at once. A text's score for a language is the share of its n-grams that the
language's filter holds, corrected for the filter's false positives.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
HASHES = 4
# n-grams a language's filter takes at most, and all filters together: the size of the model.
MOST_NGRAMS, MOST_TOGETHER = 50_000, 1 << 20
# A language holds an n-gram that makes up this share of its letters at least, and whose
# share is at least this part of the share in the language where it is most common.
LEAST_SHARE, LEAST_PART = 2e-6, 0.2
# Characters worked on at once; longer texts are read in pieces cut at a space.
PIECE = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(sys.maxunicode + 1)], dtype=bool)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(position of the text, piece of it) for every text, long ones in several pieces."""
    for at, text in enumerate(texts):
        start, text = 0, text or ""
        while len(text) - start > PIECE:
            cut = text.rfind(" ", start + 1, start + PIECE)
            end = cut if cut > 0 else start + PIECE
            yield at, text[start:end]
            start = end
        yield at, text[start:]


def _groups(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Pieces gathered up to PIECE characters, with the positions of their texts."""
    places, pieces, held = [], [], 0
    for at, piece in _pieces(texts):
        if held + len(piece) > PIECE and pieces:
            yield np.array(places), pieces
            places, pieces, held = [], [], 0
        places.append(at)
        pieces.append(piece)
        held += len(piece)
    if pieces:
        yield np.array(places), pieces


def ngrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the pieces as 63-bit keys, and where those of each piece start."""
    lowered = [piece.lower() for piece in pieces]
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.concatenate(([0], np.cumsum([len(piece) + 1 for piece in lowered])[:-1])).astype(np.int64)
    letters = _is_letter()[codes]
    keys = np.where(letters, codes, 0).astype(np.uint64)
    middle = np.flatnonzero(letters)
    found = (keys[middle - 1] << np.uint64(42)) | (keys[middle] << np.uint64(21)) | keys[middle + 1]
    return found, np.searchsorted(middle, starts)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches that start at ``starts``, zero for empty ones."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[np.append(starts[1:], len(values))] - total[starts]


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, ngram, n of a partition; languages are counted apart and merged as they grow."""
    found: dict[str, list[np.ndarray]] = {}

    def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([part[0] for part in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([part[1] for part in parts])).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[at] for at in np.flatnonzero(langs == lang)]
            for _, pieces in _groups(own):
                keys, counts = np.unique(ngrams(pieces)[0], return_counts=True)
                parts = found.setdefault(lang, [])
                parts.append((keys, counts))
                if len(parts) == 16:
                    found[lang] = [merged(parts)]
    for lang, parts in found.items():
        keys, counts = merged(parts)
        for at in range(0, len(keys), 1 << 16):
            some = slice(at, at + (1 << 16))
            ngram = pa.array(keys[some].astype(np.int64))
            yield pa.record_batch({"lang": pa.array([lang] * len(ngram), pa.string()), "ngram": ngram, "n": pa.array(counts[some])})


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over all bits (multiply and shift twice)."""
    mixed = keys.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    mixed = _mixed(keys)
    first, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    for number in range(HASHES):
        yield ((first + np.uint64(number) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """Languages, most common first; table[slot, word] has one bit per language."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and share of n-grams in its filter; ties go to the more common language."""
        letters = np.zeros(len(texts), dtype=np.int64)
        held = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for places, pieces in _groups(texts):
            keys, starts = ngrams(pieces)
            masks = None
            for slots in _places(keys, len(self.table)):
                found = self.table[slots]
                masks = found if masks is None else masks & found
            np.add.at(letters, places, np.diff(np.append(starts, len(keys))))
            for at in range(len(self.languages)):
                bits = (masks[:, at // 8] >> np.uint8(at % 8)) & np.uint8(1)
                np.add.at(held[:, at], places, _sums(bits, starts))
        share = held / np.maximum(letters, 1)[:, None]
        score = np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = score.argmax(axis=1)
        named = [self.languages[at] if any_ else UNDETERMINED for at, any_ in zip(best, letters > 0)]
        return named, np.where(letters > 0, score[np.arange(len(texts)), best], 0.0).tolist()


def train(labelled: DataFrame) -> LanguageModel:
    """Fit filters to all rows of ``labelled`` (text, lang) that have both."""
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count_ngrams, "lang string, ngram long, n long")
    counts = counts.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    totals = {row["lang"]: row["total"] for row in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals, key=lambda lang: (-totals[lang], lang))
    if not languages:
        return LanguageModel([], np.zeros((1, 1), np.uint8), np.zeros(0))
    sizes = counts.sparkSession.createDataFrame(list(totals.items()), "lang string, total long")
    share = counts.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = F.max("share").over(Window.partitionBy("ngram"))
    kept = share.withColumn("most", most).where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_PART * F.col("most")))
    limit = max(1, min(MOST_NGRAMS, MOST_TOGETHER // len(languages)))
    by_share = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    chosen = kept.withColumn("rank", F.row_number().over(by_share)).where(F.col("rank") <= limit)
    found = chosen.select("lang", "ngram").toArrow()
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    keys = found.column("ngram").to_numpy().astype(np.uint64)
    largest = max((int((lang == name).sum()) for name in languages), default=1)
    size = 1 << max(10, (16 * largest - 1).bit_length())
    table = np.zeros((size, -(-len(languages) // 8)), dtype=np.uint8)
    rates = np.zeros(len(languages))
    for at, name in enumerate(languages):
        for slots in _places(keys[lang == name], size):
            table[slots, at // 8] |= np.uint8(1 << at % 8)
        rates[at] = (((table[:, at // 8] >> np.uint8(at % 8)) & 1).mean()) ** HASHES
    return LanguageModel(languages, table, rates)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score.

    lang_pred is ``und`` and score 0 for a null text, one without a letter, and where the
    model knows no language. Columns of these names are replaced; each row is judged alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Only the text goes to the Python workers, and only the verdict comes back.
    @F.arrow_udf("lang_pred string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        named, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    kept = [F.col(f"`{name}`") for name in docs.drop("lang_pred", "score").columns]
    judged = docs.select(*kept, judge(F.col(text)).alias("_judged_"))
    return judged.select(*kept, "_judged_.lang_pred", "_judged_.score")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def identify_documents(docs: DataFrame, *, parts: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents (doc_id, text, lang).

    Learns from the rows whose id does not fall in part 0 and that have a language; rows
    without an id are judged but taught nothing and count as not held out.
    """
    part = remainder(F.col("doc_id"), parts)
    model = train(docs.where(part != 0))
    rows = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).drop("text")
