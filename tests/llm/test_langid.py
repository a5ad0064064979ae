from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.helpers import documents
from tradelark.llm import langid


def test_ngrams_are_letters_with_their_neighbours():
    keys, starts = langid.ngrams(["Ab c", "", "1 2", "é"])
    code = lambda a, b, c: (ord(a) << 42 if a else 0) | (ord(b) << 21) | (ord(c) if c else 0)
    assert keys.tolist() == [code("", "a", "b"), code("a", "b", ""), code("", "c", ""), code("", "é", "")]
    assert starts.tolist() == [0, 3, 3, 3]


def test_held_out_accuracy_on_whole_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {row.doc_id: row for row in langid.identify_documents(docs).collect()}
    truth = pq.read_table(f"{small}/documents.parquet").select(["doc_id", "lang"]).to_pylist()
    assert len(found) == len(truth)
    held = [row for row in truth if zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0]
    assert all(found[row["doc_id"]].held_out == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) for row in truth)
    assert np.mean([found[row["doc_id"]].lang_pred == row["lang"] for row in held]) > 0.97
    assert all(0 <= row.score <= 1 for row in found.values())


def test_odd_rows(spark):
    learned = [(at, "the cat and the dog " * 3, "en") for at in range(8)] + [(20 + at, "øl på skål ", "da") for at in range(8)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 !? 34", "en"), (103, "the dog", None), (None, "skål", "da"), (103, "the dog", None)]
    docs = documents(spark, learned + odd)
    found = langid.identify_documents(docs.withColumnRenamed("source", "score")).collect()
    assert len(found) == len(learned) + len(odd)
    by_id = {row.doc_id: row for row in found}
    assert [by_id[at].lang_pred for at in (100, 101, 102)] == ["und"] * 3
    assert [by_id[at].score for at in (100, 101, 102)] == [0.0] * 3
    assert by_id[103].lang_pred == "en" and by_id[None].lang_pred == "da" and by_id[None].held_out is False


def test_long_text_is_read_whole(spark):
    model = langid.train(documents(spark, [(1, "the cat and the dog", "en"), (2, "øl på skål", "da")]))
    long_ = "the cat " * 20 + "x" * (langid.PIECE + 10) + " skål på øl" * langid.PIECE
    named, scores = model.predict([long_, "the cat"])
    assert named == ["da", "en"] and scores[1] == pytest.approx(1.0, abs=0.1)


def test_empty_tables(spark):
    assert langid.identify_documents(documents(spark, [])).collect() == []
    unlabelled = documents(spark, [(1, "text", None)])
    assert [tuple(row) for row in langid.identify_documents(unlabelled).collect()] == [(1, False, "und", 0.0)]
