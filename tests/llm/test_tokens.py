from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents
from tradelark.llm import tokens
from tradelark.llm.queries import tokenizer_path

ODD = [
    "", " ", "a\x1cb \x85 c", "İstanbul ŞÇ ﬁ", "é x", "<|endoftext|>x it's 12 ½ µ ª", "中文 テスト", "a\xa0b　c d", "ǅ Σς ΑΣ",
    "don't we'll I'M x's '", "\x00 a\x01b", "😀 a×b÷c", "ĸŉſ ĳ Ĳ ß ẞ", "a​b﻿", "'s't're", "naïve CAFÉ Ærø <|startoftext|>",
]


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_library(text):
    own = tokens.encoder(tokenizer_path())
    wanted = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.split_words and np.frombuffer(own.encode(text), "<u4").tolist() == wanted


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aB'sé ß12.,\n\x1c\xa0Ç<|>", max_size=40))
def test_same_ids_for_any_text(text):
    own = tokens.encoder(tokenizer_path())
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_codes_round_trip(values):
    array = np.array(values, dtype="<u4")
    control, data = tokens.pack_numbers(array)
    assert len(control) == -(-len(values) // 4)
    assert tokens.unpack_numbers(control, data, len(values)).tolist() == values


def test_codes_are_worked_out_in_bytes():
    values = np.arange(400_000, dtype="<u4") * 11 % 100_003
    control, data = tokens.pack_numbers(values[:8])
    tokens.unpack_numbers(control, data, 8)
    tracemalloc.start()
    control, data = tokens.pack_numbers(values)
    packing = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    found = tokens.unpack_numbers(control, data, len(values))
    unpacking = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert (found == values).all()
    # Lengths as 64-bit numbers take more than twice as much, and the time to fill it.
    assert packing < 20 * len(values) and unpacking < 12 * len(values)


def plain(rows, end=2):
    own = tokens.encoder(tokenizer_path()).tokenizer
    start, found = 0, []
    for doc_id, text in rows:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_files_round_trip_in_order(spark, tmp_path):
    rows = [(at * 7 % 101, f"Text number {at} " + "word " * at) for at in range(100)] + [(500, None), (501, ""), (-3, ODD[5]), (502, "long " * 40000)]
    docs = documents(spark, rows).repartition(5).withColumnRenamed("source", "ids")
    folder = str(tmp_path / "files")
    tokens.write_token_files(docs, folder, tokenizer_path(), end=2, file_tokens=3000)
    found = tokens.token_digest(spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted(plain(sorted(rows)))
    stored = spark.read.parquet(f"{folder}/tokens")
    ids = [row.doc_id for row in stored.orderBy("position").collect()]
    assert ids == sorted(ids) and stored.selectExpr("position >> 40").distinct().count() > 3


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "c"), (4, "same text"), (4, "same text"), (4, "other")]
    found = tokens.token_output(documents(spark, rows), tokenizer_path()).collect()
    assert sorted((row.doc_id is None, row.n_tokens) for row in found) == sorted((at is None, n) for at, _, n, _ in plain(rows))
    ends = sorted((row.start, row.start + row.n_tokens) for row in found)
    assert ends[0][0] == 0 and all(one[1] == two[0] for one, two in zip(ends, ends[1:]))


def test_empty_table(spark):
    assert tokens.token_output(documents(spark, []), tokenizer_path()).collect() == []
