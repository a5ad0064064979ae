from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, edited, sentence, without_repeats, words
from tradelark.llm import dedup, suffixes
from tradelark.llm.queries import QUERIES


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60).map(lambda data: bytes(byte % 3 for byte in data)), st.sampled_from([1, 8, 9, 20, 40]))
def test_suffix_array_and_prefixes(data, depth):
    values = np.frombuffer(data, np.uint8)
    array = suffixes.suffix_array(values, depth)
    full = data + b"\0" * 500
    heads = [full[at : at + depth] for at in array]
    assert sorted(array.tolist()) == list(range(len(data))) and heads == sorted(heads)
    shared = suffixes.common_prefixes(values, array, depth, lanes=7)
    for at in range(1, len(data)):
        one, two = heads[at - 1], heads[at]
        agree = next((n for n in range(depth) if one[n] != two[n]), depth)
        assert shared[at] == agree


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=30, max_size=80).map(lambda data: bytes(byte % 2 for byte in data)), st.binary(min_size=30, max_size=80).map(lambda data: bytes(byte % 2 for byte in data)))
def test_shards_meet_by_binary_search(one, two):
    depth = 10
    shards = [suffixes.Shard(np.frombuffer(data, np.uint8), np.arange(len(data)) <= len(data) - depth, depth) for data in (one, two)]
    shards[0].meet(shards[1])
    for data, other, shard in ((one, two, shards[0]), (two, one, shards[1])):
        windows = [data[at : at + depth] for at in range(len(data) - depth + 1)]
        others = {other[at : at + depth] for at in range(len(other) - depth + 1)}
        wanted = [at for at, own in enumerate(windows) if windows.count(own) > 1 or own in others]
        assert sorted(shard.repeated_windows().tolist()) == wanted


DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def corpus():
    passage, common = sentence(1, 60), sentence(2, 35)
    rows = [(at, sentence(100 + at, 20 + at % 30)) for at in range(40)]
    rows += [(50 + at, f"{sentence(200 + at, 15)} {passage} {sentence(300 + at, at)}") for at in range(12)]
    rows += [(70 + at, edited(sentence(5, 120), at, 4)) for at in range(15)]
    rows += [(90 + at, f"{common[at:]} {sentence(400 + at, 9)} {common}") for at in range(10)]
    rows += [(120, None), (121, ""), (122, sentence(7, 80)), (123, sentence(7, 80)), (123, sentence(7, 80)), (None, sentence(8, 50)), (None, sentence(8, 50))]
    rows += [(130, "ab" * 300), (131, "é" * 200 + sentence(9, 30)), (132, "x " + "é" * 150), (133, sentence(11, 4000) + passage)]
    random.Random(3).shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"shard": 600}, {"most_runs": 1}, {"most_runs": 3, "shard": 200}])
def test_every_repeated_byte_goes(spark, options):
    rows = corpus()
    docs = documents(spark, rows).repartition(4).withColumnsRenamed({"source": "t", "n_chars": "spans"})
    found = dedup.passage_digest(docs, window=100, anchor=16, **options).collect()
    wanted = [(row[0], *rest) for row, rest in zip(rows, without_repeats([row[1] for row in rows], 100))]
    key = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    assert sorted((tuple(row[:5]) for row in found), key=key) == sorted(wanted, key=key)
    # What is left, but for bytes of a character cut in two.
    texts = {(row[0], row[1]) for row in rows}
    for row in found:
        if row.text is None or not row.n_removed:
            assert (row.doc_id, row.text) in texts
        else:
            assert len(row.text.encode()) <= row.n_bytes - row.n_removed and "\ufffd" not in row.text
            assert "é" in row.text or hashlib.sha256(row.text.encode()).hexdigest() == row.kept_sha256


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE_BITS", 10)
    texts = [sentence(1, 700).encode(), sentence(2, 30).encode() + sentence(1, 700).encode()[900:2100] + sentence(3, 400).encode()]
    runs = dedup._runs(texts, 100, 16)
    covered = [np.zeros(len(text) - 99, int) for text in texts]
    for text, first, last in zip(runs["text"], runs["first"], runs["last"]):
        covered[text][first : last + 1] += 1
    assert all((own == 1).all() for own in covered)


def test_texts_without_passages_keep_all_columns(spark):
    passage = sentence(1, 60)
    rows = [(1, f"é {passage} end"), (2, f"start {passage}"), (3, "short"), (4, None)]
    docs = documents(spark, rows).withColumnsRenamed({"source": "t", "lang": "kept"})
    left = dedup.without_passages(docs, window=100, anchor=16)
    assert left.columns == docs.columns
    found = {row.doc_id: row.text for row in left.collect()}
    assert found[3] == "short" and found[4] is None
    assert found[1].startswith("é") and found[1].endswith("end") and len(found[1]) < 12 and found[2].startswith("start")


def test_whole_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 3000")
    rows = [(row.doc_id, row.text) for row in docs.select("doc_id", "text").collect()]
    found = sorted(map(tuple, dedup.passage_digest(docs).select(*DIGEST).collect()))
    assert found == sorted((row[0], *rest) for row, rest in zip(rows, without_repeats([row[1] for row in rows], dedup.WINDOW)))


def without_words(rows, count):
    """Per row the words that are in no string of ``count`` words that also starts anywhere else."""
    own = [words(text) for _, text in rows]
    seen = Counter(tuple(row[at : at + count]) for row in own for at in range(len(row) - count + 1))
    result = []
    for row in own:
        gone = {at + step for at in range(len(row) - count + 1) if seen[tuple(row[at : at + count])] > 1 for step in range(count)}
        result.append([word for at, word in enumerate(row) if at not in gone])
    return result


@pytest.mark.parametrize("options", [{}, {"shard": 600}, {"most_runs": 1}, {"most_runs": 3, "shard": 200}])
def test_text_loses_passages_of_words_too(spark, options):
    rows = corpus() + [(200, sentence(20, 9) + "\n" + sentence(21, 14).upper()), (201, sentence(21, 14).replace(" ", "  ") + " " + sentence(22, 5))]
    # No string of 5,000 bytes repeats, so the text loses words only.
    found = dedup.passage_digest(documents(spark, rows).repartition(3), words=12, window=5000, anchor=16, **options).collect()
    key = lambda row: (row[0] is None, row[0] or 0, row[1])
    wanted = [(row[0], left) for row, left in zip(rows, without_words(rows, 12))]
    assert sorted(((row.doc_id, words(row.text)) for row in found), key=key) == sorted(wanted, key=key)
    assert all(row.n_removed == row.n_spans == 0 for row in found)
    digests = sorted((hashlib.sha256((text or "").encode()).hexdigest() for _, text in rows))
    assert sorted(row.kept_sha256 for row in found) == digests


def test_query_text_loses_51_words_under_400_bytes(spark, tmp_path):
    passage = sentence(31, 51)
    passage = " ".join(word[:6] for word in passage.split())
    assert len(passage.encode()) < dedup.WINDOW
    rows = [(at, f"{sentence(40 + at, 30)} {passage} {sentence(60 + at, 30)}") for at in range(3)] + [(9, sentence(80, 200)), (10, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {row.doc_id: row for row in QUERIES["op7_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    for at in range(3):
        assert words(found[at].text) == words(f"{sentence(40 + at, 30)} {sentence(60 + at, 30)}")
    assert found[9].text == rows[3][1] and found[10].text is None
    # What the contract fixes goes by strings of 400 bytes alone.
    wanted = [(row[0], *rest) for row, rest in zip(rows, without_repeats([row[1] for row in rows], dedup.WINDOW))]
    assert sorted(tuple(row[:5]) for row in found.values()) == wanted and all(row[2] == 0 for row in wanted)


def test_empty_table(spark):
    assert dedup.passage_digest(documents(spark, [])).collect() == []
