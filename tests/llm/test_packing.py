from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, sentence
from tradelark.llm import packing, tokens
from tradelark.llm.queries import tokenizer_path


def fewest_bins(sizes, capacity):
    """By trying everything."""
    best = len(sizes)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(sizes):
            best = len(rooms)
            return
        for bin_ in range(len(rooms)):
            if rooms[bin_] >= sizes[at]:
                place(at + 1, rooms[:bin_] + [rooms[bin_] - sizes[at]] + rooms[bin_ + 1 :])
        place(at + 1, [*rooms, capacity - sizes[at]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_bound_holds_and_packing_fits(sizes):
    array = np.array(sizes, dtype=np.int64)
    bins, offsets = packing.best_fit_decreasing(array, 12)
    used = len(set(bins.tolist()))
    assert packing.lower_bound(array, 12) <= fewest_bins(sorted(sizes, reverse=True), 12) <= used
    for bin_ in set(bins.tolist()):
        inside = sorted((o, s) for o, s, b in zip(offsets.tolist(), sizes, bins.tolist()) if b == bin_)
        assert [o for o, _ in inside] == np.cumsum([0] + [s for _, s in inside])[:-1].tolist()
        assert sum(s for _, s in inside) <= 12


def test_dual_feasible_functions_see_more_than_the_sum():
    assert packing.lower_bound(np.array([7, 7, 7, 7]), 12) == 4
    assert packing.lower_bound(np.array([5] * 7), 12) == 4
    assert packing.lower_bound(np.zeros(0, np.int64), 12) == 0


def check(rows, found, length):
    own = tokens.encoder(tokenizer_path()).tokenizer
    wanted = []
    for doc_id, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        wanted += [(doc_id, at // length, at, tuple(ids[at : at + length])) for at in range(0, len(ids), length)]
    key = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    seen = [(r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found]
    assert sorted(seen, key=key) == sorted(wanted, key=key)
    assert all(r.length == len(r.ids) // 4 for r in found)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in sequences.values():
        inside.sort()
        assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()
        assert sum(n for _, n in inside) <= length
    return len(sequences), -(-sum(len(ids) for *_, ids in wanted) // length)


@pytest.mark.parametrize("window", [300, 2000, 1 << 20])
def test_pieces_of_all_rows(spark, window):
    rows = [(at, sentence(at, 1 + at * 5 % 47)) for at in range(150)] + [(200, None), (201, ""), (202, sentence(9, 900)), (None, "no id"), (3, "again"), (3, "again")]
    docs = documents(spark, rows).repartition(6).withColumnRenamed("source", "length")
    packed = packing.pack_documents(docs, tokenizer_path(), length=128, window=window).collect()
    used, bound = check(rows, packed, 128)
    assert used <= bound * 1.05 + 2


@pytest.mark.parametrize("kind", ["decimal(20,0)", "int", "string", "binary", "timestamp_ntz"])
def test_ids_of_any_type_and_short_windows(spark, kind):
    """Many almost empty documents: windows end by their number of pieces."""
    rows = [(at, "" if at % 3 else sentence(at, 4)) for at in range(90)]
    number = "CAST(doc_id AS string)" if kind == "binary" else "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(CAST(doc_id AS int))" if kind == "timestamp_ntz" else "doc_id"
    docs = documents(spark, rows).selectExpr(f"CAST({number} AS {kind}) AS doc_id", "text")
    packed = packing.pack_documents(docs, tokenizer_path(), length=16, most=7)
    assert packed.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(str, (row.doc_id for row in packed.where("piece = 0").collect()))) == sorted(map(str, (row.doc_id for row in docs.collect())))
    used, bound, _ = packing.certificate(packed, 16).first()
    assert used <= bound * 1.1 + 1


def test_whole_table_needs_the_fewest_sequences(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    packed = packing.pack_documents(docs, tokenizer_path()).collect()
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    used, bound = check(rows, packed, packing.LENGTH)
    assert used == bound
    made = spark.createDataFrame([(row.length, row.sequence_id) for row in packed], "length long, sequence_id long")
    assert tuple(packing.certificate(made).first()) == (used, bound, 0)


def test_small_windows_go_on_until_no_round_saves(spark, small):
    """Windows of 8,192 tokens: many groups miss their bound, as over a large table."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    packed = packing.pack_documents(docs, tokenizer_path(), window=8192)
    used, bound, above = packing.certificate(packed).first()
    assert used == bound + above and above <= bound * 0.05


def test_certificate_sees_what_no_packing_can_save(spark):
    packed = spark.createDataFrame([(7, at) for at in range(4)] + [(1, 9)], "length long, sequence_id long")
    assert tuple(packing.certificate(packed, 12).first()) == (5, 4, 1)
    assert tuple(packing.certificate(packed.limit(0), 12).first()) == (0, 0, 0)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), tokenizer_path()).collect() == []
