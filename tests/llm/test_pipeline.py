from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import documents, edited, linked_components, sentence
from tradelark.llm.queries import tokenizer_path
from tradelark.llm.tokens import encoder
from tradelark.plans.staging import staged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    english = ["the", "and", "house", "water", "under", "green", "little", "mother", "there", "which", "letter", "window"]

    def text(seed, count):
        draw = np.random.default_rng(seed)
        return " ".join(f"{english[draw.integers(12)]}{english[draw.integers(12)]}{english[draw.integers(12)]}" for _ in range(count))

    passage = text(1, 40)
    item = text(2, 30)
    rows = [(at, text(100 + at, 40), "en") for at in range(30)]
    rows += [(50, text(50, 80), "en"), (51, edited(text(50, 80), 1, 1), None), (52, text(50, 80), "en"), (50, text(50, 80), "en")]
    rows += [(60, f"{text(60, 20)} {passage}", "en"), (61, f"{passage} {text(61, 20)}", "en")]
    rows += [(70, f"{text(70, 50)} {item} {text(71, 10)}", "en")]
    rows += [(80, None, "en"), (81, "12345 ???", None), (82, "漢字 かな交じり文", None), (None, text(90, 15), "en")]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, text(3, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_acts_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        seen.append(docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = [sorted((row.doc_id is None, row.doc_id or 0) for row in rows) for rows in seen]
    clean = [(False, at) for at in range(30)]
    assert [at for at in ids[0] if at[1] in (80, 81, 82)] == []
    assert ids[1] == [*clean, (False, 50), (False, 60), (False, 61), (False, 70), (True, 0)]
    assert ids[2] == ids[1]
    texts = {row.doc_id: row for row in seen[2]}
    before = {row.doc_id: row.text for row in seen[1]}
    assert len(texts[60].text) < 600 and texts[60].n_chars == len(texts[60].text)
    assert all(texts[at].text == before[at] for _, at in clean)
    assert ids[3] == [at for at in ids[2] if at != (False, 70)]
    packed = seen[4]
    own = encoder(tokenizer_path()).tokenizer
    stored = {row.doc_id: row.text for row in seen[3]}
    for row in packed:
        wanted = own.encode(stored[row.doc_id], add_special_tokens=False).ids + [1]
        assert np.frombuffer(row.ids, "<u4").tolist() == wanted


def test_run_gives_the_packed_pieces(spark, folder):
    packed = corpus_pipeline.run(spark, folder).collect()
    assert len(packed) == 34 and all(row.length == len(row.ids) // 4 for row in packed)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_duplicates_of_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    parents, _ = linked_components([row.text for row in rows], 5, 80)
    wanted = {}
    for row, parent in zip(rows, parents):
        wanted[parent] = min(row.doc_id, wanted.get(parent, row.doc_id))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    assert sorted(row.doc_id for row in kept.collect()) == sorted(wanted.values())


def test_empty_documents(spark, folder, tmp_path):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        assert docs.collect() == []


def test_extra_columns_with_clashing_names_stay(spark, folder):
    rows = [(1, sentence(1, 50), "en"), (2, sentence(2, 50), "en")]
    docs = documents(spark, rows).withColumnsRenamed({"source": "score", "n_chars": "node"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "score", "node"]
    assert sorted(row.score for row in docs.collect()) == ["src", "src"]


def test_passages_of_51_ordinary_words_go_wherever_they_occur(spark, folder):
    draw = np.random.default_rng(77)
    short = ["a", "of", "the", "to", "and", "in", "was", "his", "that", "for"]
    passage, other = (" ".join(f"{short[draw.integers(10)]}{draw.integers(30)}" for _ in range(count)) for count in (51, 50))
    assert len(passage) < 300
    around = [sentence(500 + at, 30) for at in range(8)]
    around[6], around[7] = f"left {around[6]}", f"right {around[7]}"
    inside = f"{sentence(600, 40, 10**9)} {passage} {sentence(601, 40, 10**9)}"
    rows = [(1, f"{around[0]} {passage} é{around[1]}"), (2, f"{passage.upper()}\n{around[2]}"), (3, f"{around[3]} {other}"), (4, f"{other} {around[4]}")]
    # Here the passage is part of a longer one; it still goes from the others.
    rows += [(5, f"{around[5]} {inside} {around[6]}"), (6, f"{inside} {around[7]}"), (7, None), (8, passage.split(" ", 1)[1])]
    found = {row.doc_id: row for row in corpus_pipeline.passage_stage(spark, documents(spark, rows), folder).collect()}
    assert found[1].text == f"{around[0]} é{around[1]}" and found[2].text == around[2]
    assert found[3].text == rows[2][1] and found[4].text == rows[3][1] and found[7].text is None and found[8].text == rows[7][1]
    assert passage not in found[5].text and found[5].text.startswith(around[5]) and found[5].text.endswith(around[6])
    assert found[6].text.split() == around[7].split()
    assert all(row.n_chars == len(row.text) for row in found.values() if row.text is not None)
    alone = corpus_pipeline.passage_stage(spark, documents(spark, [*rows[:1], rows[4], rows[5]]), folder)
    assert {row.doc_id: row.text for row in alone.collect()}[1] == f"{around[0]} é{around[1]}"
