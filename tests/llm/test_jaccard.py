from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, edited, linked_components, sentence, shingles, words
from tradelark.llm import graph, jaccard
from tradelark.llm import words as hashing


def test_shingle_sets_are_those_of_the_words():
    texts = ["a b c d a b c", "A  b\tc\n", "a b", "b a", "one", "", None, "  ", "x\u00a0y z w", "É é E", "a b c d", "a " * 50]
    for k in (1, 3, 5):
        sets = hashing.shingle_sets(texts, k)
        assert [len(own) for own in sets] == [len(shingles(text, k)) for text in texts]
        for one in range(len(texts)):
            for two in range(len(texts)):
                wanted = len(shingles(texts[one], k) & shingles(texts[two], k))
                assert len(np.intersect1d(sets[one], sets[two])) == wanted


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = sentence(1, 500) + " " + "y" * 700 + " " + sentence(2, 300)
    whole = hashing.words_of([text, "a b"])
    monkeypatch.setattr(hashing, "PIECE", 256)
    pieces = hashing.words_of([text, "a b"])
    assert whole[1].tolist() == pieces[1].tolist() == [len(words(text)), 2]
    assert (whole[0] == pieces[0]).all()


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(at, at + 1) for at in range(400, 480)] + [(5, 5)]
    parent = {}

    def find(at):
        while parent.setdefault(at, at) != at:
            at = parent[at]
        return at

    for one, two in links:
        low, high = sorted((find(one), find(two)))
        parent[high] = low
    found = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {at: find(at) for link in links if link[0] != link[1] for at in link}


def corpus():
    rows = [(at, sentence(at, 10 + at)) for at in range(30)]
    passage = sentence(1000, 40)
    rows += [(40 + at, f"{passage} {sentence(50 + at, 8 + at)}") for at in range(20)]
    original = sentence(2000, 150)
    rows += [(70 + at, edited(original, at, 1 + at % 5)) for at in range(40)]
    # A chain: neighbours are similar, the ends are not.
    chain = sentence(3000, 120).split(" ")
    for at in range(12):
        rows.append((120 + at, " ".join(chain)))
        chain[at * 7] = f"changed{at}"
    rows += [(140, "one two"), (141, "One TWO"), (142, "two one"), (143, ""), (144, None), (145, " \n"), (7, rows[7][1]), (7, "other text of seven"), (200, rows[75][1]), (3, rows[80][1])]
    return rows


@pytest.mark.parametrize("k, pct, options", [(3, 90, {}), (5, 80, {}), (3, 90, {"group": 2}), (3, 90, {"part": 600}), (5, 80, {"part": 1500, "group": 3, "hubs": 2}), (1, 50, {"part": 400})])
def test_components_of_all_rows(spark, k, pct, options):
    rows = corpus()
    parents, sizes = linked_components([row[1] for row in rows], k, pct)
    smallest = {}
    for row, parent in zip(rows, parents):
        smallest[parent] = min(row[0], smallest.get(parent, row[0]))
    wanted = sorted((row[0], size, smallest[parent]) for row, size, parent in zip(rows, sizes, parents))
    docs = documents(spark, rows).repartition(3).withColumnsRenamed({"source": "node", "lang": "n"})
    found = sorted(map(tuple, jaccard.jaccard_components(docs, k=k, pct=pct, **options).collect()))
    assert found == wanted


def test_spreads_differ_by_no_more_than_the_sets(monkeypatch):
    draw = np.random.default_rng(6)
    for most in (jaccard.MOST_CLASSES, 5):
        # With few classes counts pass 255.
        monkeypatch.setattr(jaccard, "MOST_CLASSES", most)
        monkeypatch.setattr(jaccard, "CLASSES", 1 << 2 * most)
        ones, twos, wanted = [], [], []
        for size in (0, 1, 7, 60, 500, 3_000, 30_000):
            for other in (0, 1, size // 10, size):
                every = hashing.mixed(draw.integers(0, 1 << 62, size + other).astype(np.uint64))
                one, two = np.unique(every[:size]), np.unique(every[other // 2 :])
                ones.append(jaccard._spread(one))
                twos.append(jaccard._spread(two))
                wanted.append(len(np.setxor1d(one, two)))
        found = jaccard.spreads_apart(pa.array(ones, pa.binary()), pa.array(twos, pa.binary()))
        assert (found <= np.array(wanted)).all() and (found > 0).any()


@pytest.mark.parametrize("paired", [jaccard.PAIRED, 1])
def test_unlike_texts_that_share_rare_shingles(spark, monkeypatch, paired):
    # Every passage is in two texts: a chain of texts that have a third of their shingles in common.
    passages = [sentence(5000 + at, 60) for at in range(41)]
    rows = [(at, f"{passages[at]} {passages[at + 1]}") for at in range(40)] + [(50, passages[7] + " " + edited(passages[8], 1, 1))]
    across = []
    own = jaccard._across_parts
    monkeypatch.setattr(jaccard, "_across_parts", lambda *a: across.append(1) or own(*a))
    found = jaccard.jaccard_components(documents(spark, rows), k=3, pct=90, part=1000, paired=paired).collect()
    assert {r.doc_id: r.component_id for r in found} == {**{at: at for at in range(40)}, 50: 7}
    # Only without looking at the pairs is the chain one family of several parts.
    assert bool(across) == (paired == 1)


def test_rows_without_id(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, None)]
    found = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted([(None, 4, 5), (5, 4, 5), (None, 0, None)], key=str)


def test_empty_table(spark):
    assert jaccard.jaccard_components(documents(spark, [])).collect() == []


def test_whole_table(spark, small):
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 400").collect()]
    parents, sizes = linked_components([row[1] for row in rows], 3, 90)
    wanted = sorted((row[0], size, rows[parent][0]) for row, size, parent in zip(rows, sizes, parents))
    found = jaccard.jaccard_components(documents(spark, rows)).collect()
    ids = {row[0]: at for at, row in enumerate(rows)}
    assert [(a, b) for a, b, _ in wanted] == sorted((r.doc_id, r.n_shingles) for r in found)
    groups = lambda triples: {frozenset(x[0] for x in triples if x[2] == c) for c in {x[2] for x in triples}}
    assert groups(wanted) == groups([tuple(r) for r in found]) and all(r.component_id in ids for r in found)
