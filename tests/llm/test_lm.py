from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import documents, sentence, words
from tradelark.llm import lm


def plain_forward(model, classes):
    vector, total = model.start.copy(), 0.0
    for at, kind in enumerate(classes):
        vector = (vector if at == 0 else vector @ model.move) * model.emit[kind]
        total += math.log(vector.sum())
        vector /= vector.sum()
    return total


def plain_expected(model, classes):
    n, states = len(classes), len(model.start)
    ahead, behind = np.zeros((n, states)), np.ones((n, states))
    for at, kind in enumerate(classes):
        ahead[at] = (model.start if at == 0 else ahead[at - 1] @ model.move) * model.emit[kind]
    for at in range(n - 2, -1, -1):
        behind[at] = model.move @ (model.emit[classes[at + 1]] * behind[at + 1])
    likelihood = ahead[-1].sum()
    share = ahead * behind / likelihood
    move = np.zeros((states, states))
    for at in range(n - 1):
        move += ahead[at][:, None] * model.move * (model.emit[classes[at + 1]] * behind[at + 1]) / likelihood
    emit = np.zeros_like(model.emit)
    np.add.at(emit, classes, share)
    return share[0], move, emit


def some_model(states=3, classes=5, seed=1):
    draw = np.random.default_rng(seed)
    model = lm.Model(draw.random(states), draw.random((states, states)), draw.random((classes, states)))
    return lm.Model(model.start / model.start.sum(), model.move / model.move.sum(1, keepdims=True), model.emit / model.emit.sum(0))


@pytest.mark.parametrize("lengths", [[1], [64], [65, 1, 130], [3, 200, 64, 128, 1, 17]])
def test_stretches_give_the_exact_recursions(lengths):
    model, draw = some_model(), np.random.default_rng(2)
    classes = draw.integers(0, 5, sum(lengths))
    batch = lm._Batch(classes, np.array(lengths))
    parts = np.split(classes, np.cumsum(lengths)[:-1])
    assert np.allclose(batch.forward(model)[0], [plain_forward(model, own) for own in parts])
    found = batch.expected(model)
    wanted = [plain_expected(model, own) for own in parts]
    assert np.allclose(found.start, sum(one for one, _, _ in wanted))
    assert np.allclose(found.move, sum(one for _, one, _ in wanted))
    assert np.allclose(found.emit, sum(one for _, _, one in wanted))


def base_scores(rows):
    counts = Counter()
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update([*words(text), b" "])
    n, v = sum(counts.values()), len(counts)
    found = []
    for doc_id, text in rows:
        own = [*words(text), b" "]
        score = sum(math.log10((counts[word] + 1) / (n + v + 1)) for word in own)
        found.append((doc_id, len(own), sum(counts[word] > 0 for word in own), n, score))
    return found


def test_scores_of_all_rows(spark):
    rows = [(at, sentence(at % 9, 30 + at * 3, 300)) for at in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n"), (None, "w1 W2 unseenword"), (7, rows[7][1]), (103, "long " * 30000)]
    found = lm.score_documents(documents(spark, rows).withColumnRenamed("source", "score"), block=4000, rounds=2).collect()
    assert len(found) == len(rows)
    key = lambda row: (row[0] is None, row[0] or 0, row[1])
    wanted = sorted(base_scores(rows), key=key)
    seen = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    assert [row[:4] for row in seen] == [row[:4] for row in wanted]
    assert np.allclose([row[4] for row in seen], [row[4] for row in wanted])
    assert all(math.isfinite(row.score) and row.score < 0 for row in found)
    assert all(row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 2) for row in found)


def test_hidden_states_beat_word_frequencies(spark, small):
    found = lm.score_documents(spark.read.parquet(f"{small}/documents.parquet")).where("held_out").collect()
    assert sum(row.score for row in found) > sum(row.base_score for row in found)


def test_empty_tables_and_nothing_to_learn(spark):
    assert lm.score_documents(documents(spark, [])).collect() == []
    alone = lm.score_documents(documents(spark, [(None, "a b")])).collect()[0]
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (3, 0, 0, 0.0)
    assert math.isfinite(alone.score)
