"""Cross-tokenizer alignment against a plain version on whole texts."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from tests.llm.helpers import documents, sentence
from tradelark.llm import align
from tradelark.llm.queries import QUERIES
from tradelark.plans import staging
from tradelark.plans.staging import staged, staging_path

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
with open(PATHS[0], encoding="utf-8") as file:
    SPEC = json.load(file)
NAMES = {id_: name for name, id_ in SPEC["model"]["vocab"].items()}
BYTES = {pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(at))[0][0]: chr(at).encode() for at in range(128)}


def token_bytes(text):
    """(id, bytes) of both tokenizers; A's bytes come from its offsets, which the operator does not use."""
    one = A.encode(" " + text, add_special_tokens=False)
    letters = align.visible_bytes()
    first = [(id_, bytes(letters[char] for char in NAMES[id_])) for id_ in one.ids]
    second = []
    for id_ in B.encode(text):
        piece = B.id_to_piece(id_)
        second.append((id_, bytes.fromhex(piece[3:5]) if B.is_byte(id_) else piece.replace("▁", " ").encode()))
    return first, second


def groups_of(text):
    """Groups by walking along the bytes of the text."""
    if not text:
        return [], 0, 0
    first, second = token_bytes(text)
    whole = (" " + text).encode()
    if b"".join(part for _, part in first) != whole or b"".join(part for _, part in second) != whole:
        return [], 0, 0
    ends = []
    for side in (first, second):
        at, found = 0, {}
        for id_, part in side:
            at += len(part)
            found[at] = id_
        ends.append(found)
    groups, own = [], ([], [])
    for at in range(1, len(whole) + 1):
        for side in (0, 1):
            if at in ends[side]:
                own[side].append(ends[side][at])
        if at in ends[0] and at in ends[1]:
            groups.append(own)
            own = ([], [])
    return groups, len(first), len(second)


def plain(rows):
    every = [(doc_id, *groups_of(text)) for doc_id, text in rows]
    count = Counter((one[-1], two[-1]) for _, groups, _, _ in every for one, two in groups)
    best = defaultdict(int)
    for (_, id_b), n in count.items():
        best[id_b] = max(best[id_b], n)
    found = []
    for doc_id, groups, n_a, n_b in every:
        links = [(one[-1], two[-1]) for one, two in groups]
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        found.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[link] == best[link[1]] for link in links), sum(count[link] for link in links), digest))
    return sorted(found, key=str)


ODD = [
    None, "", " ", "  two  spaces ", "a▁b", "▁", "<|endoftext|> is text", "a<s></s><unk><0x41>", "tab\tline\n\n\r\nend ", "\x00\x01 null",
    "naïve ñandú ﬁ ﷺ", "中文テスト", "😀👩‍👩‍👧 a×b", "İ ß ẞ ǅ", "don't we'll I'M", "x" * 5000, "ab " * 3000, " " * 12000 + "x", "\n" * 11000, "é" * 999, "1234567890" * 50, " \x85\xa0　",
]


def test_letters_of_a_byte_level_vocabulary():
    assert len(align.visible_bytes()) == 256 == len(set(align.visible_bytes().values()))
    for char, raw in BYTES.items():
        assert bytes([align.visible_bytes()[char]]) == raw


def test_same_ids_as_the_libraries():
    a, b = align.tokenizers(*PATHS)
    assert a.fast is not None
    for text in filter(None, ODD):
        assert list(a.encode(" " + text)) == A.encode(" " + text, add_special_tokens=False).ids
        assert b.encode(text) == B.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB's é12.,\n\x1c\xa0Ç<|>\t", max_size=60))
def test_same_ids_for_any_text(text):
    a, _ = align.tokenizers(*PATHS)
    assert list(a.encode(text)) == A.encode(text, add_special_tokens=False).ids


def test_the_library_serves_other_files(tmp_path):
    other = json.loads(json.dumps(SPEC))
    other["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other), encoding="utf-8")
    assert align.ByteLevel(str(path)).fast is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40)), min_size=1, max_size=5))
def test_cuts_are_all_common_ends(parts):
    ends_a, ends_b, tops = [], [], []
    for at, (one, two) in enumerate(parts):
        top = 100 * (at + 1)
        ends_a += sorted(top - 100 + end for end in one) + [top]
        ends_b += sorted(top - 100 + end for end in two) + [top]
        tops.append(top)
    ends_a, ends_b = np.array(ends_a), np.array(ends_b)
    cuts_a, cuts_b = align.common_cuts(ends_a, ends_b, np.searchsorted(ends_a, tops), np.searchsorted(ends_b, tops))
    common = np.intersect1d(ends_a, ends_b)
    assert ends_a[cuts_a].tolist() == ends_b[cuts_b].tolist() == common.tolist()


@pytest.mark.parametrize("block, together", [(1 << 20, 1 << 21), (300, 500)])
def test_against_the_definition(spark, block, together):
    rows = list(enumerate(ODD)) + [(100 + at, sentence(at, at * 3, 300)) for at in range(40)] + [(200, "same text"), (200, "same text"), (None, "no id")]
    random.Random(1).shuffle(rows)
    docs = documents(spark, rows).repartition(4).withColumnRenamed("source", "pairs").withColumnRenamed("lang", "block")
    found = align.align_documents(docs, *PATHS, block=block, together=together)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_blocks_are_written_in_small_rows_and_groups(spark, monkeypatch):
    rows = [(at, sentence(at, 20) if at % 5 else None) for at in range(60)]
    monkeypatch.setattr(align, "ROW_LINKS", 100)
    docs = documents(spark, rows).coalesce(1)
    held = align._blocks(docs, *PATHS, 1 << 20, 500).collect()
    assert len(held) > 5 and len({row.block for row in held}) == 1
    assert [at for row in held for at in row.doc_ids] == list(range(60))
    assert all(len(row.links) == 4 * sum(row.n_groups) for row in held)
    # A row ends with the text that passes its links.
    longest = max(n for row in held for n in row.n_groups)
    assert max(sum(row.n_groups) for row in held) <= 100 + longest
    assert held[0].pairs and not any(row.pairs or row.counts for row in held[1:])
    assert sum(held[0].counts) == sum(sum(row.n_groups) for row in held)
    assert sorted(map(tuple, align.align_documents(docs, *PATHS).collect()), key=str) == plain(rows)
    written = staging_path
    folders = []
    monkeypatch.setattr(staging, "staging_path", lambda *a: folders.append(written(*a)) or folders[-1])
    assert staged(spark.range(0, 50, 1, 1), "groups", rows=16).count() == 50
    file = pq.ParquetFile(next(Path(folders[0].removeprefix("file:")).glob("*.parquet"))).metadata
    assert [file.row_group(at).num_rows for at in range(file.num_row_groups)] == [16, 16, 16, 2]


def test_empty_tables_and_texts(spark):
    assert align.align_documents(documents(spark, []), *PATHS).collect() == []
    found = align.align_documents(documents(spark, [(1, None), (2, "")]), *PATHS).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_on_the_whole_table(spark, small):
    rows = [tuple(row) for row in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_shared_cuts"](spark, small)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)
