"""Archives: what is written is read back, by this reader and by gzip, and damage is seen."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradelark.llm import warc

PAGES = "page_id long, url string, html string, payload string, file string"


def pages(spark, rows):
    """Pages with two more columns whose names the operator uses itself."""
    return spark.createDataFrame([(*row, "other", "column") for row in rows], PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by the definition."""
    found = []
    for page_id, _, html in rows:
        own = (html or "").encode()
        same = [other for other, _, text in rows if other is not None and (text or "").encode() == own]
        refers = min(same) if same and len(own) >= least and min(same) != page_id else None
        found.append((page_id, len(own), digest(html), "response" if refers is None else "revisit", refers))
    return sorted(found, key=str)


def result(frame):
    return sorted(map(tuple, frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


LONG = " ".join(str(at) for at in range(200_000))
ROWS = [
    (7, "http://a.example/x y\r\nWARC-Type: metadata", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (9, "http://b.example/", "<p>same</p>"),
    (9, "http://b.example/", "<p>same</p>"),
    (3, "http://c.example/", "<p>same</p>"),
    (1, "http://d.example/", None),
    (2, "", ""),
    (None, "http://e.example/", ""),
    (None, "http://f.example/", "alone"),
    (4, "http://g.example/é", LONG),
    (5, "http://h.example/", LONG + "!"),
    (6, "http://i.example/", LONG),
    (8, "http://j.example/", "head\r\n\r\nWARC/1.1\r\n\x1f\x8b\x00 é 中 \U0001f600"),
]


@pytest.mark.parametrize("least", [0, 1, 12])
def test_round_trip_against_the_definition(spark, least):
    assert result(warc.archive_digest(pages(spark, ROWS).repartition(3), least=least)) == plain(ROWS, least)


def test_payloads_files_and_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/shared"
    draw = random.Random(3)
    rows = [(at, f"http://x.example/{at}", f"{draw.randrange(40)} " * draw.randrange(200)) for at in range(300)]
    manifest = warc.write_archives(pages(spark, rows).repartition(4), folder, file_bytes=3000)
    names = [row.file for row in manifest.collect()]
    assert len(set(names)) == len(names) > 8 and sum(row.n_records for row in manifest.collect()) == len(rows)
    read = warc.read_archives(spark, folder, payloads=True)
    assert result(read) == plain(rows)
    stored = {row.page_id: row.payload for row in read.where("record_type = 'response'").collect()}
    assert all(bytes(payload).decode() == rows[page_id][2] for page_id, payload in stored.items())
    # gzip itself sees one text per file, with as many records as the manifest says.
    for row in manifest.collect():
        path = f"{tmp_path}/shared/archives/{row.file}"
        assert os.path.getsize(path) == row.n_bytes
        assert gzip.open(path).read().count(b"WARC/1.1\r\n") == row.n_records


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/shared"
    warc.write_archives(pages(spark, ROWS), folder)
    left_over = tmp_path / "shared" / "archives" / "pages-of-a-lost-attempt.warc.gz"
    left_over.write_bytes(warc.record_member(99, None, b"x", None)[:20])
    assert result(warc.read_archives(spark, folder)) == plain(ROWS)


def test_empty_table(spark):
    assert warc.archive_digest(pages(spark, []).limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.binary(max_size=300), st.none() | st.integers(0, 9)), max_size=6), st.integers(1, 70))
def test_members_of_any_payload(rows, piece):
    data = b"".join(warc.record_member(page_id, "u", payload, refers) for page_id, payload, refers in rows)
    whole, warc.PIECE = warc.PIECE, piece
    try:
        read = list(warc.read_records(io.BytesIO(data), payloads=True))
    finally:
        warc.PIECE = whole
    assert len(read) == len(rows)
    for record, (page_id, payload, refers) in zip(read, rows):
        assert record.fields["page-id"] == str(page_id) and record.payload_bytes == len(payload)
        assert record.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert record.payload == (payload if refers is None else None)


def member(head, block):
    return gzip.compress(head.replace("\n", "\r\n").encode() + block + b"\r\n\r\n")


def test_other_kinds_are_passed_over():
    info = member("WARC/1.0\nWARC-Type: warcinfo\nContent-Length: 3\n\n", b"a:b")
    data = info + warc.record_member(1, None, b"x", None) + info
    assert [record.kind for record in warc.read_records(io.BytesIO(data))] == ["response"]


WHOLE = warc.record_member(1, "http://x.example/", b"payload " * 50, None)
TEXT = gzip.decompress(WHOLE)


@pytest.mark.parametrize(
    "data",
    [
        WHOLE[:-1],
        WHOLE[:40],
        WHOLE + b"junk",
        b"plain text",
        gzip.compress(TEXT + b"more"),
        gzip.compress(TEXT[:-4]),
        gzip.compress(TEXT + TEXT),
        gzip.compress(TEXT.replace(b"payload payload", b"payload PAYLOAD")),
        gzip.compress(TEXT.replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A")),
        gzip.compress(TEXT.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")),
        gzip.compress(TEXT.replace(b"WARC/1.1", b"HTTP/1.1")),
        gzip.compress(TEXT.replace(b"Content-Length: ", b"Content-Length: -")),
        gzip.compress(TEXT.replace(b"\r\n\r\n", b"\r\n")),
        member("WARC/1.1\nWARC-Type: response\nContent-Length: 3\n\n", b"a:b"),
        member("WARC/1.1\nno colon\nContent-Length: 3\n\n", b"a:b"),
    ],
)
def test_damage_is_an_error(data):
    with pytest.raises(warc.BrokenArchive):
        list(warc.read_records(io.BytesIO(data)))
