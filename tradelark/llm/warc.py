"""Web archives: WARC 1.1 files with one gzip member per record, written and read by Spark tasks.

A page is a response record, whose block is an HTTP response with the page as its payload.
Of pages with equal payloads only the one with the smallest id is stored; the others are
revisit records, which name it and hold HTTP headers only.

Each task writes files of its own below the shared folder, under names no other attempt
uses, and returns their names. Spark commits these names as the manifest, so that files of
failed or repeated attempts are never read. A reading task goes through its files from
start to end: it inflates one member at a time in small pieces, frames the block by its
content length and checks lengths and digests. A record is never in memory as a whole
unless its payload is asked for.

Folders are opened by the workers, so their address must be one that Arrow knows (a shared
path, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.plans.staging import staging_path

# Compressed bytes after which a task starts a new file; bytes read or inflated at once.
FILE_BYTES, PIECE = 64 << 20, 1 << 16
# Bytes that the headers of a record, or of its HTTP message, may have.
MOST_HEADERS = 1 << 20
# Archives need a date per record, pages have none.
DATE = "2000-01-01T00:00:00Z"
# Fixed by the WARC standard.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

_UNSAFE = re.compile("[\x00-\x20\x7f]")


class BrokenArchive(ValueError):
    """A file that is not a sequence of whole records, or a digest that does not fit."""


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def _open(place: str) -> tuple[fs.FileSystem, str]:
    # Hadoop's name for the store that Arrow calls s3.
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", place))


# ---------------------------------------------------------------- writing


def record_id(page_id: int | None, digest: str) -> str:
    """A page's record id; a revisit can name it without having seen the record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, *, date: str = DATE) -> bytes:
    """The gzip member of one page's record; a revisit if ``refers_to`` is given."""
    digest = _base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else b""
    block = hashlib.sha1(http)
    block.update(body)
    fields = {
        "WARC-Type": RESPONSE if refers_to is None else REVISIT,
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        # Blanks and control characters would end the line or the field.
        "WARC-Target-URI": url and _UNSAFE.sub(lambda found: f"%{ord(found[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{_base32(block.digest())}",
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "WARC-Profile": None if refers_to is None else IDENTICAL,
        # Extension fields, which the standard leaves to the writer.
        "Page-ID": page_id,
        "Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(http) + len(body),
    }
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = (f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogatepass"), http, body, b"\r\n\r\n")
    return b"".join([*map(deflate.compress, parts), deflate.flush()])


def _first_pages(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload and refers_to: for all but the first of equal payloads, the first one's id."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    # One row per payload that occurs more than once, combined before it is shuffled.
    firsts = rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("same IS NOT NULL AND n > 1").select("same", "first")
    refers = F.when((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull()), F.col("first"))
    return rows.join(firsts, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, least: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record below ``folder``; returns the manifest.

    A null html counts as empty. Of equal payloads of at least ``least`` bytes those with the
    smallest page_id are responses (all of them, if such a row is repeated) and the others revisit
    it; rows without an id revisit too, and where no equal row has one all are responses. A null url is left
    out; other columns are ignored. The manifest (file, n_records, n_bytes) is written to
    ``folder``/manifest.
    """
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _open(folder)
        store.create_dir(f"{place}/archives", recursive=True)
        out, name, records, held = None, "", 0, 0

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.record_batch({"file": pa.array([name]), "n_records": pa.array([records]), "n_bytes": pa.array([held])})

        for batch in batches:
            columns = (batch.column(one) for one in ("page_id", "url", "payload", "refers_to"))
            for values in zip(*columns):
                member = record_member(*(value.as_py() for value in values), date=date)
                if out is None:
                    name, records, held = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    # The members are compressed already; the name must not add another layer.
                    out = store.open_output_stream(f"{place}/archives/{name}", compression=None)
                out.write(member)
                records, held = records + 1, held + len(member)
                if held >= file_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    manifest = _first_pages(pages, least).mapInArrow(write, "file string, n_records long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


# ---------------------------------------------------------------- reading


class _Members:
    """The plain bytes of a file's gzip members, one member after the other."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.waiting, self.plain = stream, b"", b""
        self.inflate = None

    def start(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.waiting = self.waiting or self.stream.read(PIECE)
        if not self.waiting:
            return False
        self.inflate, self.plain = zlib.decompressobj(31), b""
        return True

    def _more(self) -> bool:
        """Inflate one more piece; False at the end of the member."""
        if self.inflate.eof:
            return False
        self.waiting = self.waiting or self.stream.read(PIECE)
        if not self.waiting:
            raise BrokenArchive("the file ends inside a record")
        try:
            self.plain += self.inflate.decompress(self.waiting, PIECE)
        except zlib.error as error:
            raise BrokenArchive(f"not a gzip member: {error}") from error
        self.waiting = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def headers(self, most: int) -> bytes:
        """All up to the next empty line, of at most ``most`` bytes."""
        while (end := self.plain.find(b"\r\n\r\n", 0, most)) < 0:
            if len(self.plain) >= most or not self._more():
                raise BrokenArchive("a record's headers do not end")
        found, self.plain = self.plain[:end], self.plain[end + 4 :]
        return found

    def take(self, count: int) -> Iterator[bytes]:
        """The next ``count`` bytes in pieces."""
        while count:
            if not self.plain and not self._more():
                raise BrokenArchive("a block is shorter than its content length")
            piece, self.plain = self.plain[:count], self.plain[count:]
            count -= len(piece)
            yield piece

    def finish(self) -> None:
        """The two line ends behind a block, and nothing more in the member."""
        while self._more() and len(self.plain) <= 4:
            pass
        if self.plain != b"\r\n\r\n" or not self.inflate.eof:
            raise BrokenArchive("a block is longer than its content length")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line, and the named fields by their lower-case names."""
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BrokenArchive(f"not a header: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdecimal()):
        raise BrokenArchive(f"no content length: {value[:80]!r}")
    return int(value)


@dataclass
class Record:
    """One record; the payload's length and digest are those of the full payload."""

    fields: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")


def _checked(fields: dict[str, str], name: str, sha1: bytes) -> str:
    found, said = _base32(sha1), fields.get(name)
    # Other digests than SHA-1 are somebody else's and cannot be checked here.
    if said and said.lower().startswith("sha1:") and said[5:].upper() != found:
        raise BrokenArchive(f"{name} is {said}, the bytes give {found}")
    return found


def read_records(stream: BinaryIO, *, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive in their order; payloads are kept if asked for.

    Every response and revisit is checked: its length, the digest of its block, and for a
    response the length and digest of its payload. Records of other kinds are passed over
    after the check of their block.
    """
    members = _Members(stream)
    while members.start():
        version, fields = _fields(members.headers(MOST_HEADERS))
        if not version.startswith("WARC/1."):
            raise BrokenArchive(f"not a record: {version[:80]!r}")
        whole, own, head, parts, size = hashlib.sha1(), hashlib.sha1(), None, [], 0
        http = fields.get("warc-type") in (RESPONSE, REVISIT)
        pending = b""
        for piece in members.take(_length(fields)):
            whole.update(piece)
            if http and head is None:
                pending += piece
                end = pending.find(b"\r\n\r\n")
                if end < 0:
                    if len(pending) > MOST_HEADERS:
                        raise BrokenArchive("a message's headers do not end")
                    continue
                head, piece = pending[:end], pending[end + 4 :]
            if http:
                own.update(piece)
                size += len(piece)
                if payloads:
                    parts.append(piece)
        members.finish()
        _checked(fields, "warc-block-digest", whole.digest())
        if not http:
            continue
        if head is None:
            raise BrokenArchive("a message without headers")
        said = _length(_fields(head)[1])
        if fields["warc-type"] == REVISIT:
            digest = fields.get("warc-payload-digest", "").partition(":")[2].upper()
            yield Record(fields, said, digest, None)
            continue
        if said != size:
            raise BrokenArchive(f"a payload of {size} bytes is said to have {said}")
        digest = _checked(fields, "warc-payload-digest", own.digest())
        yield Record(fields, size, digest, b"".join(parts) if payloads else None)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """file, page_id, url, payload_bytes, payload_digest, record_type, refers_to of all records that the
    manifest of ``folder`` names, and payload (null for revisits) if asked for. A file is read by
    one task from start to end.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()
    schema = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if payloads else ""
    types = {"file": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    types |= {"payload": pa.binary()} if payloads else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _open(folder)
        for name in (one for batch in batches for one in batch.column("file").to_pylist()):
            rows, held = [], 0
            with store.open_input_stream(f"{place}/archives/{name}", compression=None) as stream:
                for record in read_records(stream, payloads=payloads):
                    fields = record.fields
                    row = (name, _number(fields.get("page-id")), fields.get("warc-target-uri"), record.payload_bytes, record.payload_digest, record.kind, _number(fields.get("refers-to-page-id")))
                    rows.append((*row, record.payload) if payloads else row)
                    held += 200 + len(record.payload or b"")
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), types.values())], list(types))
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), types.values())], list(types))

    return manifest.select("file").repartition(max(1, files)).mapInArrow(read, schema)


def archive_digest(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write archives of ``pages`` to the session's shared folder and digest them from there.

    page_id, payload_bytes, payload_digest, record_type, refers_to of every record, as read back.
    """
    spark = pages.sparkSession
    folder = staging_path(spark, "archives")
    write_archives(pages, folder, least=least)
    read = read_archives(spark, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
