"""WARC archives: a writer, and a reader that salvages what damaged archives still hold.

Writing: each page becomes a record of its own gzip member; a page whose payload equals that of a page
with a smaller id becomes a revisit of that one.  Tasks write files of bounded size into the shared
folder and return their names; only files named by finished tasks are read, so a task that is lost
and run again leaves no record twice.

Reading: each record is checked (gzip checksum, version line, header, length, block digest).  After a
failed check the reader searches for the next place where a valid member or a version line begins,
goes on from there, and logs the bytes between as a quarantined gap.  A file is read in pieces; memory
holds one record at a time.

Defined results: headers (and so URLs) may have any length; a null payload is empty; small payloads are always written as responses; among rows
of equal smallest id and payload all are responses; a null id is larger than any other; an empty table
gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._shared import scratch, small_batches, small_side, stored

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
PIECE = 1 << 18
LEVEL = 1
#: The date of every record, so that equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit (``refers_to`` given) has HTTP headers but no payload."""
    kind = "revisit" if refers_to is not None else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{_hex(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress_member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), body


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogateescape")
    return out


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, offset: int = 0) -> tuple[Record, int]:
    """The record at the start of ``data`` and the number of its bytes."""
    if not _VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header does not end")
    headers = _fields(data[:end].split(b"\r\n")[1:])
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    stop = end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[end + 4 : stop]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha256:") and want[7:].lower() != _hex(block):
        raise Damaged("block digest differs")
    return Record(offset, headers, block), stop + 4


class _Source:
    """A file read in pieces at any place."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.held = handle, size, 0, b""

    def at(self, offset: int, n: int = PIECE) -> bytes:
        """``n`` bytes from ``offset`` on, fewer only at the end."""
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.handle.seek(offset)
            self.start, self.held = offset, self.handle.read(max(n, 4 * PIECE))
        return self.held[offset - self.start : offset - self.start + n]

    def find(self, pattern: re.Pattern, offset: int) -> int:
        """The next place of ``pattern`` (of at most 16 bytes), or the end."""
        while offset < self.size:
            piece = self.at(offset)
            if m := pattern.search(piece):
                return offset + m.start()
            if offset + len(piece) >= self.size:
                break
            offset += max(1, len(piece) - 16)
        return self.size

    def member(self, offset: int) -> tuple[bytes, int, str]:
        """The content of the gzip member at ``offset``, its end, and what is wrong with it.

        Of a member that is cut off or damaged it is the content up to there, in small steps.
        """
        for step in (PIECE, 256):
            unpacker, out, at = zlib.decompressobj(31), [], offset
            try:
                while not unpacker.eof:
                    piece = self.at(at, step)
                    if not piece:
                        return b"".join(out), self.size, "member is cut off"
                    out.append(unpacker.decompress(piece))
                    if at == offset and out[0] and not b"WARC/"[: len(out[0])] == out[0][:5]:
                        raise Damaged("member is no record")
                    at += len(piece)
                return b"".join(out), at - len(unpacker.unused_data), ""
            except zlib.error as error:
                wrong = f"member: {error}"
        return b"".join(out), at, wrong


def records_within(data: bytes, offset: int, proven: bool) -> tuple[list[Record], str]:
    """The records in the content of a member, and why bytes between them are lost.

    After a failed check it goes on at the next version line.  With ``proven`` only records whose own
    digest holds count, as those of a damaged member.
    """
    found, at, reason = [], 0, ""
    while at < len(data):
        try:
            record, n = parse_record(data[at:] if at else data, offset)
            if proven and not record.headers.get("warc-block-digest", "").startswith("sha256:"):
                raise Damaged("record of a damaged member has no digest")
            found.append(record)
            at += n
        except Damaged as error:
            reason = reason or f"{error}, at {at} of the member's content"
            later = _LINE.search(data, at + 1)
            at = later.start() if later else len(data)
    return found, reason


_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def read_archive(handle, size: int) -> Iterator[Record | Gap]:
    """All records that pass their checks, and the gaps between them, in order of their place.

    Of a member with several records those that pass stay, and the gap names the member's bytes; of a
    member that is damaged or cut off, those that were complete and prove themselves by their digest.
    """
    source, at, lost, reason = _Source(handle, size), 0, None, ""
    while at < size:
        try:
            found: list[Record] = []
            if source.at(at, 3) == _MAGIC:
                data, end, wrong = source.member(at)
                found, reason_within = records_within(data, at, proven=bool(wrong))
                if wrong or (reason_within and not found):
                    if found and lost is not None:
                        yield Gap(lost, at, reason)
                        lost = None
                    yield from found
                    raise Damaged(wrong or reason_within)
                if reason_within:  # the member stands, but not all that is in it
                    if lost is not None:
                        yield Gap(lost, at, reason)
                        lost = None
                    yield from found
                    yield Gap(at, end, reason_within)
                    at = end
                    continue
            else:
                n, data = PIECE, source.at(at, 16)
                if not _VERSION.match(data):
                    raise Damaged("no version line")
                while (head := (data := source.at(at, n)).find(b"\r\n\r\n")) < 0 and n < size - at:
                    n *= 4  # a header of any length
                length = _fields(data[: max(head, 0)].split(b"\r\n")).get("content-length", "")
                if head < 0 or not length.isdigit() or at + head + 8 + int(length) > size:
                    raise Damaged("header or length does not fit")
                record, n = parse_record(source.at(at, head + 8 + int(length)), at)
                found.append(record)
                end = at + n
        except Damaged as error:
            if lost is None:
                lost, reason = at, str(error)
            at = source.find(_BEGIN, at + 1)
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield Gap(lost, size, reason)


def assign_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, html, digest, refers_to): refers_to is null for responses.

    Digests are counted before the shuffle, so that a payload of very many pages is one row by task;
    only digests of several pages are joined back.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = stored(first, "warc-first")
    joined = rows.join(small_side(first), "digest", "left")
    return joined.select("id", "url", "html", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(typed: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of ``assign_types`` as .warc.gz files under ``path``; returns (file, bytes, records) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["file", "bytes", "records"])

        for batch in batches:
            for page, url, html, digest, refers in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers_to")], strict=True):
                data = compress_member(build_record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers))
                if out is not None and size + len(data) > file_bytes:
                    yield close()
                    out = None
                if out is None:
                    name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            yield close()

    return stored(typed.mapInArrow(run, "file string, bytes long, records long"), "warc-files")


def read_archives(files: DataFrame, path: str) -> DataFrame:
    """(file, offset, kind, page_id, url, payload_bytes, payload_digest, refers_to, gap_end, reason) of every record and gap.

    A response's digest is that of the payload read; a revisit has what its headers say.
    """
    schema = "file string, offset long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, gap_end long, reason string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def row(file: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return file, x.start, "gap", None, None, None, None, None, x.end, x.reason
        kind = x.headers.get("warc-type")
        fields, body = x.http
        page = x.headers.get("warc-page-id")
        digest, n, refers = _hex(body), len(body), None
        if kind == "revisit":
            digest = x.headers.get("warc-payload-digest", "").removeprefix("sha256:")
            n = int(fields.get("content-length", "0"))
            refers = int(x.headers["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
        return file, x.offset, kind, int(page) if page is not None else None, x.headers.get("warc-target-uri"), n, digest, refers, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                target, rows = f"{root}/{file}", []
                size = fs.get_file_info(target).size
                with fs.open_input_file(target) as handle:
                    for x in read_archive(handle, size):
                        rows.append(row(file, x))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(parts).mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: one row per page.

    Fewer records read than written, or a gap, is an error.
    """
    small_batches(pages.sparkSession)
    path = scratch(pages.sparkSession, "warc")
    files = write_archives(assign_types(pages, key, url, html), path)
    records = stored(read_archives(files, path), "warc-records")
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    read = records.agg(F.count_if(F.col("kind") != "gap"), F.count_if(F.col("kind") == "gap")).first()
    if tuple(read) != (written, 0):
        raise RuntimeError(f"of {written} records written, {read[0]} were read back, with {read[1]} gaps; see the rows of {path}")
    return records.select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
