"""Web archives with Zstandard: one frame per record, a shared dictionary in front.

An archive starts with a skippable frame that holds the dictionary; every record
is a frame of its own, so a reader can begin at any of them. Tasks write their
archives below a shared folder and report them in a table that Spark commits,
so archives of failed attempts are never read. Archives are read as streams: a
record, not an archive, is the most that memory holds.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import work_folder
from .texts import whole, written

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
MANIFEST = "path string, records bigint, bytes bigint"

#: An archive is closed when it has grown to this size.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most so many pages of at most so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 16_384
READ_BYTES = 65_536
#: Archives are read by at most so many tasks.
READ_TASKS = 4_096


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def http_block(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record(page: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without payload."""
    head = http_block(len(payload))
    block = head if revisits else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page}"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page is not None:
        fields.append(("Page-Id", str(page)))
    if revisits:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-Id", str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's fields and payload; ``problem`` tells what is wrong with it, else it is None."""
    out = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem"))

    def wrong(what: str) -> dict:
        return out | {"problem": what}

    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return wrong("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or name.lower() in fields:
            return wrong(f"bad or repeated header {name!r}")
        fields[name.lower()] = value.strip()
    for name in REQUIRED:
        if not fields.get(name.lower()):
            return wrong(f"{name} is missing")
    length = fields["content-length"]
    if not length.isdigit() or int(length) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        return wrong("Content-Length is not the block's length")
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    out |= {
        "page_id": number("page-id"), "record_type": fields["warc-type"], "refers_to": number("refers-to-page-id"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
    }
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(stated) != 1 or not stated[0].isdigit():
        return wrong("no HTTP header with a length")
    out["payload_bytes"] = int(stated[0])
    if out["record_type"] == "revisit":
        if payload or not fields.get("warc-refers-to"):
            return wrong("a revisit with a payload or without what it refers to")
    elif out["record_type"] != "response":
        return wrong("neither response nor revisit")
    elif len(payload) != out["payload_bytes"]:
        return wrong("the payload hasn't the stated length")
    elif base32_sha1(payload) != out["payload_digest"]:
        return wrong("the payload hasn't the stated digest")
    else:
        out["payload"] = payload
    return out


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; from too few samples, raw content that records have in common."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return record(0, "http://", b"", False, None, "")


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """A file system pyarrow can open for a URI (or a path on this machine), and the path in it."""
    uri = path.replace("s3a://", "s3://", 1)
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that the cluster's configuration gives it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


class ArchiveWriter:
    """Writes records to new archives below a folder; ``done`` lists those closed."""

    def __init__(self, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> None:
        self.folder, self.archive_bytes = folder.rstrip("/"), archive_bytes
        self.front = dictionary_frame(dictionary)
        self.compressor = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True
        )
        self.stream = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.path, self.records = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", 0
            system, at = filesystem(self.path)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            self.stream = system.open_output_stream(at, compression=None)
            self.stream.write(self.front)
            self.bytes = len(self.front)
        frame = self.compressor.compress(data)
        self.stream.write(frame)
        self.records, self.bytes = self.records + 1, self.bytes + len(frame)
        if self.bytes >= self.archive_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.path, self.records, self.bytes))
            self.stream = None


def read_dictionary(stream) -> tuple[bytes | None, bytes]:
    """The dictionary of the leading skippable frame, None if there is none, and the bytes read beyond."""
    front = stream.read(8)
    if len(front) < 8 or struct.unpack("<I", front[:4])[0] != DICTIONARY_FRAME:
        return None, front
    size = struct.unpack("<I", front[4:])[0]
    packed = stream.read(size)
    if len(packed) < size:
        raise ValueError("the dictionary frame is cut off")
    if packed[:4] == ZSTD_MAGIC:
        packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    return packed, b""


def frames(stream) -> Iterator[tuple[bytes, str | None]]:
    """Each frame's content in order; a gap that can't be decoded gives one row with what is wrong.

    Behind a gap reading goes on at the next frame that begins a record. While
    it is looked for, memory holds what was read since the gap's last try.
    """
    dictionary, rest = read_dictionary(stream)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary and zstandard.ZstdCompressionDict(dictionary))
    lost = False
    while rest or (rest := stream.read(READ_BYTES)):
        if lost:
            # Its first byte has been tried.
            at = rest.find(ZSTD_MAGIC, 1)
            if at < 0:
                more = stream.read(READ_BYTES)
                if not more:
                    return
                rest = rest[-len(ZSTD_MAGIC) :] + more
                continue
            rest = rest[at:]
        frame, parts, read = decoder.decompressobj(), [], [rest]
        try:
            while True:
                parts.append(frame.decompress(read[-1]))
                if frame.eof:
                    break
                read.append(stream.read(READ_BYTES))
                if not read[-1]:
                    raise zstandard.ZstdError("it is cut off")
        except zstandard.ZstdError as e:
            if not lost:
                yield b"", f"the frame can't be decoded: {e}"
            lost, rest = True, b"".join(read)
            continue
        content = b"".join(parts)
        if lost and not content.startswith(b"WARC/"):
            rest = b"".join(read)
            continue
        lost, rest = False, frame.unused_data
        yield content, None


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per page and gives the table of archives: path, records, bytes.

    The payload is the html in UTF-8, NULL as empty. Of pages with equal
    payloads of at least ``least_revisit_bytes`` those with the smallest id are
    responses, the others revisit it. NULL ids come last: they revisit a page
    with an id, and are responses if there is none. Rows that repeat the
    smallest id are each a response. An empty table gives no archive; other
    columns are ignored. ``folder`` must be shared, in a store that pyarrow can
    open; without a scheme it lies in the cluster's default store, for the tasks
    as for Spark.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url).cast("string").alias("url"), whole(html).alias("html"),
        F.sha1(whole(html)).alias("digest"),
    )
    sample = (
        rows.where(F.octet_length("html") <= SAMPLE_BYTES)
        .orderBy(F.xxhash64("page", "digest"), "page").select("html").limit(SAMPLE_PAGES).toArrow()
    )
    dictionary = train_dictionary([t.encode("utf-8", "surrogatepass") for t in sorted(sample.column("html").to_pylist())])
    first = rows.groupBy("digest").agg(F.min("page").alias("first"))
    # Adaptive execution splits a payload that very many pages share.
    joined = rows.join(first.hint("merge"), "digest").select("page", "url", "html", "first")
    to = f"{folder.rstrip('/')}/archives"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(to, dictionary, archive_bytes)
        for batch in batches:
            for page, url_, html_, first_ in zip(*(batch.column(c) for c in ("page", "url", "html", "first")), strict=True):
                page_, first_page = page.as_py(), first_.as_py()
                payload = html_.as_py().encode("utf-8", "surrogatepass")
                revisits = len(payload) >= least_revisit_bytes and first_page is not None and page_ != first_page
                writer.add(record(page_, url_.as_py(), payload, revisits, first_page, date))
        writer.close()
        paths, records, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    return written(joined.mapInArrow(write, MANIFEST), "manifest", folder)


READ_SCHEMA = (
    "archive string, number bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary, problem string"
)


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in the column ``path``, with ``READ_SCHEMA``.

    ``problem`` is NULL for a valid record. What can't be decoded gives one row
    per gap with the reason; reading goes on at the next record. Without
    ``payloads`` they are checked but not returned. Without archives there are
    no rows.
    """
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    schema = pa.schema([
        (n, pa.int64() if t == "bigint" else pa.binary() if t == "binary" else pa.string())
        for n, t in (part.split() for part in READ_SCHEMA.split(", "))
    ])

    def read_one(path: str) -> Iterator[dict]:
        system, at = filesystem(path)
        with system.open_input_stream(at, compression=None) as stream:
            for number, (data, problem) in enumerate(frames(stream)):
                row = parse_record(data) if problem is None else dict.fromkeys(names) | {"problem": problem}
                yield row | {"archive": path, "number": number} | ({} if payloads else {"payload": None})

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path"):
                held, size = [], 0
                for row in read_one(path.as_py()):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) >= 4_096 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    tasks = max(1, min(archives.count(), READ_TASKS))
    return archives.select("path").repartition(tasks).mapInArrow(read, READ_SCHEMA)


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives and reads them back: one row per page, in the terms of ``read_archives``."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), payloads=False)
