"""WARC archives in Zstandard: writing with revisit records, and reading back.

An archive starts with a skippable frame that holds a dictionary, followed by one Zstandard frame per record. The
reader loads the dictionary, decodes frame by frame from a stream, and validates headers, lengths and digests.

Archives are written where the caller says, by any path that pyarrow's file systems open; names are unique, and only
those in the returned manifest count, so a task that ran twice does no harm.

Defined results: a null html is an empty payload; a null url is left out of its record; a page whose id is null is a
response only where no record with an equal payload has an id; rows equal in id and payload get the same type; an empty
table gives no archive and no rows; records of any length are held one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import bounded_batches, plain_memory, same, shared_path, staged

#: Magic numbers of the dictionary's skippable frame and of a Zstandard frame; the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = ("WARC/1.0", "WARC/1.1")
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: The dictionary is trained for each archive on its first records, of so many bytes at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
#: An archive is closed when its records pass so many bytes.
ARCHIVE_BYTES = 256 << 20
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string, position long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC record: a response with the payload, or a revisit with its HTTP header alone."""
    digest = payload_digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}"] if url is not None else []
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The record's fields; ValueError where a header or a length is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in VERSIONS:
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [n for n in NEEDED if n.lower() not in fields]:
        raise ValueError(f"headers missing: {missing}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, but the record has {len(rest) - 4}")
    kind, (http, _, payload) = fields["warc-type"], rest[:length].partition(b"\r\n\r\n")
    if kind not in ("response", "revisit"):
        return {"record_type": kind, "payload": rest[:length], "fields": fields}
    declared = dict(x.lower().split(":", 1) for x in http.decode("latin-1").split("\r\n")[1:] if ":" in x)
    size = int(declared.get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if size != len(payload):
            raise ValueError(f"HTTP length {size}, but the payload has {len(payload)}")
        if digest and digest != payload_digest(payload):
            raise ValueError("payload digest differs")
        digest = digest or payload_digest(payload)
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("x-page-id"), "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None, "fields": fields}


class ArchiveWriter:
    """Writes records to a stream; the first ones are held back until the dictionary is made."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.held, self.size, self.records, self.compressor = out, level, [], 0, 0, None

    def _start(self) -> None:
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, self.held, k=256, d=8)
        except zstandard.ZstdError:  # too few samples: their bytes as they are
            made = zstandard.ZstdCompressionDict(b"".join(self.held)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed = zstandard.ZstdCompressor(level=self.level).compress(made.as_bytes())
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=made)
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.compressor:
            self.out.write(self.compressor.compress(data))
        else:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self._start()

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.out.close()


#: Bytes handed to the decoder at once: what a frame leaves of them is all that is copied.
DECODE_BYTES = 16 << 10


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; skippable frames other than the leading dictionary are passed over."""
    held, at, made, first, ended = b"", 0, None, True, False

    def need(n: int) -> bool:
        nonlocal held, at, ended
        while len(held) - at < n and not ended:
            more = stream.read(max(chunk, n - len(held) + at))
            ended = not more
            held, at = held[at:] + more, 0
        return len(held) - at >= n

    while need(4):
        magic = struct.unpack_from("<I", held, at)[0]
        if magic >> 4 == DICTIONARY_MAGIC >> 4:
            if not need(8) or not need(8 + (size := struct.unpack_from("<I", held, at + 4)[0])):
                raise ValueError("a skippable frame is cut off")
            if first and magic == DICTIONARY_MAGIC:
                raw = held[at + 8 : at + 8 + size]
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == FRAME_MAGIC else raw
                made = zstandard.ZstdCompressionDict(raw)
            at, first = at + 8 + size, False
            continue
        if held[at : at + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame, but {held[at : at + 4]!r}")
        first, out = False, []
        decoder = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
        while not decoder.eof:
            if not need(1):
                raise ValueError("a frame is cut off")
            some = memoryview(held)[at : at + DECODE_BYTES]
            out.append(decoder.decompress(some))
            at += len(some) - (len(decoder.unused_data) if decoder.eof else 0)
        yield b"".join(out)
    if len(held) > at:
        raise ValueError("bytes after the last frame")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1)  # one store, two names
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def with_revisits(pages: DataFrame, least: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, html, refers_to, revisit. Only ids and digests are dealt by digest; payloads move by id at most."""
    read = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    read = read.withColumn("key", F.sha2(F.col("html"), 256))
    ids = read.filter(F.octet_length("html") >= least).groupBy("key", "page_id").agg(F.lit(1).alias("one"))
    first = ids.groupBy(F.col("key").alias("of")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = ids.join(first, F.col("key") == F.col("of")).filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to")
    again = again.select(F.col("key").alias("r_key"), F.col("page_id").alias("r_id"), "refers_to")
    joined = read.join(again, (F.col("key") == F.col("r_key")) & same(F.col("page_id"), F.col("r_id")), "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("r_key").isNotNull().alias("revisit"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_revisits(); returns the manifest (archive, records, bytes), itself a written table."""

    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        fs, base = opened(folder)
        writer, done, name = None, [], ""
        for batch in batches:
            for page, url, html, refers, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                writer.add(record(page, url, html.encode("utf-8", "surrogatepass"), refers, revisit, date))
                if writer.size >= archive_bytes:
                    writer.close()
                    done.append((f"{folder}/{name}", writer.records, writer.size))
                    writer = None
        if writer:
            writer.close()
            done.append((f"{folder}/{name}", writer.records, writer.size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return staged(records.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives named in column ``archive``; a damaged archive fails the job with its name."""
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = opened(archive)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for k, data in enumerate(frames(stream)):
                        try:
                            got = parsed(data)
                        except ValueError as e:
                            raise ValueError(f"{archive}, record {k}: {e}") from e
                        rows.append(tuple(got.get(n) if n != "payload" or payloads else None for n in names[:7]) + (archive, k))
                        size += len(data) if payloads else 200
                        if size > 8 << 20:
                            yield make(rows)
                            rows, size = [], 0
                if rows:
                    yield make(rows)

    n = manifest.count()  # archives, not records
    return manifest.select("archive").repartition(max(1, n)).mapInArrow(run, RECORDS)


def archived(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back, without the payloads."""
    manifest = write_archives(with_revisits(pages, least), shared_path(spark, "warc"))
    return read_archives(manifest, payloads=False).filter(F.col("record_type").isin("response", "revisit"))


#: Four groups of ten hexadecimal digits, 40 bits each, as eight base-32 digits.
_GROUPS = " || ".join(f"to_base(('0x' || substr(x, {i}, 10))::BIGINT, 32, 8)" for i in (1, 11, 21, 31))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     m AS (SELECT html AS h, min(page_id) AS first FROM p GROUP BY html),
     j AS (SELECT page_id, html, first, sha1(html) AS x FROM p JOIN m ON h = html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       translate({_GROUPS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM j"""
