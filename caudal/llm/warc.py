"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, one frame per record.

`write_archives` runs one writer per Spark partition; archives end at MAX_ARCHIVE compressed bytes. Only the
archives that a successful task reports are read, so a retried task leaves no duplicates. `read_archives`
streams frame by frame and checks every header and length.

Files go through pyarrow's file systems (local, hdfs, s3, ...) into the shared folder of the session.

Defined cases: null html or url is empty; equal payloads of at least MIN_REVISIT bytes have one response, that of the smallest
page_id, however many copies there are (rows that repeat this page_id with this payload are responses too); a null page_id
gives a record without number, a response always; a page_id with several payloads gives a record of each; a very long page is
one record in one frame; an empty table gives no archive and no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, small_batches, smallest, table

#: Magic number of the skippable frame that holds a dictionary, by the public WARC/zstd proposal.
DICTIONARY_MAGIC = 0x184D2A5D
MIN_REVISIT = 100
MAX_ARCHIVE = 64 << 20
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32 << 10
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HEADER_LIMIT = 1 << 20


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_PAGES pages (those of the smallest hash), SAMPLE_BYTES of each; empty if they are too few."""
    chosen = smallest(pages.select("page_id"), "page_id", 8, SAMPLE_PAGES)
    start = F.encode(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES), "UTF-8")
    rows = pages.join(F.broadcast(chosen), "page_id", "left_semi").select(start.alias("start")).collect()
    samples = sorted(bytes(r.start) for r in rows if r.start)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has no block."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme of the cluster's default file system, unless it has one or that is the local one."""
    if ":" in folder.split("/")[0]:
        return folder
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return folder if whole.startswith("file:") else whole


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """pages: page_id, url, html, refers_to (null for a response). Returns path, records and bytes of each archive."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = opened(folder)
        store.create_dir(place, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, count, size = store.open_output_stream(f"{place}/{name}"), 0, 0
                    if dictionary:
                        size += out.write(dictionary_frame(dictionary)) or 0
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                kind = "response" if refers_to is None else "revisit"
                frame = packer.compress(record(page_id, url or "", kind, payload if kind == "response" else b"", digest, len(payload), refers_to))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= MAX_ARCHIVE:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST)


def _dictionary_of(stream: io.RawIOBase, start: bytes) -> tuple[bytes, bytes]:
    """(dictionary, bytes already read after it) of an archive whose first eight bytes are given."""
    magic, size = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        return b"", start
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame ends too soon")
    if data[:4] == b"\x28\xb5\x2f\xfd":  # the proposal lets the dictionary itself be compressed
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
    return data, b""


def frames(stream: io.RawIOBase) -> Iterator[bytes]:
    """The decoded bytes of each frame of an archive, one record at a time."""
    dictionary, held = _dictionary_of(stream, stream.read(8))
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        frame, pieces = opener.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(1 << 20)):
                raise ValueError("a frame ends too soon")
            pieces.append(frame.decompress(held))
            held = frame.unused_data
        yield b"".join(pieces)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError unless version, header lines and lengths are right."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or len(head) > HEADER_LIMIT:
        raise ValueError("a record has no end of headers")
    version, *lines = head.decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9-]+", name):
            raise ValueError(f"not a header line: {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record has no {name}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    return headers, rest[:size]


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives at manifest.path; a response's digest and length are those of the block it holds."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    names = {"response", "revisit"}

    def rows(path: str) -> Iterator[tuple]:
        store, place = opened(path)
        with store.open_input_stream(place) as stream:
            for data in frames(stream):
                headers, block = parse_record(data)
                named = re.fullmatch(r"<urn:page:(-?\d*)>", headers["warc-record-id"])
                if named is None:
                    raise ValueError(f"record id {headers['warc-record-id'][:60]!r}")
                kind, page_id = headers["warc-type"], int(named[1]) if named[1] else None
                digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"])
                if kind not in names:
                    raise ValueError(f"record type {kind!r}")
                if kind == "response" and (digest, size) != (found := (hashlib.sha256(block).hexdigest(), len(block))):
                    raise ValueError(f"page {page_id}: digest or length is not {found}")
                refers = re.fullmatch(r"<urn:page:(-?\d+)>", headers["warc-refers-to"])[1] if kind == "revisit" else None
                yield page_id, headers["warc-target-uri"], kind, size, digest, None if refers is None else int(refers), block if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 << 20:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages with refers_to: null, or the smallest page_id with the same payload of at least MIN_REVISIT bytes.

    Only ids and digests are grouped; a page joins the copies' table by its own id, so that no group of copies meets in one task.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.unhex(F.sha2(payload, 256)).alias("digest")
    sums = pages.select("page_id", digest, F.length(payload).alias("size")).filter((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    firsts = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "refers_to")
    copies = sums.join(firsts, "digest").filter(F.col("page_id") != F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    return pages.select("page_id", "url", "html", digest).join(copies, ["page_id", "digest"], "left").drop("digest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = table(write_archives(with_revisits(pages), qualified(spark, shared_folder(spark, "warc")), train_dictionary(pages)), "warc-manifest")
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH sums AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sums)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM firsts
"""
