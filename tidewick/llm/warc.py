"""WARC archives compressed with Zstandard: one frame for each record, behind a frame that holds the dictionary.

Layout of a ``.warc.zst`` file: an optional skippable frame (magic 0x184D2A5D) whose content is a dictionary, itself
possibly a Zstandard frame; then one Zstandard frame for each record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_skewed, new_path

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Bytes that are decompressed at a time.
STEP = 1 << 14

#: A new archive starts after so many compressed bytes; a dictionary is trained on so many bytes of an archive's first payloads.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 256 << 20, 1 << 20, 32 << 10
#: Algorithms of digests that are checked, with their bytes.
ALGORITHMS = {"sha1": 20, "sha256": 32, "md5": 16}

RECORD_FIELDS = "archive string, position long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"


class BadArchive(ValueError):
    """An archive that breaks the format; the message names the file and the byte."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stated(header: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest header, ``algorithm:value`` in hexadecimal or base32, or None if its form isn't known.

    A value without an algorithm is SHA-1, as some writers leave it out.
    """
    name, colon, value = header.partition(":")
    algorithm, text = (name.lower().replace("-", ""), value.strip()) if colon else ("sha1", header)
    size, bare = ALGORITHMS.get(algorithm, 0), text.rstrip("=")
    try:
        if size and len(bare) == 2 * size:
            return algorithm, bytes.fromhex(bare)
        if size and len(bare) == -(-8 * size // 5):
            return algorithm, base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
    except ValueError:
        pass
    return None


def agrees(header: str, body: bytes) -> bool:
    """Whether a body has the digest that a header states; forms that aren't known are passed on unchecked."""
    known = stated(header)
    return known is None or hashlib.new(known[0], body).digest() == known[1]


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(value: str) -> str:
    """A header value can't hold line ends."""
    return " ".join(value.splitlines())


def render(page_id: int | None, url: str | None, payload: bytes, response: int | None, is_response: bool) -> bytes:
    """A response with the payload, or a revisit that refers to one."""
    block = HTTP_HEAD + payload if is_response else HTTP_HEAD
    head = {
        "WARC-Type": "response" if is_response else "revisit",
        "WARC-Record-ID": record_urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": one_line(url or "about:blank"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if not is_response:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_urn(response), "X-Refers-To-Page-ID": str(response)}
    head["Content-Length"] = str(len(block))
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary for an archive; b"" where the payloads are too few or too small for one."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # e.g. all payloads alike
        return b""


def located(url: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URL or path, and the path in it."""
    scheme, colon, rest = url.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), os.path.normpath("/" + rest.lstrip("/")) if scheme == "file" else url
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", url))


def open_sink(url: str) -> pa.NativeFile:
    """A new file in the shared folder, on any file system that Arrow knows."""
    files, path = located(url)
    files.create_dir(os.path.dirname(path), recursive=True)
    return files.open_output_stream(path, compression=None)  # Arrow would compress by the name


def open_source(url: str) -> pa.NativeFile:
    files, path = located(url)
    return files.open_input_stream(path, compression=None)


def writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write each partition's records to archives of bounded size and return one manifest row for each archive.

    Names start with a token of the task's attempt, and the manifest names the archives of those that count: what an
    attempt that is lost or repeated has left is never read as records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = uuid.uuid4().hex
        done: list[tuple[str, int, int]] = []
        held: list[bytes] = []
        held_bytes = 0
        sink, packer, name, size, count = None, None, "", 0, 0

        def put(record: bytes) -> None:
            nonlocal size, count
            frame = packer.compress(record)
            sink.write(frame)
            size, count = size + len(frame), count + 1

        def start() -> None:
            nonlocal sink, packer, name, size, count, held, held_bytes
            name = f"{folder}/{token}-{len(done):05d}.warc.zst"
            sink = open_sink(name)
            words = train(held)
            size = count = 0
            if words:
                stored = zstd.ZstdCompressor(level=9).compress(words)
                sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored)
            packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(words) if words else None, write_content_size=True)
            for record in held:
                put(record)
            held, held_bytes = [], 0

        def finish() -> None:
            nonlocal sink
            if sink is None and held:
                start()
            if sink is not None:
                sink.close()
                done.append((name, count, size))
                sink = None

        for batch in batches:
            for row in batch.to_pylist():
                record = render(row["page_id"], row["url"], row["html"] or b"", row["response_id"], row["is_response"])
                if sink is None:
                    held.append(record)
                    held_bytes += len(record)
                    if held_bytes >= SAMPLE_BYTES:
                        start()
                else:
                    put(record)
                if sink is not None and size >= ARCHIVE_BYTES:
                    finish()
        finish()
        schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=schema)

    return run


def with_responses(pages: DataFrame, *, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Each page with the page whose record holds its payload: the largest id among equal payloads."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha2(body, 256).alias("same"))
    first = rows.groupBy("same").agg(F.max("page_id").alias("response_id"))
    # SHA-256 decides equality; SHA-1 is only what records carry.
    own = F.coalesce(F.col("page_id") == F.col("response_id"), F.col("response_id").isNull())
    return join_skewed(rows, first, ["same"]).select("page_id", "url", "html", "response_id", (own | (F.octet_length("html") < min_bytes)).alias("is_response"))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each page into ``.warc.zst`` archives under ``folder``; one row for each archive.

    Of equal payloads of ``min_bytes`` or more, the page with the largest id is the response and the others revisit it.
    Null html is an empty payload. Pages that repeat the largest id are all responses. A null id is smaller than any;
    where all ids of a payload are null, all are responses. Line ends in a URL become spaces, a null URL about:blank.
    Other columns are not read. An empty table gives no archives.
    """
    rows = with_responses(pages, page_id=page_id, url=url, html=html, min_bytes=min_bytes)
    return rows.mapInArrow(writer(folder), "archive string, records long, bytes long")


class Source:
    """A file that is read in steps; what a frame leaves over is put back."""

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.file.read(max(STEP, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        found = self.peek(n)
        self.held, self.at = self.held[len(found) :], self.at + len(found)
        return found

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held, self.at - len(data)


def frames(archive: bytes | BinaryIO, name: str) -> Iterator[tuple[int, bytes]]:
    """Each record of an archive with its byte position; of an archive that is a file, one record is held at a time."""
    source, words = Source(io.BytesIO(archive) if isinstance(archive, bytes) else archive), None
    head = source.peek(8)
    if len(head) == 8 and struct.unpack_from("<I", head)[0] == DICTIONARY_MAGIC:
        (length,) = struct.unpack_from("<I", head, 4)
        stored = source.take(8 + length)[8:]
        if len(stored) < length:
            raise BadArchive(f"{name}: the dictionary is cut short")
        words = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(stored) if stored[:4] == FRAME_MAGIC else stored)
    reader = zstd.ZstdDecompressor(dict_data=words) if words else zstd.ZstdDecompressor()
    while head := source.peek(8):
        at = source.at
        if len(head) == 8 and 0x184D2A50 <= struct.unpack_from("<I", head)[0] <= 0x184D2A5F:
            left = 8 + struct.unpack_from("<I", head, 4)[0]  # other skippable frames hold no records
            while left and (passed := source.take(min(left, STEP))):
                left -= len(passed)
            continue
        one, parts = reader.decompressobj(), []
        try:
            # In steps, as what is left over behind a frame is copied: an archive of any size takes linear time.
            while not one.eof and (step := source.take(STEP)):
                parts.append(one.decompress(step))
        except zstd.ZstdError as error:
            raise BadArchive(f"{name}: no frame at byte {at}: {error}") from error
        if not one.eof:
            raise BadArchive(f"{name}: the frame at byte {at} is cut short")
        source.back(one.unused_data)
        yield at, b"".join(parts)


def parse(record: bytes, where: str) -> dict:
    """Headers and payload of a record, checked: version, required headers, content length, block and payload digests."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    first, *fields = head.split(b"\r\n")
    if not blank or not first.startswith(b"WARC/1."):
        raise BadArchive(f"{where}: not a WARC record")
    named = {}
    for field in fields:
        key, colon, value = field.decode().partition(":")
        if not colon:
            raise BadArchive(f"{where}: a header without a colon")
        named[key.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - named.keys()
    if missing:
        raise BadArchive(f"{where}: no {', '.join(sorted(missing))}")
    length = named["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: the length of the block isn't {length}")
    block = rest[:-4]
    if (said := named.get("warc-block-digest", "")) and not agrees(said, block):
        raise BadArchive(f"{where}: the block doesn't match its digest")
    http = named.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    said = named.get("warc-payload-digest", "")
    full = named["warc-type"] != "revisit"
    if full and said and not agrees(said, payload):
        raise BadArchive(f"{where}: the payload doesn't match its digest")
    known = stated(said) if said else None
    # SHA-1 in base32 where it is known: of a full payload always, of a revisit if that is what it states.
    shown = digest(payload) if full or not said else base64.b32encode(known[1]).decode() if known and known[0] == "sha1" else said
    number = lambda key: int(named[key]) if key in named else None
    return {
        "record_type": named["warc-type"],
        "record_id": named["warc-record-id"],
        "target_uri": named.get("warc-target-uri"),
        "page_id": number("x-page-id"),
        "refers_to": number("x-refers-to-page-id"),
        "payload_digest": shown,
        "payload_bytes": len(payload) if full else number("x-payload-length"),
        "payload": payload if full else None,
    }


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in RECORD_FIELDS.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for name in batch.column("path").to_pylist():
            rows, held = [], 0
            with open_source(name) as file:
                for at, record in frames(file, name):
                    rows.append({"archive": name, "position": at, **parse(record, f"{name}, byte {at}")})
                    held += len(record)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each record of ``.warc.zst`` archives, which Spark lists and tasks read; a broken archive raises.

    A task opens an archive where it lies, on a file system that Arrow knows, and reads it frame by frame, so archives
    may have any size; a record has to fit in memory. What :func:`write_archives` wrote is read by its manifest with
    :func:`read_written`: nothing is listed then, and its rows name the archives of the attempts that count.

    Digests are checked by what they state: SHA-1, SHA-256 or MD5, in hexadecimal or base32; others are passed on. The
    column ``payload_digest`` is the SHA-1 in base32, but of a revisit that states another digest that one.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path")
    return files.mapInArrow(_records, RECORD_FIELDS)


def read_written(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a stored ``manifest``, dealt out archive by archive."""
    return manifest.select(F.col("archive").alias("path")).repartition(max(1, manifest.count())).mapInArrow(_records, RECORD_FIELDS)


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """The revisits of some records that no response with the page they refer to and their payload's digest answers."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left_anti").select(*records.columns)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back; no pages, no records."""
    spark = pages.sparkSession
    return read_written(cut(write_archives(pages, new_path(spark, "warc")), "warc-manifest"))
