"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole records, with a
seek table in a skippable frame at its end (compressed and uncompressed size of each frame),
so a reader that knows a record's frame decompresses that frame alone. The index maps every
record identifier to (bundle, frame, offset in the frame, length).

Of records with equal payloads of at least REVISIT_BYTES bytes, the one with the largest
page id is a response and the others revisit it; shorter payloads are always responses.
Rows that repeat the page id and payload of a response are responses too, and share its
identifier; a row without a page id never is what others refer to, and is a response where
no row with an id has its payload. A null html is an empty payload; a null url is empty. An
empty table makes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import file_system, put_file, written

#: Payloads of fewer bytes are stored again each time.
REVISIT_BYTES = 1000
#: A frame is closed once it holds so many bytes of records.
FRAME_BYTES = 256 * 1024
#: The record's date: archives of one corpus don't depend on when they are made.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Magic numbers of the seekable format (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX_SCHEMA = "record_id string, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    value = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to``) has the response's HTTP head, which tells the payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines if ": " in line)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    return headers, raw[start:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, uncompressed) sizes that ends a bundle."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """A bundle that is read frame by frame."""

    def __init__(self, url: str) -> None:
        system, path = file_system(url)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{url} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for compressed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, compressed, plain))
            at += compressed

    def frame(self, number: int) -> bytes:
        at, compressed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(compressed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all rows to bundles in ``folder`` (one for each task that has rows); the index, a written table.

    Equal payloads meet by digest without their payloads: each task first keeps the largest id of a digest, so a frequent
    payload sends one row for each task, and the join that tells each revisit what it refers to holds ids and digests only
    (Spark splits it where a digest has too many). Payloads move at most once, dealt by page id and digest, which no
    frequent payload makes uneven, and not at all where the revisits are few enough to be broadcast. A revisit's payload
    doesn't reach Python. Other columns of ``pages``, whatever their names, aren't read.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    long = rows.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest")
    last = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = long.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    marked = marked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "bytes", "digest", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"bundle-{TaskContext.get().partitionId():08d}.warc.zst"
        index: list[tuple] = []
        frames: list[tuple[int, int]] = []
        compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)

        def close(group: list[bytes]) -> bytes:
            plain = b"".join(group)
            packed = compressor.compress(plain)
            frames.append((len(packed), len(plain)))
            return packed

        def parts() -> Iterator[bytes]:
            group, size = [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    made = record(*(c[i].as_py() for c in batch.columns))
                    index.append((record_id(batch.column(0)[i].as_py()), name, len(frames), size, len(made)))
                    group.append(made)
                    size += len(made)
                    if size >= FRAME_BYTES:
                        yield close(group)
                        group, size = [], 0
            if group:
                yield close(group)
            if frames:
                yield seek_table(frames)

        made = parts()
        first = next(made, None)
        if first is None:
            return
        put_file(f"{folder}/{name}", (p for part in ([first], made) for p in part))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for i in range(0, len(index), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index[i : i + 10_000], strict=True), kinds, strict=True)], names=["record_id", "bundle", "frame", "offset", "length"])

    return written(marked.mapInArrow(work, INDEX_SCHEMA), "warc-index")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """A row of READ_SCHEMA; a response's digest is computed again and must be the one in its header."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = next(int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    refers_to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI", ""), size, digest, kind, refers_to, payload if kind == "response" else None


def read_archives(spark: SparkSession, folder: str, index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index names, as READ_SCHEMA; the payload stays null unless asked for.

    Frames are dealt to tasks. A frame that has any of the records is read alone and once, and each record is taken from its
    offset; one that isn't there raises ValueError.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        bundle, at, raw = None, None, b""
        rows, size = [], 0
        for batch in batches:
            for identifier, name, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at[0] != name:
                    if bundle is not None:
                        bundle.close()
                    bundle, at = Bundle(f"{folder}/{name}"), (name, None)
                if at[1] != frame:
                    raw, at = bundle.frame(frame), (name, frame)
                headers, block, end = parse(raw, offset)
                if headers["WARC-Record-ID"] != identifier or end - offset != length:
                    raise ValueError(f"{identifier} is not at {offset} of frame {frame} in {name}")
                row = parsed(headers, block)
                rows.append(row if payloads else (*row[:-1], None))
                size += len(block) if payloads else 0
                if len(rows) >= 10_000 or size >= 16 * FRAME_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if bundle is not None:
            bundle.close()

    wanted = index.select("record_id", "bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return wanted.mapInArrow(work, READ_SCHEMA)


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record by its index entry; one frame is read."""
    opened = Bundle(f"{folder}/{bundle}")
    try:
        headers, block, _ = parse(opened.frame(frame), offset)
    finally:
        opened.close()
    return headers, block
