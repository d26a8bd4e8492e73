"""BPE encoding and decoding with a byte-level vocabulary, by a pair occurrence index (see ``pairs``).

Each task encodes its own rows: no shuffle, no state between tasks but a bounded table of
units. A row's text is null: empty. Repeated rows and other columns don't matter; a null
key stays null. Texts of any length are encoded whole, in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshloom.llm.common import binary_table
from meshloom.llm.units import ByteUnits, blocks, kept


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(ByteUnits, vocabulary)
        for part in blocks(batches):
            ids, sizes = encoder.encode(part.column("utf8").to_pylist())
            ends = np.cumsum(sizes)
            rows = [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=[key, "ids"])

    return binary_table(docs, key, text).mapInArrow(work, f"{key} long, ids binary")


def decoded(ids: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of a table (key, ids); bytes that aren't UTF-8 become replacement characters, special strings stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(ByteUnits, vocabulary).table
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [table.decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(work, f"{key} long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text is encoded, and its ids alone are decoded, in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(ByteUnits, vocabulary)
        for part in blocks(batches):
            ids, sizes = encoder.encode(part.column("utf8").to_pylist())
            ends = np.cumsum(sizes)
            of_ids, of_text = [], []
            for n, b in zip(sizes.tolist(), ends.tolist(), strict=True):
                own = ids[b - n : b].astype("<u4")
                of_ids.append(hashlib.sha256(own.tobytes()).hexdigest())
                back = encoder.table.decode(own).decode(errors="replace")
                of_text.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return binary_table(docs, key, text).mapInArrow(work, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
