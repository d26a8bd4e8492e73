"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the corpus, the most frequent id first, so that most take
one byte. Each rank takes one to four bytes; two bits of a control byte hold the length of
each of four ranks. Control bytes and data bytes lie apart, so numpy decodes a file with one
table lookup for the lengths and one gather for the values, a slice of documents at a time.

A file (little-endian): magic, then as unsigned 64-bit integers the number of documents, of
ids, of ids in all files before it, and of data bytes; a byte for each document that is 1 if
it has a key, the keys (64 bits), the numbers of ids (64 bits), control, data. The file
``ranks`` beside them has the ids by rank (32 bits each).

Writing: texts go to ranges of the key in one shuffle, and each range is tokenized in key
order into drafts of plain ids. A draft is closed once it has FILE_IDS ids, so what a task
and a file hold doesn't grow. The ids' counts, one row for each id and draft,
are summed; the vocabulary bounds what the driver gets. Then each draft is coded again with
the ranks of the corpus and deleted once the file stands. Every file is written under
another name and moved, so tasks can run again at any time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import binary_table, file_system, input_parts, literals, put_file, tables_in_between, written
from meshloom.llm.units import WordUnits, blocks, kept

#: Ids after which a file is closed, and ids that are coded or decoded at once.
FILE_IDS, SLICE_IDS = 1 << 24, 1 << 20
MAGIC = b"MLTOKENS"
HEAD = struct.Struct("<8s4Q")
DRAFT = struct.Struct("<3Q")
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes(), data.tobytes()


class Unpacker:
    """Reads the values of ``pack`` from the first on, some at a time."""

    def __init__(self, control: bytes, data: bytes) -> None:
        self.control = np.frombuffer(control, np.uint8)
        self.words = np.ndarray(len(data), "<u4", data + b"\0\0\0", strides=(1,))
        self.at = self.place = 0

    def take(self, n: int) -> np.ndarray:
        """The next ``n`` values."""
        if not n:
            return np.zeros(0, np.uint32)
        skip = self.at % 4
        lengths = LENGTHS[self.control[self.at // 4 : (self.at + n + 3) // 4]].reshape(-1)[skip : skip + n]
        ends = np.cumsum(lengths, dtype=np.int64) + self.place
        found = self.words[ends - lengths] & MASKS[lengths]
        self.at, self.place = self.at + n, int(ends[-1])
        return found


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    return Unpacker(control, data).take(n)


def ranked(counts: np.ndarray) -> np.ndarray:
    """Ids that occur, the most frequent first; ties by id."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    return order[: int((counts > 0).sum())].astype(np.uint32)


def documents_part(keys: list, sizes: np.ndarray) -> Iterator[bytes]:
    yield bytes(k is not None for k in keys)
    yield np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    yield sizes.astype("<i8").tobytes()


def read_documents(raw: bytes, n: int, at: int) -> tuple[list, np.ndarray, int]:
    """(keys, numbers of ids, where what follows begins)"""
    known, keys, sizes = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, "<i8", n, at + n), np.frombuffer(raw, "<i8", n, at + 9 * n)
    return [k if there else None for k, there in zip(keys.tolist(), known.tolist(), strict=True)], sizes, at + 17 * n


def file_parts(keys: list, sizes: np.ndarray, ids: np.ndarray, first: int, by_rank: np.ndarray) -> Iterator[bytes]:
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    coded = [pack(rank[ids[i : i + SLICE_IDS]]) for i in range(0, len(ids), SLICE_IDS)]  # SLICE_IDS is a multiple of four
    yield HEAD.pack(MAGIC, len(keys), len(ids), first, sum(len(data) for _, data in coded))
    yield from documents_part(keys, sizes)
    yield from (control for control, _ in coded)
    yield from (data for _, data in coded)


def read_file(url: str, by_rank: np.ndarray, documents: int = 2_000) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """(keys, numbers of ids, ids, ids before) of slices of a file: so many documents at most, or one with more than SLICE_IDS ids."""
    raw = whole_file(url)
    magic, n_docs, n_ids, first, n_data = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError(f"{url} is no token file")
    keys, sizes, at = read_documents(raw, n_docs, HEAD.size)
    n_control = -(-n_ids // 4)
    unpacker = Unpacker(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data])
    del raw
    ends, i = np.cumsum(sizes), 0
    while i < n_docs:
        before = int(ends[i - 1]) if i else 0
        j = min(max(int(np.searchsorted(ends, before + SLICE_IDS, side="right")), i + 1), i + documents, n_docs)
        yield keys[i:j], sizes[i:j], by_rank[unpacker.take(int(ends[j - 1]) - before)], first + before
        i = j


def draft_parts(keys: list, sizes: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """Plain ids, as wide as their type."""
    yield DRAFT.pack(len(keys), len(ids), ids.itemsize)
    yield from documents_part(keys, sizes)
    yield ids.tobytes()


def read_draft(url: str) -> tuple[list, np.ndarray, np.ndarray]:
    raw = whole_file(url)
    n_docs, n_ids, width = DRAFT.unpack_from(raw)
    keys, sizes, at = read_documents(raw, n_docs, DRAFT.size)
    return keys, sizes, np.frombuffer(raw, f"<u{width}", n_ids, at)


def whole_file(url: str) -> bytes:
    system, path = file_system(url)
    with system.open_input_file(path) as f:
        return f.read()


def range_part(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    array = literals(bounds)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(array, F.least(at + step, F.lit(len(bounds)))) < column), at + step).otherwise(at))
    return F.coalesce(F.when(column.isNotNull(), found), F.lit(0))


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending values that deal the rows out evenly; only this column is read."""
    if parts < 2:
        return []
    row = df.agg(F.percentile_approx(F.col(column).cast("long"), [k / parts for k in range(1, parts)], 100 * parts).alias("b")).first()
    return sorted(set(row["b"] or []))


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int, parts: int | None = None, key: str = "doc_id", text: str = "text") -> int:
    """Write all texts to ``folder`` in ascending order of the key (nulls first; rows with the same key by text); the number of files.

    A null text is empty: only the end id. An empty table makes no file. Other columns, whatever their names, aren't read.
    Rows that share a key, or lack one, are sorted in one task, which spills.
    """
    spark = docs.sparkSession
    parts = parts or input_parts(docs.select(key, text))
    bounds = quantile_bounds(docs, key, parts)
    rows = binary_table(docs, key, text).withColumn("part", range_part(F.col(key), bounds))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", key, "utf8")

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(WordUnits, vocabulary)
        part, number, keys, sizes, ids, size = None, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            flat, n = np.concatenate(ids), np.concatenate(sizes)
            counts = np.bincount(flat)
            put_file(f"{folder}/{draft_name(part, number)}", draft_parts(keys, n, flat))
            seen = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), part, np.int32)), pa.array(np.full(len(seen), number, np.int32)), pa.array(seen), pa.array(counts[seen])], names=["part", "number", "id", "n"])

        for block in blocks(batches):
            of = block.column("part").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(np.diff(of)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if part is not None and (part != int(of[a]) or size >= FILE_IDS):
                    yield close()
                    number = number + 1 if part == int(of[a]) else 0
                    keys, sizes, ids, size = [], [], [], 0
                part = int(of[a])
                own = block.slice(a, b - a)
                flat, n = encoder.encode(own.column("utf8").to_pylist())
                keys += own.column(0).to_pylist()
                ids.append(np.insert(flat, np.cumsum(n), end_id).astype(np.uint16 if len(encoder.ends) < 1 << 16 else np.uint32))
                sizes.append(n + 1)
                size += len(ids[-1])
        if part is not None:
            yield close()

    with tables_in_between(spark):
        counts = written(dealt.mapInArrow(draft, "part int, number int, id long, n long"), "token-counts")
        by_id = {r["id"]: r["n"] for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
        totals = sorted(counts.groupBy("part", "number").agg(F.sum("n").alias("n")).collect())  # a row for each file
    whole = np.zeros(max(by_id, default=-1) + 1, np.int64)
    whole[list(by_id)] = list(by_id.values())
    by_rank = ranked(whole)
    put_file(f"{folder}/ranks", iter([by_rank.astype("<u4").tobytes()]))
    plan, first = [], 0
    for k, (part, number, n) in enumerate(totals):
        plan.append((k, part, number, first))
        first += n

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for k, part, number, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = f"{folder}/{draft_name(part, number)}"
                system, path = file_system(old)
                if system.get_file_info(path).type != fs.FileType.NotFound:  # else the file stands since an earlier attempt
                    put_file(f"{folder}/tokens-{k:08d}", file_parts(*read_draft(old), start, by_rank))
                    system.delete_file(path)
            yield batch

    if plan:
        schema = "k int, part int, number int, first long"
        one_each(spark, plan, schema).mapInArrow(final, schema).write.format("noop").mode("overwrite").save()
    return len(plan)


def draft_name(part: int, number: int) -> str:
    return f"draft-{part:08d}-{number:05d}"


def one_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows whose first column counts from 0, each in a partition of its own."""
    return spark.createDataFrame(rows, schema).repartitionById(len(rows), F.col(schema.split()[0]))


def read_tokens(spark: SparkSession, folder: str, files: int, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document of the files; unused columns cost little."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                by_rank = np.frombuffer(whole_file(f"{folder}/ranks"), "<u4")
                for keys, sizes, ids, first in read_file(f"{folder}/tokens-{k:08d}", by_rank):
                    ends = np.cumsum(sizes)
                    runs = [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array(keys, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(list(map(zlib.crc32, runs)), pa.int64()), pa.array(runs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32", "ids"])

    schema = f"{key} long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    return one_each(spark, [(k,) for k in range(files)], "k int").mapInArrow(read, schema)


def token_index(spark: SparkSession, folder: str, files: int, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files."""
    return read_tokens(spark, folder, files, key).drop("ids")
