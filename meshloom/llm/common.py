"""Paths, tables and files that the operators share."""

from __future__ import annotations

import ctypes
import json
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as in the word pattern ``[^\x20\x09-\x0D]+``.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


#: Bytes of a batch between Spark and Python; Spark's own limit is four times that, and a task holds several copies.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in a batch to BATCH_BYTES, for good, unless it is lower or set in other units already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if now and int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy() -> None:
    """Give memory that is no longer used back to the system: Python workers live on and run other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def views(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without nulls, not copied."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark only: the path may be in a store that nothing else opens."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session without one gets a temporary one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='meshloom-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_BETWEEN = threading.local()


@contextmanager
def tables_in_between(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` inside are deleted at the end, except those to keep: what leaves must not read them."""
    before, _BETWEEN.paths = getattr(_BETWEEN, "paths", None), []
    try:
        yield
    finally:
        paths, _BETWEEN.paths = _BETWEEN.paths, before
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own access to files."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    path = fresh_dir(df.sparkSession, name)
    if not keep and getattr(_BETWEEN, "paths", None) is not None:
        _BETWEEN.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binary_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, utf8): the text of each row in UTF-8 (null: empty), which needs no decoding in Python."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("utf8"))


def literals(values: list, kind: str = "bigint") -> Column:
    """An array of numbers (or nulls) as one literal, however many there are."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def input_parts(df: DataFrame) -> int:
    """Into how many parts a table's rows are dealt: as many as Spark shuffles into, or reads it in, which grows with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def file_system(url: str):
    """(filesystem, path) of a URL in the shared folder."""
    from pyarrow import fs

    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    if url.startswith("/"):
        return fs.LocalFileSystem(), url
    return fs.FileSystem.from_uri(url)


def put_file(url: str, parts: Iterator[bytes]) -> int:
    """Write a file under another name and move it into place, so that a task that is lost or runs twice leaves one whole file."""
    system, path = file_system(url)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    size = 0
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(draft, path)
    return size
