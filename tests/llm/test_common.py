"""What the operators share: batches, tables in between, values that aren't copied."""

import os

import pyarrow as pa

from meshloom.llm import common


def test_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for now, then in (("67108864", str(common.BATCH_BYTES)), ("1000", "1000"), ("32MB", "32MB")):
        spark.conf.set(name, now)
        common.small_batches(spark)
        assert spark.conf.get(name).rstrip("b") == then
    spark.conf.set(name, before)


def test_views():
    values = [b"", b"abc", b"", b"de"]
    assert [bytes(v) for v in common.views(pa.array(values, pa.binary()))] == values
    assert [bytes(v) for v in common.views(pa.array([b"x", *values], pa.binary()).slice(1, 3))] == values[:3]
    assert common.views(pa.array([], pa.binary())) == []


def test_tables_in_between_are_deleted(spark):
    with common.tables_in_between(spark):
        gone = common.written(spark.range(3), "gone")
        kept = common.written(gone, "kept", keep=True)
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_literals(spark):
    row = spark.range(1).select(common.literals([3, None, -5]).alias("a")).first()
    assert row["a"] == [3, None, -5]
