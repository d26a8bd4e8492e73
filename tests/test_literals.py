"""Arrays in plans are literals, which Spark doesn't read again for every row."""

import pytest
from pyspark.sql import functions as F

from meshloom.functions.numbering import how_many_below, literal
from meshloom.operators.graph import DualGraph
from meshloom.operators.partitioners import along_curve
from meshloom.operators.tables import Tables
from meshloom.sources.lattice import lattice


@pytest.mark.parametrize("kind, bounds", [("bigint", [-5, 0, 3, 3 << 40]), ("double", [-0.5, 1e-7, 0.1, 1e300]), ("int", [-1, 2]), ("int", [])])
def test_arrays_are_read_once_not_for_each_row(spark, kind, bounds):
    found = spark.range(-10, 10).select("id", literal(bounds, kind).alias("a"), how_many_below(F.col("id"), bounds, kind).alias("n"))
    assert "json" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.schema["a"].dataType.elementType.simpleString() == kind
    assert all(r["a"] == bounds and r["n"] == sum(b <= r["id"] for b in bounds) for r in found.collect())


def test_the_column_is_computed_once_for_a_row(spark):
    found = spark.range(100).select(how_many_below(F.sqrt(F.col("id").cast("double") + 0.25), [1, 2, 3, 4, 5, 6, 7, 8], "double").alias("n"))
    assert [r["n"] for r in found.collect()] == [min(8, int((k + 0.25) ** 0.5)) for k in range(100)]
    step = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert step.index("sqrt") < step.index("aggregate(")


def test_the_curve_is_a_column_of_a_table(spark):
    with Tables(spark) as tables:
        rows, total = along_curve(DualGraph(lattice(spark, 2)), tables)
        assert total == 48 and rows.columns == ["cell", "curve", "w"]
        assert "shiftleft" not in rows._jdf.queryExecution().optimizedPlan().toString()
