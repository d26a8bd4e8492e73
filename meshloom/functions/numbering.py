"""Dense numbers and prefix sums without gathering all rows in one task.

A global ``row_number()`` moves every row to one task. Here the rows are dealt to buckets of
equal width of the order column, each bucket is numbered on its own, and only one row for
each bucket (``parts`` of them at most) is summed up globally. Numbers within parts deal by
the id alone, so that contiguous and scattered parts fill the buckets alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.tables import large

#: The most rows of a table of totals that is sent to every task.
TOTALS = 1_000_000


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: str, value: Column, name: str, top: Column | int, parts: int | None = None) -> DataFrame:
    """``df`` with the exclusive running sum of ``value`` in the order of a unique column of integers in 0..top-1.

    Lazy: the buckets' totals come from the same rows, and Spark reuses the exchange below them.
    """
    n = _parts(df, parts)
    width = F.greatest(F.lit(1), F.ceil((F.lit(top) if isinstance(top, int) else top) / n)).cast("long")
    rows = df.withColumn("__v", value.cast("long")).withColumn("__b", F.floor(F.col(order) / width).cast("long"))
    totals = rows.groupBy("__b").agg(F.sum("__v").alias("__t"))
    before = totals.select(F.col("__b"), (F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).alias("__base"))
    inner = F.sum("__v").over(Window.partitionBy("__b").orderBy(order)) - F.col("__v")
    # the totals have a row for each bucket, and there are no more buckets than ``parts``
    return large(rows.withColumn("__in", inner).join(F.broadcast(before), "__b").withColumn(name, F.col("__base") + F.col("__in")).drop("__v", "__b", "__in", "__base"))


def dense_ids(df: DataFrame, order: str, name: str, top: Column | int, parts: int | None = None) -> DataFrame:
    """``df`` with numbers 0..rows-1 in the order of a unique column of integers in 0..top-1."""
    return running_sum(df, order, F.lit(1), name, top, parts)


def ids_by_part(df: DataFrame, part: str, order: str, name: str, top: int, parts: int, local: bool = False) -> DataFrame:
    """``df`` with numbers 0..rows-1 in the order of (part, order), or ``local``: 0.. within each part.

    ``order`` is unique within a part, of integers in 0..top-1. Buckets are of equal width of ``order``, whatever the parts;
    the totals, a row for each bucket and part, are TOTALS at most.
    """
    n = max(1, min(_parts(df, None), TOTALS // max(1, parts)))
    rows = df.withColumn("__b", F.floor(F.col(order) / F.lit(max(1, -(-top // n)))).cast("long"))
    totals = rows.groupBy(F.col(part).alias("__p"), "__b").agg(F.count("*").alias("__t"))
    ordered = Window.partitionBy("__p").orderBy("__b") if local else Window.orderBy("__p", "__b")
    before = totals.select("__p", F.col("__b").alias("__c"), (F.sum("__t").over(ordered) - F.col("__t")).alias("__base"))
    inner = F.row_number().over(Window.partitionBy(part, "__b").orderBy(order)) - 1
    joined = rows.withColumn("__in", inner).join(F.broadcast(before), (F.col(part) == F.col("__p")) & (F.col("__b") == F.col("__c")))
    return large(joined.withColumn(name, F.col("__base") + F.col("__in")).drop("__b", "__c", "__p", "__in", "__base"))


def literal(values: list, kind: str) -> Column:
    """An array of numbers as one literal, however long. Spark folds it once; it would read JSON again for every row."""
    of, mark = (float, "D") if kind == "double" else (int, "L" if kind == "bigint" else "")
    return F.expr(f"CAST(array({', '.join(f'{of(v)!r}{mark}' for v in values)}) AS array<{kind}>)")


def how_many_below(column: Column, bounds: list, kind: str = "bigint") -> Column:
    """How many of the ascending bounds are at most the value, by binary search over one literal."""
    if not bounds:
        return F.lit(0)
    array = literal(bounds, kind)
    steps = F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)])
    below = lambda value: F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(array, F.least(at + step, F.lit(len(bounds)))) <= value), at + step).otherwise(at))
    return F.transform(F.array(column), below)[0]  # a list of one: the column is computed once for a row, not in every step
