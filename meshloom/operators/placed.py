"""Meshes that lie by part: tables bucketed by part, with copies of the cells across the border.

``Placed.of`` writes the sides of all cells bucketed by part, and which cells of other parts each
part touches (its ghosts). ``place`` writes values of cells the same way: each part gets its
own cells and its ghosts. That exchange of border cells is all that moves; every join of
sides with values, and every aggregation by cell, then finds its rows in its bucket, without
a shuffle, as often as it runs.

The frames belong to a session of their own that shares the catalog and has one setting
changed: Spark's default shuffles a join by (part, cell) even where both sides lie by part.
Tables are registered in the catalog and lie in the folder in spark.checkpoint.dir;
``drop`` deletes them. A part is read by one task: choose parts that a task can stream. No
part is ever held in memory, neither by joins, which sort and spill, nor by ``fold_faces``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.mesh import Mesh
from meshloom.operators.tables import delete, large, own_session, shared_folder


class Handler(Protocol):
    """Code of a user that goes through the faces of one part."""

    def faces(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Some sides of the part, those of one cell together and cells in order; what it returns goes to the result."""

    def close(self) -> pa.RecordBatch | None:
        """The end of the part."""


@dataclass(frozen=True)
class Placed:
    """``sides``: (part, cell, slot, face, nbr_cell, nbr_part, is_boundary); ``ghosts``: (part, cell, of), cells of part ``of`` beside those of a part."""

    spark: SparkSession
    buckets: int
    sides: DataFrame
    ghosts: DataFrame
    names: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, mesh: Mesh, buckets: int | None = None) -> Placed:
        spark = by_part_session(mesh.raw_cells.sparkSession)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        names: list[str] = []
        rows = mesh.face_sides.select("part", "cell", "slot", "face", "nbr_cell", "nbr_part", "is_boundary")
        sides = bucketed(spark, rows.repartition(buckets, "part"), buckets, names)
        ghosts = sides.where("nbr_part <> part").select("part", F.col("nbr_cell").alias("cell"), F.col("nbr_part").alias("of")).distinct()
        return cls(spark, buckets, sides, bucketed(spark, ghosts, buckets, names), names)

    def place(self, values: DataFrame, lies: bool = False) -> DataFrame:
        """Values (part, cell, ...) of all cells by their parts, with copies for the parts that have them as ghosts; ``is_ghost`` tells them apart.

        ``lies``: the values were computed from tables of this mesh and lie by part already, so only ghosts move.
        """
        own = values.withColumn("is_ghost", F.lit(False))
        made = bucketed(self.spark, own if lies else own.repartition(self.buckets, "part"), self.buckets, self.names)
        across = large(self.ghosts).join(made.drop("is_ghost").withColumnRenamed("part", "of"), ["of", "cell"]).drop("of").withColumn("is_ghost", F.lit(True))
        return bucketed(self.spark, across.select(made.columns).repartition(self.buckets, "part"), self.buckets, self.names, self.names[-1])

    def for_each_face(self, external: DataFrame, internal: DataFrame | None = None, boundary: bool = True) -> DataFrame:
        """The sides with the values of both cells, as ``Mesh.for_each_face`` has them; the frames come from ``place``."""
        sides = self.sides if boundary else self.sides.where("not is_boundary")
        named = lambda df, key, mark: df.select("part", F.col("cell").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in ("part", "cell", "is_ghost")]).hint("merge")
        out = sides.join(named(external, "nbr_cell", "ext"), ["part", "nbr_cell"], "left")
        return out if internal is None else out.join(named(internal.where("not is_ghost"), "cell", "int"), ["part", "cell"], "left")

    def fold_faces(self, rows: DataFrame, make: Callable[[int], Handler], schema: str) -> DataFrame:
        """What handlers return that go through ``rows`` (of ``for_each_face``), one handler for each part.

        ``make`` gets the part's number. A handler sees its part in batches, never in whole. It may run again for a part whose task
        is lost, so its results are what it returns.
        """

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, handler = None, None
            for batch in batches:
                of = batch.column("part").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if handler is None or part != int(of[a]):
                        if handler is not None and (made := handler.close()) is not None:
                            yield made
                        part = int(of[a])
                        handler = make(part)
                    if (made := handler.faces(batch.slice(a, b - a))) is not None:
                        yield made
            if handler is not None and (made := handler.close()) is not None:
                yield made

        return rows.sortWithinPartitions("part", "cell", "slot").mapInArrow(work, schema)

    def drop(self) -> None:
        """Delete the tables; what was read from them must not be used any more."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{shared_folder(self.spark)}/{name}")
        self.names.clear()


def by_part_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the user's in which joins by (part, cell) use buckets of parts; the user's stays as it is."""
    return own_session(spark, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def bucketed(spark: SparkSession, df: DataFrame, buckets: int, names: list[str], into: str | None = None) -> DataFrame:
    """``df`` as a table of so many buckets of parts, sorted by cell, or added to the table ``into``; its name is added to ``names``."""
    name = into or f"placed_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, "part").sortBy("part", "cell").format("parquet")
    if into:
        writer.mode("append").saveAsTable(name)
    else:
        writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
        names.append(name)
    return spark.table(name)


class CellSums:
    """A handler that sums a column over the faces of each cell: (part, cell, total, faces)."""

    def __init__(self, part: int, column: str) -> None:
        self.part, self.column, self.open = part, column, None

    def made(self, rows: list[tuple[int, int, int]]) -> pa.RecordBatch | None:
        if not rows:
            return None
        cell, total, faces = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([self.part] * len(rows), pa.int32()), pa.array(cell, pa.int64()), pa.array(total, pa.int64()), pa.array(faces, pa.int64())], names=["part", "cell", "total", "faces"])

    def faces(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        cell, value = rows.column("cell").to_numpy(zero_copy_only=False), rows.column(self.column)
        there = np.array(value.is_valid())
        number = value.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
        done = list(zip(cell[first].tolist(), np.add.reduceat(number, first).tolist(), np.add.reduceat(there.astype(np.int64), first).tolist(), strict=True))
        if self.open and self.open[0] == done[0][0]:  # the cell's faces came in two batches
            done[0] = (done[0][0], done[0][1] + self.open[1], done[0][2] + self.open[2])
        elif self.open:
            done.insert(0, self.open)
        self.open = done.pop()
        return self.made(done)

    def close(self) -> pa.RecordBatch | None:
        return self.made([self.open] if self.open else [])
