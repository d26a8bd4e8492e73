"""Reading and writing meshes: Parquet, CSV and HDF5 in, Parquet, CSV, XDMF and JSON out."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from meshloom.functions.distribute import Blocks
from meshloom.functions.numbering import ids_by_part
from meshloom.functions.topology import TETRAHEDRON, Topology
from meshloom.functions.types import composite, spark_type
from meshloom.operators.mesh import Mesh


def split_name(name: str) -> tuple[str, str]:
    """``file:/dataset`` in its two parts."""
    parts = name.split(":")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"{name} isn't of the form file:/dataset")
    return parts[0], parts[1]


def cell_schema(topology: Topology) -> T.StructType:
    return T.StructType([T.StructField("orig_gid", T.LongType(), False), *[T.StructField(f"v{i}", T.LongType(), False) for i in range(topology.vertices)]])


VERTEX_SCHEMA = T.StructType([T.StructField("vid", T.LongType(), False), *[T.StructField(a, T.DoubleType(), False) for a in "xyz"]])


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast to its types; ids must not be negative or null."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, T.LongType):
            c = F.when(c >= 0, c).otherwise(F.raise_error(F.lit(f"{f.name} isn't an id of 63 bits")))
        out.append(c.alias(f.name))
    return df.select(*out)


def read_mesh(spark: SparkSession, cells: str, vertices: str, file_format: str = "parquet", topology: Topology = TETRAHEDRON, parts: int = 1) -> Mesh:
    """A mesh from tables (orig_gid, v0...) and (vid, x, y, z), or from HDF5 datasets named ``file:/dataset``."""
    if file_format == "hdf5":
        register(spark)
        load = lambda name, kind: spark.read.format("mesh_hdf5").option("name", name).option("kind", kind).option("blocks", str(max(parts, spark.sparkContext.defaultParallelism))).option("width", str(topology.vertices)).load()
        return Mesh(load(cells, "cells"), load(vertices, "vertices"), topology)
    options = {"header": "true"} if file_format == "csv" else {}
    load = lambda path: spark.read.format(file_format).options(**options).load(path)
    return Mesh(checked(load(cells), cell_schema(topology)), checked(load(vertices), VERTEX_SCHEMA), topology)


def read_attribute(spark: SparkSession, name: str, element: str = "int", sizes: tuple[int, ...] = (), key: str = "orig_gid", file_format: str = "hdf5", blocks: int = 8) -> DataFrame:
    """(key, value) of an attribute; its type is declared, not inferred."""
    if file_format == "hdf5":
        register(spark)
        found = spark.read.format("mesh_hdf5").option("name", name).option("kind", "attribute").option("element", element).option("sizes", ",".join(map(str, sizes))).option("blocks", str(blocks)).load()
        return found.select(F.col("row").alias(key), "value")
    found = spark.read.format(file_format).load(name)
    return found.select(F.col(key).cast("long"), F.col("value").cast(composite(spark_type(element), sizes)))


#: The most rows of an input partition of an HDF5 dataset, and of a slice of it that is held in memory.
BLOCK_ROWS, SLICE_ROWS = 4_000_000, 100_000


class Block(InputPartition):
    def __init__(self, offset: int, size: int) -> None:
        super().__init__(None)
        self.offset, self.size = offset, size


class MeshHdf5(DataSource):
    """HDF5 datasets in even blocks of rows, read in slices as Arrow batches. h5py is needed where it runs."""

    @classmethod
    def name(cls) -> str:
        return "mesh_hdf5"

    def schema(self) -> T.StructType:
        kind = self.options.get("kind", "cells")
        if kind == "cells":
            return T.StructType([T.StructField("orig_gid", T.LongType()), *[T.StructField(f"v{i}", T.LongType()) for i in range(int(self.options.get("width", "4")))]])
        if kind == "vertices":
            return VERTEX_SCHEMA
        sizes = tuple(int(s) for s in self.options.get("sizes", "").split(",") if s)
        return T.StructType([T.StructField("row", T.LongType()), T.StructField("value", composite(spark_type(self.options.get("element", "int")), sizes))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MeshHdf5Reader(dict(self.options), self.schema())


class MeshHdf5Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.schema = options, schema
        self.file, self.dataset = split_name(options["name"])

    def opened(self):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("reading HDF5 needs the package h5py") from e
        return h5py.File(self.file, "r")

    def shape(self) -> tuple[int, ...]:
        with self.opened() as f:
            shape = tuple(f[self.dataset].shape)
        kind = self.options.get("kind", "cells")
        sizes = tuple(int(s) for s in self.options.get("sizes", "").split(",") if s)
        want = {"cells": (int(self.options.get("width", "4")),), "vertices": (3,)}.get(kind, sizes)
        if shape[1:] != want:
            raise ValueError(f"{self.options['name']} has rows of shape {shape[1:]}, not {want}")
        return shape

    def partitions(self) -> list[Block]:
        """As many blocks as asked for, or more, so that none has over BLOCK_ROWS rows."""
        rows = self.shape()[0]
        n = max(int(self.options.get("blocks", "8")), -(-rows // BLOCK_ROWS))
        blocks = Blocks(rows, n)
        return [Block(*blocks.offset_and_size(k)) for k in range(n) if blocks.offset_and_size(k)[1]]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        kind = self.options.get("kind", "cells")
        types = [f.type for f in to_arrow_schema(self.schema)]
        with self.opened() as f:
            for at in range(partition.offset, partition.offset + partition.size, SLICE_ROWS):
                rows = np.asarray(f[self.dataset][at : min(at + SLICE_ROWS, partition.offset + partition.size)])
                if kind == "attribute":
                    columns = [rows if rows.ndim == 1 else rows.tolist()]
                else:
                    columns = [rows[:, k] for k in range(rows.shape[1])]
                ids = np.arange(at, at + len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *columns], types, strict=True)], names=self.schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeshHdf5)


def write_mesh(mesh: Mesh, folder: str, file_format: str = "parquet") -> None:
    """``cells`` and ``vertices`` as distributed, below a folder; arrays only fit Parquet."""
    mesh.cells.write.format(file_format).option("header", "true").save(f"{folder}/cells")
    vertices = mesh.vertices if file_format == "parquet" else mesh.vertices.drop("parts")
    vertices.write.format(file_format).option("header", "true").save(f"{folder}/vertices")


def write_xdmf(mesh: Mesh, path: str, values: DataFrame | None = None, name: str = "partition") -> None:
    """A small mesh with one cell variable (gid, value) as XDMF with inline data: for viewing, through the driver.

    Vertices are numbered by id among those that cells use.
    """
    vertices = mesh.vertices.select("vid", "x", "y", "z").orderBy("vid")
    cells = mesh.cells.select("gid", "part", *mesh.slots)
    cells = cells.join(values.select("gid", F.col("value").alias("own")), "gid", "left") if values is not None else cells.withColumn("own", F.col("part"))
    at, points = {}, []
    for r in vertices.toLocalIterator():
        at[r["vid"]] = len(points)
        points.append(f"{r['x']:.17g} {r['y']:.17g} {r['z']:.17g}")
    shapes, data = [], []
    for r in cells.orderBy("gid").toLocalIterator():
        shapes.append(" ".join(str(at[r[s]]) for s in mesh.slots))
        data.append(str(r["own"]))
    width = mesh.topology.vertices
    kind = {4: "Tetrahedron", 8: "Hexahedron"}[width]
    item = lambda body, dims, number="Int": f'<DataItem Format="XML" NumberType="{number}" Dimensions="{dims}">\n{body}\n</DataItem>'
    nl = "\n"
    Path(path).write_text(
        f"""<?xml version="1.0"?>
<Xdmf Version="3.0"><Domain><Grid Name="mesh" GridType="Uniform">
<Topology TopologyType="{kind}" NumberOfElements="{len(shapes)}">{item(nl.join(shapes), f"{len(shapes)} {width}")}</Topology>
<Geometry GeometryType="XYZ">{item(nl.join(points), f"{len(points)} 3", "Float")}</Geometry>
<Attribute Name="{name}" AttributeType="Scalar" Center="Cell">{item(nl.join(data), str(len(data)))}</Attribute>
</Grid></Domain></Xdmf>
"""
    )


def write_report(report: DataFrame, path: str) -> None:
    """A report's JSON rows as text files."""
    report.select("value").write.text(path)


def in_order(rows: DataFrame, part: str, key: str, parts: int) -> DataFrame:
    """``rows`` sorted by part and then by an id that is unique within it, with ``line``: a counter that runs on from part to part."""
    top = rows.agg(F.max(key)).first()[0]
    return ids_by_part(rows, part, key, "line", (top or 0) + 1, parts).orderBy("line")
