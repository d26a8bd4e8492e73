"""Sources and sinks."""

import sys
import types

import numpy as np
import pytest

from meshloom.functions.types import spark_type
from meshloom.operators.graph import DualGraph
from meshloom.operators.stats import report
from meshloom.sources import mesh_io
from meshloom.sources.lattice import lattice


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, kind):
    mesh = lattice(spark, 1)
    mesh_io.write_mesh(mesh, str(tmp_path / "m"), kind)
    back = mesh_io.read_mesh(spark, str(tmp_path / "m/cells"), str(tmp_path / "m/vertices"), kind)
    assert sorted(map(tuple, back.faces.select("gid", "k0", "k1", "k2").collect())) == sorted(map(tuple, mesh.faces.select("gid", "k0", "k1", "k2").collect()))


def test_negative_id_is_an_error(spark, tmp_path):
    spark.createDataFrame([(0, -1, 1, 2, 3)], "orig_gid long, v0 long, v1 long, v2 long, v3 long").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "vid long, x double, y double, z double").write.parquet(str(tmp_path / "v"))
    with pytest.raises(Exception, match="isn't an id"):
        mesh_io.read_mesh(spark, str(tmp_path / "c"), str(tmp_path / "v")).cells.collect()


def test_xdmf_and_report(spark, tmp_path):
    mesh = lattice(spark, 1)
    mesh_io.write_xdmf(mesh, str(tmp_path / "m.xdmf"))
    text = (tmp_path / "m.xdmf").read_text()
    assert 'NumberOfElements="6"' in text and 'Dimensions="8 3"' in text
    rows = report(DualGraph(mesh), mesh.cells.selectExpr("gid as cell", "part"), 1, {"a": 1})
    mesh_io.write_report(rows, str(tmp_path / "r"))
    assert '"total_vertices":6' in spark.read.text(str(tmp_path / "r")).first()[0]


def test_names_and_types():
    assert mesh_io.split_name("a.h5:/connect") == ("a.h5", "/connect")
    with pytest.raises(ValueError):
        mesh_io.split_name("a.h5")
    assert spark_type("unsigned").typeName() == "long" and spark_type("double").typeName() == "double" and spark_type("struct").typeName() == "binary"


def test_hdf5_reader(monkeypatch):
    data = {"/connect": np.arange(12).reshape(3, 4)}

    class File(dict):
        def __init__(self, name, mode):
            super().__init__(data)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    monkeypatch.setattr(mesh_io, "SLICE_ROWS", 1)

    def read(**options):
        source = mesh_io.MeshHdf5({"name": "m.h5:/connect", **options})
        reader = source.reader(source.schema())
        return [tuple(r.values()) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]

    assert read(kind="cells", blocks="2", width="4") == [(0, 0, 1, 2, 3), (1, 4, 5, 6, 7), (2, 8, 9, 10, 11)]
    assert read(kind="attribute", sizes="4", element="int") == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9, 10, 11])]
    with pytest.raises(ValueError, match="shape"):
        read(kind="vertices", blocks="2")
    monkeypatch.setattr(mesh_io, "BLOCK_ROWS", 1)
    source = mesh_io.MeshHdf5({"name": "m.h5:/connect", "kind": "cells", "blocks": "1"})
    assert len(source.reader(source.schema()).partitions()) == 3


def test_hdf5_without_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ImportError, match="h5py"):
        mesh_io.MeshHdf5({"name": "m.h5:/connect", "kind": "cells"}).reader(None).partitions()


def test_in_order(spark):
    rows = spark.createDataFrame([(p, 10 * k) for p in (2, 0, 1) for k in range(5)], "part int, k long").repartition(3)
    got = [tuple(r) for r in mesh_io.in_order(rows, "part", "k", 3).select("line", "part", "k").collect()]
    assert got == [(5 * p + k, p, 10 * k) for p in range(3) for k in range(5)]
