"""Meshes that lie by part, handlers, and many partitions measured at once."""

import pytest
from pyspark.sql import functions as F

from meshloom.operators import stats
from meshloom.operators.graph import DualGraph
from meshloom.operators.placed import CellSums, Placed
from meshloom.sources.lattice import lattice, scrambled


@pytest.fixture(scope="module")
def mesh(spark):
    return lattice(spark, 3).partition_by(scrambled(5), 5)


@pytest.fixture(scope="module")
def placed(mesh):
    found = Placed.of(mesh, 3)
    yield found
    found.drop()
    assert not found.names


@pytest.fixture(scope="module")
def values(mesh, placed):
    return placed.place(mesh.cells.select("part", F.col("gid").alias("cell"), (F.col("gid") * 7 % 11).alias("value")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_faces_have_no_exchange(mesh, placed, values):
    columns = ["face", "cell", "part", "nbr_cell", "is_boundary", "ext_value", "int_value"]
    made = placed.for_each_face(values, values)
    own = mesh.cells.select(F.col("gid").alias("cell"), (F.col("gid") * 7 % 11).alias("value"))
    assert rows(made, *columns) == rows(mesh.for_each_face(own, own), *columns)
    summed = made.groupBy("part", "cell").agg(F.sum("ext_value").alias("total"))
    for df in (made, summed):
        assert "Join" in plan(df) and "Exchange" not in plan(df)
    assert rows(placed.for_each_face(values, boundary=False), "face", "cell", "ext_value") == rows(mesh.for_each_face(own, boundary=False), "face", "cell", "ext_value")


def test_ghosts_are_what_parts_touch(mesh, placed, values):
    want = {(r["part"], r["nbr_cell"]) for r in mesh.face_sides.where("nbr_part <> part").collect()}
    assert {(r["part"], r["cell"]) for r in values.where("is_ghost").collect()} == want
    assert values.where("not is_ghost").count() == 162


def test_handlers_equal_the_aggregate(spark, placed, values):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # cells come in several batches
    try:
        made = placed.fold_faces(placed.for_each_face(values), lambda part: CellSums(part, "ext_value"), "part int, cell long, total long, faces long")
        found = rows(made, "part", "cell", "total", "faces")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = placed.for_each_face(values).groupBy("part", "cell").agg(F.coalesce(F.sum("ext_value"), F.lit(0)).alias("total"), F.count("ext_value").alias("faces"))
    assert found == rows(want, "part", "cell", "total", "faces") and len(found) == 162


def test_steps_move_ghosts_only(mesh, placed, values):
    step = placed.for_each_face(values).groupBy("part", "cell").agg(F.coalesce(F.sum("ext_value"), F.lit(0)).alias("value"))
    after = placed.place(step, lies=True)
    second = placed.for_each_face(after, boundary=False).groupBy("cell").agg(F.sum("ext_value").alias("total"))
    own = mesh.cells.select(F.col("gid").alias("cell"), (F.col("gid") * 7 % 11).alias("value"))
    once = mesh.for_each_face(own).groupBy("cell").agg(F.coalesce(F.sum("ext_value"), F.lit(0)).alias("value"))
    assert rows(second, "cell", "total") == rows(mesh.for_each_face(once, boundary=False).groupBy("cell").agg(F.sum("ext_value").alias("total")), "cell", "total")


def test_many_partitions_at_once(spark, mesh):
    graph = DualGraph(mesh)
    cells = mesh.cells.select(F.col("gid").alias("cell"))
    found = {f"mod{n}": cells.select("cell", F.pmod(F.xxhash64("cell", F.lit(n)), F.lit(n)).cast("int").alias("part")) for n in (1, 3, 8)}
    kinds = {"plain": ("none", "none"), "drawn": ("random", "increasing")}
    made = rows(stats.measured_together(graph, found, kinds), "partition", "weighting", "part", "size", "size_weighted", "cut", "cut_weighted")
    want = []
    for weighting, (v, e) in kinds.items():
        weighted = graph if v == "none" else graph.with_vertex_weights(cells.select("cell", stats.weight_column(v, F.col("cell")).alias("w"))).with_edge_weights(stats.weight_column(e, F.col("eid")))
        for name, p in found.items():
            want += [(name, weighting, *r[1:]) for r in [(0, *x) for x in rows(stats.part_rows(weighted, p), "part", *stats.MEASURES)]]
    assert made == sorted(want, key=repr)


def test_random_weights_are_spread(spark):
    drawn = [r[0] for r in spark.range(20_000).select(stats.weight_column("random", F.col("id"))).collect()]
    assert min(drawn) >= 1 and max(drawn) <= 1000
    assert len(set(drawn)) > 990
    assert abs(sum(drawn) / len(drawn) - 500.5) < 15
