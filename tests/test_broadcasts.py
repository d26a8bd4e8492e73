"""No join of the mesh's tables is broadcast through the driver unless a hint asks for it."""

import pytest
from pyspark.sql import functions as F

from meshloom.operators import placed, stats
from meshloom.operators.graph import DualGraph
from meshloom.operators.tables import Tables
from meshloom.plans import mesh_queries
from meshloom.sources.lattice import table_mesh

LAZY = ("barycenter", "cell_attributes", "cell_vertex_join", "face_payload_ext_int", "face_by_vertices", "edge_faces", "face_side", "local_edge_payload", "merged_cells", "groups_in_order", "part_cut", "partition_report")


def unasked(df) -> int:
    """Joins that Spark broadcasts though no hint asks for it."""
    plan = df._jdf.queryExecution()
    return plan.executedPlan().toString().count("BroadcastHashJoin") - plan.optimizedPlan().toString().count("Hint=(strategy=broadcast)")


@pytest.mark.parametrize("name", LAZY)
def test_joins_of_the_mesh_are_not_broadcast(spark, sf_dir, name):
    assert unasked(mesh_queries.QUERIES[name](spark, sf_dir)) <= 0


def test_joins_with_a_partition_are_not_broadcast(spark, sf_dir):
    graph = DualGraph(table_mesh(spark, sf_dir, 4))
    found = graph.mesh.cells.select(F.col("gid").alias("cell"), (F.col("gid") % 3).cast("int").alias("part"))
    assert unasked(stats.cut_edges(graph, found)) <= 0 and unasked(stats.size_rows(graph, found)) <= 0
    assert unasked(stats.measured_together(graph, {"a": found, "b": found}, {"none": ("none", "none")}).groupBy().count()) <= 1  # rows for each part


def test_tables_in_between_are_broadcast_only_if_small(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("cell"), (F.col("id") % 3).alias("part"))
    with Tables(spark) as tables:
        assert unasked(tables.kept(rows).join(tables.kept(rows), "cell")) == 1
        monkeypatch.setattr("meshloom.operators.tables.SMALL", 10)
        assert unasked(tables.kept(rows).join(tables.kept(rows), "cell")) == 0


def test_joins_of_meshes_by_part_are_not_broadcast(spark, sf_dir, monkeypatch):
    seen, write = [], placed.bucketed
    monkeypatch.setattr(placed, "bucketed", lambda session, df, *rest: seen.append(unasked(df)) or write(session, df, *rest))
    by_part, values = mesh_queries.placed_groups(table_mesh(spark, sf_dir, 4))
    seen.append(unasked(by_part.for_each_face(values, values)))
    by_part.drop()
    assert len(seen) == 5 and max(seen) <= 0
