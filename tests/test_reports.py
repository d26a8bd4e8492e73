"""Reports of the harness are written one by one, so no plan holds those of several settings."""

import json

from meshloom.operators import stats
from meshloom.operators.graph import DualGraph
from meshloom.sources.lattice import table_mesh


def test_a_report_of_the_harness_is_a_table(spark, sf_dir):
    graph = DualGraph(table_mesh(spark, sf_dir, 4))
    ((_, made),) = stats.harness(graph, [{"partitioner": "block", "nparts": 3}])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert json.loads(made.first()["value"])["total_vertices"] == graph.mesh.total_cells()
