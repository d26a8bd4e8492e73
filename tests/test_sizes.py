"""What must hold on large graphs: rooms used by single cells, bounded graphs on the driver, more partitions for more rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from meshloom.operators import coarse, multilevel, partitioners, stats
from meshloom.operators.graph import DualGraph
from meshloom.operators.multilevel import Effort, Level, limits
from meshloom.operators.tables import Tables
from meshloom.sources.lattice import lattice


def chain(spark, tables: Tables, n: int) -> Level:
    edges = spark.range(n - 1).select(F.explode(F.array(F.struct(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), F.struct((F.col("id") + 1).alias("src"), F.col("id").alias("dst")))).alias("e")).select("e.*", F.lit(1).cast("long").alias("w"))
    return multilevel.graph_level(spark.range(n).select(F.col("id").alias("cell"), F.lit(1).cast("long").alias("w0")), edges, 1, tables)


def test_a_lot_that_is_too_large_moves_cell_by_cell(spark):
    """As on large meshes, where even one lot holds more cells than the room."""
    with Tables(spark) as tables:
        level = chain(spark, tables, 300)
        assigned = level.nodes.select("cell", F.lit(0).alias("part"))
        asks = level.nodes.select("cell", F.lit(0).alias("from"), F.lit(1).alias("to"), F.when(F.col("cell") < 100, 0).otherwise(1).alias("lot"), "w0")
        for room, want in ((37, 37), (140, 140), (100, 100), (500, 300), (0, 0)):
            found, change = multilevel.moved(level, assigned, asks, ["to"], multilevel.room_table(level, [(1, room)], ["to"]), 2)
            assert change.tolist() == [[-want], [want]] and found.where("part = 1").count() == want
            assert found.where("part = 1 and cell < 100").count() == min(want, 100)


def test_sizes_are_met_by_large_lots(spark, monkeypatch):
    """With one lot for each class the sizes are still met to one cell, also where parts don't touch."""
    monkeypatch.setattr(multilevel, "CLASS_LOTS", 1)
    monkeypatch.setattr(multilevel, "CLASSES", 2)
    graph = DualGraph(lattice(spark, 4))
    skewed = graph.mesh.cells.select(F.col("gid").alias("cell"), F.when(F.col("gid") < 300, 0).otherwise(F.col("gid") % 4).cast("int").alias("part"))
    found = partitioners.rebalanced(graph, skewed, partitioners.Target(4, (0.4, 0.3, 0.2, 0.1)))
    sizes = [r["size"] for r in stats.part_sizes(graph, found, 4).orderBy("part").collect()]
    assert sum(sizes) == 384 and all(s <= 384 * share + 1 for s, share in zip(sizes, (0.4, 0.3, 0.2, 0.1), strict=True))


def test_the_driver_gets_few_edges(spark, monkeypatch):
    """A dense graph of few nodes is contracted until its edges are few, too."""
    seen = []
    monkeypatch.setattr(multilevel, "COARSEST_EDGES", 2000)
    monkeypatch.setattr(coarse, "partitioned", lambda graph, shares, caps, *rest, own=coarse.partitioned: seen.append(len(graph.to)) or own(graph, shares, caps, *rest))
    draw = random.Random(3)
    pairs = {tuple(sorted(draw.sample(range(300), 2))) for _ in range(9000)}
    edges = spark.createDataFrame([(x, y, 1) for a, b in pairs for x, y in ((a, b), (b, a))], "src long, dst long, w long")
    nodes = spark.range(300).select(F.col("id").alias("cell"), F.lit(1).cast("long").alias("w0"))
    found = partitioners.any_graph(nodes, edges, partitioners.Target(3, imbalance=0.05), Effort(rounds=1, tries=1)).toPandas()
    assert len(found) == 300 and found["part"].value_counts().max() <= 106 and seen == [n for n in seen if n <= 2000]


def test_shuffles_of_more_rows_have_more_partitions(spark, monkeypatch):
    monkeypatch.setattr("meshloom.operators.tables.ROWS", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with Tables(spark) as tables:
        level = chain(spark, tables, 501)
        assert level.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions") == "20" and spark.conf.get("spark.sql.shuffle.partitions") == before
        assert np.array(multilevel.sizes_of(level, level.nodes.select("cell", F.lit(0).alias("part")), 1)).tolist() == [[501]]
        assert limits(level, (1.0,), 0.0).caps.tolist() == [[501]]
    graph = DualGraph(lattice(spark, 3))
    found = partitioners.partition("parhip-ultrafast", graph, partitioners.Target(3, imbalance=0.05))
    assert found.sparkSession is spark or found.sparkSession.conf.get("spark.sql.shuffle.partitions") == before
    assert stats.part_sizes(graph, found, 3).agg(F.sum("size")).first()[0] == 162


def test_a_round_of_balance_joins_the_edges_once(spark, monkeypatch):
    """Flows and moves of a round come from the same sums by cell and pair of parts."""
    seen, beside = [], Level.beside
    monkeypatch.setattr(Level, "beside", lambda level, *rest, **names: seen.append(1) or beside(level, *rest, **names))
    graph, told = DualGraph(lattice(spark, 4)), []
    skewed = graph.mesh.cells.select(F.col("gid").alias("cell"), F.when(F.col("gid") < 250, 0).otherwise(1).cast("int").alias("part"))
    found = partitioners.rebalanced(graph, skewed, partitioners.Target(2), told=told)
    assert told and len(seen) == 2 * len(told)
    assert max(r["size"] for r in stats.part_sizes(graph, found, 2).collect()) <= 193


def test_cuts_without_edge_weights_need_no_ids(spark):
    """Edges that all weigh 1 are counted without numbering faces and edges; the cut is the same as with ids."""
    graph = DualGraph(lattice(spark, 3))
    found = graph.mesh.cells.select(F.col("gid").alias("cell"), (F.col("gid") % 5).cast("int").alias("part"))
    plain = stats.cut_edges(graph, found)
    numbered = stats.cut_edges(graph.with_edge_weights(F.lit(1)), found)
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window")
    assert windows(plain) < windows(numbered)
    rows = lambda df: sorted(tuple(r) for r in df.groupBy("part", "nbr_part").agg(F.count("*"), F.sum("w")).collect())
    assert rows(plain) == rows(numbered) and len(rows(plain)) > 1
