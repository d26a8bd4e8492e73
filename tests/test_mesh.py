"""Golden tables of two tetrahedra, invariants of lattices, and parts that must not change what isn't theirs."""

import json

import pytest
from pyspark.sql import functions as F

from meshloom.functions.distribute import Blocks
from meshloom.functions.numbering import dense_ids, running_sum
from meshloom.functions.topology import HEXAHEDRON, TETRAHEDRON
from meshloom.operators import partitioners, stats
from meshloom.operators.graph import DualGraph
from meshloom.operators.mesh import CELL, VERTEX, Mesh
from meshloom.sources.lattice import lattice, scrambled


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def grouped(df, key, value):
    out = {}
    for k, v in rows(df, key, value):
        out.setdefault(k, []).append(v)
    return out


@pytest.fixture(scope="module")
def pair(spark):
    cells = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 3, 4)], "orig_gid long, v0 long, v1 long, v2 long, v3 long")
    points = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(6)], "vid long, x double, y double, z double")
    return Mesh(cells, points)


def test_two_tetrahedra(pair):
    assert rows(pair.faces, "gid", "k0", "k1", "k2", "cell0", "cell1") == [(0, 0, 1, 2, 0, None), (1, 0, 1, 3, 0, None), (2, 1, 2, 3, 0, 1), (3, 0, 2, 3, 0, None), (4, 1, 2, 4, 1, None), (5, 2, 3, 4, 1, None), (6, 1, 3, 4, 1, None)]
    assert rows(pair.edges, "gid", "k0", "k1") == [(0, 0, 1), (1, 1, 2), (2, 0, 2), (3, 0, 3), (4, 1, 3), (5, 2, 3), (6, 1, 4), (7, 2, 4), (8, 3, 4)]
    assert grouped(pair.edge_faces, "edge", "face") == {0: [0, 1], 1: [0, 2, 4], 2: [0, 3], 3: [1, 3], 4: [1, 2, 6], 5: [2, 3, 5], 6: [4, 6], 7: [4, 5], 8: [5, 6]}
    assert grouped(pair.edge_cells(), "edge", "cell") == {0: [0], 1: [0, 1], 2: [0], 3: [0], 4: [0, 1], 5: [0, 1], 6: [1], 7: [1], 8: [1]}
    assert grouped(pair.vertex_edges, "vertex", "edge") == {0: [0, 2, 3], 1: [0, 1, 4, 6], 2: [1, 2, 5, 7], 3: [3, 4, 5, 8], 4: [6, 7, 8]}
    assert [f for *_, f in rows(pair.cell_faces, "cell", "slot", "face")] == [0, 1, 2, 3, 2, 4, 5, 6]
    assert [n for *_, n in rows(pair.neighbors(), "cell", "slot", "neighbor")] == [-1, -1, 1, -1, 0, -1, -1, -1]
    assert grouped(pair.vertex_cells(), "vertex", "cell") == {0: [0], 1: [0, 1], 2: [0, 1], 3: [0, 1], 4: [1]}
    assert grouped(pair.vertex_faces(), "vertex", "face") == {0: [0, 1, 3], 1: [0, 1, 2, 4, 6], 2: [0, 2, 3, 4, 5], 3: [1, 2, 3, 5, 6], 4: [4, 5, 6]}
    assert [r[0] for r in rows(pair.vertices, "vid")] == [0, 1, 2, 3, 4]  # vertex 5 is used by no cell


@pytest.mark.parametrize(("n", "parts", "shared_faces", "shared_edges", "sizes", "cut"), [(1, 2, 4, 9, [3, 3], [4, 4]), (2, 3, 56, 80, [17, 15, 16], [37, 41, 34])])
def test_lattice(spark, n, parts, shared_faces, shared_edges, sizes, cut):
    mesh = lattice(spark, n).partition_by(scrambled(parts), parts)
    faces, edges = mesh.faces.collect(), mesh.edges.collect()
    assert (len(faces), len(edges), mesh.total_cells()) == (12 * n**3 + 6 * n**2, 7 * n**3 + 9 * n**2 + 3 * n, 6 * n**3)
    assert (n + 1) ** 3 - len(edges) + len(faces) - 6 * n**3 == 1
    assert sorted(f["gid"] for f in faces) == list(range(len(faces)))
    assert all(f["owner"] == min(f["parts"]) for f in faces)
    assert sum(len(f["parts"]) > 1 for f in faces) == shared_faces and sum(len(e["parts"]) > 1 for e in edges) == shared_edges
    graph = DualGraph(mesh)
    partition = mesh.cells.select(F.col("gid").alias("cell"), "part")
    assert [r[1] for r in rows(stats.part_sizes(graph, partition, parts), "part", "size")] == sizes
    assert [r[1] for r in rows(stats.part_cut(graph, partition, parts), "part", "cut")] == cut
    found = stats.summary(graph, partition, parts).first()
    assert found["cut"] == sum(cut) // 2 and found["imbalance"] == pytest.approx(max(sizes) / (sum(sizes) / parts))
    directed = graph.edges.collect()
    assert sorted(e["eid"] for e in directed) == list(range(len(directed))) and {(e["src"], e["dst"]) for e in directed} == {(e["dst"], e["src"]) for e in directed}


def test_hexahedra(spark):
    cells = spark.createDataFrame([(0, *range(8)), (1, 1, 8, 3, 9, 5, 10, 7, 11)], "orig_gid long, " + ", ".join(f"v{i} long" for i in range(8)))
    points = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(12)], "vid long, x double, y double, z double")
    mesh = Mesh(cells, points, HEXAHEDRON)
    assert mesh.faces.count() == 11 and mesh.faces.where("cell1 is not null").count() == 1 and mesh.edges.count() == 20
    assert TETRAHEDRON.edge_faces == ((0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (2, 3))
    assert all(len(f) == 2 for f in HEXAHEDRON.edge_faces)


def test_three_cells_on_a_face_are_an_error(spark):
    cells = spark.createDataFrame([(i, 0, 1, 2, 3 + i) for i in range(3)], "orig_gid long, v0 long, v1 long, v2 long, v3 long")
    points = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(6)], "vid long, x double, y double, z double")
    with pytest.raises(Exception, match="more than two cells"):
        Mesh(cells, points).faces.collect()


def test_wrong_input(pair, spark):
    with pytest.raises(ValueError, match="lacks"):
        Mesh(pair.raw_cells.drop("v3"), pair.raw_vertices)
    with pytest.raises(ValueError, match="dimensions"):
        pair.add_data(spark.createDataFrame([(0, 1)], "orig_gid long, value int"), CELL, (3,))
    with pytest.raises(Exception, match="no part in range"):
        pair.partition(spark.createDataFrame([(0, 0), (1, 7)], "orig_gid long, part int"), 2).cells.collect()


def test_attributes_follow_cells(pair, spark):
    values = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "orig_gid long, value array<double>")
    mesh = pair.add_data(values, CELL, (2,)).add_data(spark.createDataFrame([(i, i * 10) for i in range(6)], "vid long, value int"), VERTEX)
    moved = mesh.partition(spark.createDataFrame([(0, 1), (1, 0)], "orig_gid long, part int"), 2)
    assert rows(moved.cell_data(0), "gid", "orig_gid", "value") == [(0, 1, [3.0, 4.0]), (1, 0, [1.0, 2.0])]
    assert rows(moved.vertex_data(0), "vid", "value") == [(i, i * 10) for i in range(5)]
    assert rows(moved.neighbors(local=True), "neighbor") == [(-1,)] * 8
    assert rows(moved.local_vertices(), "part", "vid", "lid", "shared")[:2] == [(0, 1, 0, [1]), (0, 2, 1, [1])]


def test_parts_leave_the_rest_alone(spark):
    mesh = lattice(spark, 2)
    key = lambda m: sorted((tuple(r["k"]), r["n"]) for r in m.faces.select(F.array("k0", "k1", "k2").alias("k"), (F.col("cell1").isNotNull()).alias("n")).collect())
    assert key(mesh) == key(mesh.partition_by(scrambled(5), 5))


@pytest.mark.parametrize(("entities", "parts"), [(10, 3), (3, 10), (7, 7), (0, 2), (1, 1)])
def test_blocks(spark, entities, parts):
    blocks = Blocks(entities, parts)
    ends = [blocks.offset_and_size(p) for p in range(parts)]
    assert sum(n for _, n in ends) == entities and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert rows(blocks.table(spark), "part", "offset", "size") == [(p, *e) for p, e in enumerate(ends)]
    by_column = rows(spark.range(entities).select("id", blocks.part_column(F.col("id")).alias("p")), "id", "p")
    assert by_column == [(i, blocks.part_of(i)) for i in range(entities)]
    assert all(blocks.local_id(p, i) == i - ends[p][0] for i, p in by_column)


def test_numbers(spark):
    df = spark.range(0, 1000, 7).withColumn("v", F.col("id") % 5)
    assert rows(dense_ids(df, "id", "n", 1000, 6), "id", "n") == [(i * 7, i) for i in range(143)]
    total, want = 0, []
    for i in range(0, 1000, 7):
        want.append((i, total))
        total += i % 5
    assert rows(running_sum(df, "id", F.col("v"), "s", 1000, 6), "id", "s") == want


@pytest.mark.parametrize("name", ["block", "parmetis-geo", "ptscotch-sb"])
def test_partitioners(spark, name):
    graph = DualGraph(lattice(spark, 3))
    target = partitioners.Target(5, (0.4, 0.3, 0.1, 0.1, 0.1) if name != "block" else (), 0.05)
    found = partitioners.partition(name, graph, target, seed=3)
    parts = rows(found, "cell", "part")
    assert [c for c, _ in parts] == list(range(162)) and {p for _, p in parts} <= set(range(5))
    sizes = [sum(p == k for _, p in parts) for k in range(5)]
    assert all(n <= 162 * s * 1.05 + 1 for n, s in zip(sizes, target.shares, strict=True))
    assert parts == rows(partitioners.partition(name, graph, target, seed=3), "cell", "part")


def test_graded_meshes_fill_the_curve_evenly(spark):
    """Runs along the curve hold when nearly all cells lie in a small corner."""
    mesh = lattice(spark, 4)
    small = mesh.raw_vertices.select("vid", *[F.when((F.col(a) <= 3), F.col(a) * 1e-4).otherwise(1.0).alias(a) for a in "xyz"])
    graph = DualGraph(Mesh(mesh.raw_cells, small))
    sizes = [r["size"] for r in stats.part_sizes(graph, partitioners.partition("parmetis-geo", graph, partitioners.Target(6)), 6).collect()]
    assert max(sizes) - min(sizes) <= 2


def test_several_weights(spark):
    mesh = lattice(spark, 2)
    weights = mesh.cells.select(F.col("gid").alias("cell"), F.array(F.lit(1), F.when(F.col("gid") < 8, 100).otherwise(1)).alias("w"))
    graph = DualGraph(mesh).with_vertex_weights(weights)
    assert graph.constraints() == 2
    assert rows(graph.weighted_cells().where("cell in (7, 8)"), "cell", "w0", "w1") == [(7, 1, 100), (8, 1, 1)]
    with pytest.raises(partitioners.PartitionError, match="one weight"):
        partitioners.partition("parmetis-geo", graph, partitioners.Target(2))


def test_ids_with_gaps(spark):
    """A filtered file: ids count by part and then by the file's own ids."""
    cells = spark.createDataFrame([(i, 0, 1, 2, 3 + k) for k, i in enumerate((0, 5, 10, 11))], "orig_gid long, v0 long, v1 long, v2 long, v3 long").withColumn("v0", F.col("orig_gid") + 100)
    points = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(8)], "vid long, x double, y double, z double")
    mesh = Mesh(cells, points).partition(spark.createDataFrame([(0, 1), (5, 0), (10, 0), (11, 1)], "orig_gid long, part int"), 2)
    assert rows(mesh.cells, "gid", "orig_gid", "part") == [(0, 5, 0), (1, 10, 0), (2, 0, 1), (3, 11, 1)]
    assert mesh.total_cells() == 4
    with pytest.raises(Exception, match="isn't in 0..3"):
        Mesh(cells, points, cell_count=4).cells.collect()


def test_cells_are_counted_once(spark):
    mesh = lattice(spark, 2)
    scans = []
    plain = Mesh(mesh.raw_cells, mesh.raw_vertices)
    assert plain.extent == (48, 48)
    scans.append(plain.partition_by(scrambled(3), 3).__dict__["extent"])
    assert scans == [(48, 48)]


def test_nested_attributes(spark):
    mesh = lattice(spark, 1)
    good = spark.createDataFrame([(i, [[1, 2, 3], [4, 5, 6]]) for i in range(6)], "orig_gid long, value array<array<int>>")
    assert mesh.add_data(good, CELL, (2, 3)).cell_data(0).count() == 6
    with pytest.raises(Exception, match="shape"):
        mesh.add_data(good, CELL, (2, 2)).cell_data(0).collect()


def test_harness(spark):
    mesh = lattice(spark, 2).partition_by(scrambled(3), 3)
    settings = stats.configurations(["nparts=3", "imbalance=0.1", 'partitioner=["none","parmetis-geo"]', 'vertex_weights=["none","random"]'])
    found = [(s, json.loads(r.first()["value"])) for s, r in stats.harness(DualGraph(mesh), settings)]
    assert len(found) == 4
    for setting, r in found:
        assert json.loads(r["configuration"]) == setting and r["mpi_size"] == 3 and r["total_vertices"] == 48 and r["time"] > 0 and r["memory"] > 0
        assert sum(p["size"] for p in r["rank_stats"]) == 48 and r["total_edges"] == DualGraph(mesh).edges.count()
        assert all(sum(d["w"] for d in p["cut_weighted_detail"]) == p["cut_weighted"] for p in r["rank_stats"])


def test_unknown_partitioner(spark):
    with pytest.raises(partitioners.PartitionError):
        partitioners.partition("best", DualGraph(lattice(spark, 1)), partitioners.Target(2))
    assert len([n for n in partitioners.PARTITIONERS if n != "block"]) == 15


def test_configurations(tmp_path):
    (tmp_path / "a.json").write_text('[{"p": "x"}, {"p": "y", "ew": "none"}]')
    found = stats.configurations(["nparts=10", "ew=[\"none\",\"random\"]", str(tmp_path / "a.json"), "seed=1"])
    assert len(found) == 4 and found[0] == {"nparts": 10, "ew": "none", "p": "x", "seed": 1} and {f["ew"] for f in found if f["p"] == "y"} == {"none"}
    assert stats.node_weights("harmonic", 2) == pytest.approx([2 / 3, 1 / 3]) and stats.node_weights("none", 3) == []
