"""The registered mesh queries over the mesh made from the tables, and their SQL.

All run on the lattice of ``table_mesh`` in PARTS scrambled parts, in whole. The SQL builds the
same mesh from ``part`` in common table expressions and asks them in its own way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.distribute import Blocks
from meshloom.functions.topology import TETRAHEDRON
from meshloom.operators import partitioners, stats
from meshloom.operators.graph import DualGraph
from meshloom.operators.mesh import Mesh, merged
from meshloom.operators.placed import CellSums, Placed
from meshloom.operators.tables import Tables, delete, large, met, shared_folder
from meshloom.sources.lattice import table_mesh
from meshloom.sources.mesh_io import in_order, read_mesh, write_mesh

PARTS = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def slots_of(own: tuple[tuple[int, ...], ...]) -> str:
    """Rows (slot, vertex slots) for VALUES."""
    return ", ".join(str((k, *slots)) for k, slots in enumerate(own))


#: The mesh in SQL, from the rows of ``part``.
MESH_SQL = f"""
WITH side AS (SELECT CAST(max(i) AS BIGINT) AS n FROM range(1, 2000) t(i) WHERE i * i * i <= (SELECT count(*) FROM part)),
cube AS (SELECT p_partkey AS cube, n, p_size, p_partkey % n + ((p_partkey // n) % n) * (n + 1) + (p_partkey // (n * n)) * (n + 1) * (n + 1) AS b
         FROM part, side WHERE p_partkey < n * n * n),
walk(k, a1, a2) AS (VALUES (0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 2, 0), (5, 2, 1)),
step AS (SELECT cube, k, b, n, p_size, CASE a1 WHEN 0 THEN 1 WHEN 1 THEN n + 1 ELSE (n + 1) * (n + 1) END AS s1,
                CASE a2 WHEN 0 THEN 1 WHEN 1 THEN n + 1 ELSE (n + 1) * (n + 1) END AS s2 FROM cube, walk),
raw_cells AS (SELECT cube * 6 + k AS orig_gid, b AS v0, b + s1 AS v1, b + s1 + s2 AS v2, b + 1 + (n + 1) + (n + 1) * (n + 1) AS v3, p_size AS grp FROM step),
raw_vertices AS (SELECT i AS vid, CAST(i % (n + 1) AS DOUBLE) AS x, CAST((i // (n + 1)) % (n + 1) AS DOUBLE) AS y, CAST(i // ((n + 1) * (n + 1)) AS DOUBLE) AS z
                 FROM (SELECT n, unnest(range(0, (n + 1) * (n + 1) * (n + 1))) AS i FROM side)),
placed AS (SELECT *, CAST((orig_gid * 7919 + orig_gid // 37) % {PARTS} AS INTEGER) AS part FROM raw_cells),
cells AS (SELECT row_number() OVER (ORDER BY part, orig_gid) - 1 AS gid, * FROM placed),
face_def(slot, i, j, k) AS (VALUES {slots_of(TETRAHEDRON.faces)}),
edge_def(slot, i, j) AS (VALUES {slots_of(TETRAHEDRON.edges)}),
corner AS (SELECT gid, part, 0 AS i, v0 AS v FROM cells UNION ALL SELECT gid, part, 1, v1 FROM cells UNION ALL SELECT gid, part, 2, v2 FROM cells UNION ALL SELECT gid, part, 3, v3 FROM cells),
face_slots AS (SELECT a.gid AS cell, a.part, f.slot, a.v AS a, b.v AS b, c.v AS c, least(a.v, b.v, c.v) AS k0, a.v + b.v + c.v - least(a.v, b.v, c.v) - greatest(a.v, b.v, c.v) AS k1, greatest(a.v, b.v, c.v) AS k2
               FROM face_def f JOIN corner a ON a.i = f.i JOIN corner b ON b.i = f.j AND b.gid = a.gid JOIN corner c ON c.i = f.k AND c.gid = a.gid),
edge_slots AS (SELECT a.gid AS cell, a.part, e.slot, least(a.v, b.v) AS k0, greatest(a.v, b.v) AS k1 FROM edge_def e JOIN corner a ON a.i = e.i JOIN corner b ON b.i = e.j AND b.gid = a.gid),
faces AS (SELECT row_number() OVER (ORDER BY first_pos) - 1 AS gid, * FROM (
    SELECT k0, k1, k2, min(cell) AS cell0, CASE WHEN count(*) = 2 THEN max(cell) END AS cell1, min(part) AS owner, count(DISTINCT part) AS holders, min(cell * 4 + slot) AS first_pos FROM face_slots GROUP BY k0, k1, k2)),
edges AS (SELECT row_number() OVER (ORDER BY first_pos) - 1 AS gid, * FROM (
    SELECT k0, k1, min(part) AS owner, count(DISTINCT part) AS holders, min(cell * 6 + slot) AS first_pos FROM edge_slots GROUP BY k0, k1)),
cell_faces AS (SELECT s.cell, s.slot, f.gid AS face, s.part FROM face_slots s JOIN faces f ON s.k0 = f.k0 AND s.k1 = f.k1 AND s.k2 = f.k2),
cell_edges AS (SELECT s.cell, s.slot, e.gid AS edge, s.part FROM edge_slots s JOIN edges e ON s.k0 = e.k0 AND s.k1 = e.k1),
sides AS (SELECT a.face, a.slot, a.cell, a.part, b.cell AS nbr_cell, b.part AS nbr_part FROM cell_faces a LEFT JOIN cell_faces b ON a.face = b.face AND a.cell <> b.cell),
dual AS (SELECT row_number() OVER (ORDER BY cell, CASE WHEN part <> nbr_part THEN 1 ELSE 0 END, CASE WHEN part <> nbr_part THEN nbr_part END, face) - 1 AS eid, cell AS src, nbr_cell AS dst, face, part, nbr_part
         FROM sides WHERE nbr_cell IS NOT NULL),
degree AS (SELECT c.gid AS cell, c.part, count(d.eid) AS degree FROM cells c LEFT JOIN dual d ON d.src = c.gid GROUP BY c.gid, c.part)
"""


def query(sql: str | None = None) -> Callable:
    """Register a function of the mesh (and the tables' folder) under its name, with its SQL over the mesh."""

    def register(make: Callable[[Mesh, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(table_mesh(spark, sf_dir, PARTS), sf_dir)

        run.__name__ = make.__name__
        run.__doc__ = make.__doc__
        QUERIES[make.__name__] = run
        if sql is not None:
            ORACLES[make.__name__] = MESH_SQL + sql
        return make

    return register


def listed(c: str) -> F.Column:
    """A list of ids as text: lists are compared as values of one column."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# -- distribution ---------------------------------------------------------------


@query("SELECT n % 7 AS rest, p.part, p.part * (n // 7) + least(p.part, n % 7) AS \"offset\", n // 7 + CASE WHEN p.part < n % 7 THEN 1 ELSE 0 END AS size FROM (SELECT count(*) AS n FROM raw_cells), (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS part) p")
def block_distribution(mesh: Mesh, sf_dir: str) -> DataFrame:
    blocks = Blocks(mesh.total_cells(), 7)
    return blocks.table(mesh.raw_cells.sparkSession).select(F.lit(blocks.entities % 7).cast("long").alias("rest"), "part", "offset", "size")


@query(
    "SELECT orig_gid, part, orig_gid - (part * (n // 7) + least(part, n % 7)) AS local FROM (SELECT orig_gid, n, CAST(CASE WHEN orig_gid < (n % 7) * (n // 7 + 1) THEN orig_gid // (n // 7 + 1) ELSE (orig_gid - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS INTEGER) AS part "
    "FROM raw_cells, (SELECT count(*) AS n FROM raw_cells))"
)
def block_of_cell(mesh: Mesh, sf_dir: str) -> DataFrame:
    blocks = Blocks(mesh.total_cells(), 7)
    rows = mesh.raw_cells.select("orig_gid", blocks.part_column(F.col("orig_gid")).alias("part"))
    return rows.select("orig_gid", "part", (F.col("orig_gid") - blocks.offset_column(F.col("part"))).alias("local"))


@query("SELECT part, count(*) AS cells, CAST(sum(orig_gid) AS BIGINT) AS ids, CAST(sum(grp) AS BIGINT) AS grps FROM placed GROUP BY part")
def redistribute_cells(mesh: Mesh, sf_dir: str) -> DataFrame:
    rows = mesh.distributed.join(mesh.original_cell_data(0), "orig_gid")
    return rows.groupBy("part").agg(F.count("*").alias("cells"), F.sum("orig_gid").alias("ids"), F.sum("value").alias("grps"))


@query("SELECT gid, orig_gid, part, v0, v1, v2, v3 FROM cells")
def cell_gid(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.cells


@query("SELECT c.gid, c.orig_gid, c.grp AS \"group\", o.o_totalprice AS price FROM cells c JOIN orders o ON o.o_orderkey = c.orig_gid")
def cell_attributes(mesh: Mesh, sf_dir: str) -> DataFrame:
    group, price = mesh.cell_data(0).withColumnRenamed("value", "group"), mesh.cell_data(1).select("gid", F.col("value").alias("price"))
    return large(group).join(price, "gid").select("gid", "orig_gid", "group", "price")


@query("SELECT v.vid, e.value FROM raw_vertices v JOIN events e ON e.event_id = v.vid WHERE v.vid IN (SELECT v FROM corner)")
def vertex_attributes(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.vertex_data(0)


# -- entities -------------------------------------------------------------------


@query("SELECT part, v AS vid FROM corner GROUP BY part, v")
def required_vertices(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.required_vertices


@query("SELECT c.gid AS cell, c.i AS slot, c.v AS vid, r.x, r.y, r.z FROM corner c JOIN raw_vertices r ON r.vid = c.v")
def cell_vertex_join(mesh: Mesh, sf_dir: str) -> DataFrame:
    corners = mesh.cells.select(F.col("gid").alias("cell"), F.posexplode(F.array(*mesh.slots)).alias("slot", "vid"))
    return corners.join(mesh.raw_vertices, "vid").select("cell", "slot", "vid", "x", "y", "z")


@query("SELECT vid, min(part) AS owner, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS parts FROM (SELECT DISTINCT v AS vid, part FROM corner) GROUP BY vid")
def vertex_shared_ranks(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.vertices.select("vid", "owner", listed("parts").alias("parts"))


@query(
    "SELECT p.part, p.vid, row_number() OVER (PARTITION BY p.part ORDER BY p.vid) - 1 AS lid, coalesce(string_agg(CAST(q.part AS VARCHAR), ',' ORDER BY q.part), '') AS shared "
    "FROM (SELECT DISTINCT part, v AS vid FROM corner) p LEFT JOIN (SELECT DISTINCT part, v AS vid FROM corner) q ON p.vid = q.vid AND p.part <> q.part GROUP BY p.part, p.vid"
)
def local_vertices(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.local_vertices().select("part", "vid", "lid", listed("shared").alias("shared"))


@query("SELECT gid, k0, k1, k2, cell0, cell1, owner FROM faces")
def faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.faces.select("gid", "k0", "k1", "k2", "cell0", "cell1", "owner")


@query("SELECT gid, k0, k1, owner FROM edges")
def edges(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.edges.select("gid", "k0", "k1", "owner")


@query("SELECT f.gid, f.owner, f.holders > 1 AS is_shared, string_agg(DISTINCT CAST(s.part AS VARCHAR), ',' ORDER BY CAST(s.part AS VARCHAR)) AS parts FROM faces f JOIN face_slots s ON s.k0 = f.k0 AND s.k1 = f.k1 AND s.k2 = f.k2 GROUP BY f.gid, f.owner, f.holders")
def face_gid_owner(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.faces.select("gid", "owner", (F.size("parts") > 1).alias("is_shared"), listed("parts").alias("parts"))


@query("SELECT e.gid, e.owner, e.holders > 1 AS is_shared, string_agg(DISTINCT CAST(s.part AS VARCHAR), ',' ORDER BY CAST(s.part AS VARCHAR)) AS parts FROM edges e JOIN edge_slots s ON s.k0 = e.k0 AND s.k1 = e.k1 GROUP BY e.gid, e.owner, e.holders")
def edge_gid_owner(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.edges.select("gid", "owner", (F.size("parts") > 1).alias("is_shared"), listed("parts").alias("parts"))


@query("SELECT owner AS part, count(*) AS owned, min(gid) AS first_gid, max(gid) AS last_gid FROM faces GROUP BY owner")
def face_ownership(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.faces.groupBy(F.col("owner").alias("part")).agg(F.count("*").alias("owned"), F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))


# -- incidence ------------------------------------------------------------------


@query("SELECT e.gid AS edge, f.gid AS face FROM (SELECT gid, k0 AS a, k1 AS b FROM faces UNION ALL SELECT gid, k0, k2 FROM faces UNION ALL SELECT gid, k1, k2 FROM faces) f JOIN edges e ON e.k0 = f.a AND e.k1 = f.b")
def edge_faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.edge_faces


@query("SELECT k0 AS vertex, gid AS edge FROM edges UNION ALL SELECT k1, gid FROM edges")
def vertex_edges(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.vertex_edges


@query("SELECT edge, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS cells FROM (SELECT DISTINCT edge, cell FROM cell_edges) GROUP BY edge")
def edge_cells(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.edge_cells().groupBy("edge").agg(F.sort_array(F.collect_list("cell")).alias("c")).select("edge", listed("c").alias("cells"))


@query("SELECT k0 AS vertex, gid AS face FROM faces UNION ALL SELECT k1, gid FROM faces UNION ALL SELECT k2, gid FROM faces")
def vertex_faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.vertex_faces()


@query("SELECT v AS vertex, gid AS cell FROM corner")
def vertex_cells(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.vertex_cells()


@query(
    "SELECT edge, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS cells FROM "
    "(SELECT DISTINCT e.gid AS edge, s.gid AS c FROM (SELECT gid, k0 AS k FROM edges UNION ALL SELECT gid, k1 FROM edges) e JOIN corner s ON s.v = e.k) GROUP BY edge"
)
def merged_cells(mesh: Mesh, sf_dir: str) -> DataFrame:
    """For each edge the sorted union of the cells of its two vertices."""
    of = mesh.vertex_cells().groupBy("vertex").agg(F.collect_set("cell").alias("cells"))
    a, b = of.select(F.col("vertex").alias("k0"), F.col("cells").alias("a")), of.select(F.col("vertex").alias("k1"), F.col("cells").alias("b"))
    both = large(mesh.edges.select(F.col("gid").alias("edge"), "k0", "k1").join(a, "k0")).join(b, "k1").select("edge", merged(F.col("a"), F.col("b")).alias("c"))
    return both.select("edge", F.size("c").cast("long").alias("n"), listed("c").alias("cells"))


@query("SELECT cell, slot, face FROM cell_faces")
def cell_faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.cell_faces.select("cell", "slot", "face")


@query("SELECT gid, v0, v1, v2, v3 FROM cells")
def cell_vertices(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.cells.select("gid", *mesh.slots)


@query("SELECT cell, slot, a, b, c FROM face_slots")
def face_vertices(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.face_vertices()


@query("SELECT q.cell, q.face, coalesce(c.slot, -1) AS side FROM (SELECT cell, face FROM cell_faces UNION SELECT cell, face + 1 FROM cell_faces) q LEFT JOIN cell_faces c ON c.cell = q.cell AND c.face = q.face")
def face_side(mesh: Mesh, sf_dir: str) -> DataFrame:
    own = mesh.cell_faces.select("cell", "face")
    return mesh.face_side(own.unionByName(own.select("cell", (F.col("face") + 1).alias("face"))).distinct())


@query("SELECT q.a, q.b, q.c, coalesce(f.gid, -1) AS face FROM (SELECT DISTINCT v3 AS a, v0 AS b, v1 AS c FROM cells UNION SELECT DISTINCT v3, v0, v1 + 1 FROM cells) q LEFT JOIN faces f ON f.k0 = least(q.a, q.b, q.c) AND f.k2 = greatest(q.a, q.b, q.c) AND f.k1 = q.a + q.b + q.c - least(q.a, q.b, q.c) - greatest(q.a, q.b, q.c)")
def face_by_vertices(mesh: Mesh, sf_dir: str) -> DataFrame:
    cells = mesh.cells
    keys = cells.select(F.col("v3").alias("a"), F.col("v0").alias("b"), F.col("v1").alias("c")).unionByName(cells.select(F.col("v3").alias("a"), F.col("v0").alias("b"), (F.col("v1") + 1).alias("c")))
    return mesh.face_by_vertices(keys.distinct())


@query("SELECT gid AS face, cell0, coalesce(cell1, -1) AS cell1 FROM faces")
def face_cells(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.face_cells()


@query("SELECT cell, slot, face, CASE WHEN part = nbr_part THEN nbr_cell ELSE -1 END AS neighbor FROM sides")
def neighbors_local(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.neighbors(local=True)


@query("SELECT cell, slot, face, coalesce(nbr_cell, -1) AS neighbor FROM sides")
def neighbors_global(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.neighbors()


@query("SELECT cell, count(nbr_cell) AS neighbors, count(*) - count(nbr_cell) AS boundary FROM sides GROUP BY cell")
def cell_neighbor_counts(mesh: Mesh, sf_dir: str) -> DataFrame:
    sides = mesh.face_sides
    return sides.groupBy("cell").agg(F.count("nbr_cell").alias("neighbors"), F.sum(F.col("is_boundary").cast("long")).alias("boundary"))


# -- both sides of faces --------------------------------------------------------


@query("SELECT s.face, s.cell, s.nbr_cell IS NULL AS is_boundary, a.grp AS int_value, b.grp AS ext_value FROM sides s JOIN cells a ON a.gid = s.cell LEFT JOIN cells b ON b.gid = s.nbr_cell")
def face_payload_sym(mesh: Mesh, sf_dir: str) -> DataFrame:
    values = mesh.cell_data(0).select(F.col("gid").alias("cell"), "value")
    return mesh.for_each_face(values, values).select("face", "cell", "is_boundary", "int_value", "ext_value")


@query("SELECT s.face, s.cell, a.grp AS int_grp, o.o_totalprice AS ext_price FROM sides s JOIN cells a ON a.gid = s.cell JOIN cells b ON b.gid = s.nbr_cell JOIN orders o ON o.o_orderkey = b.orig_gid")
def face_payload_ext_int(mesh: Mesh, sf_dir: str) -> DataFrame:
    external = mesh.cell_data(1).select(F.col("gid").alias("cell"), F.col("value").alias("price"))
    internal = mesh.cell_data(0).select(F.col("gid").alias("cell"), F.col("value").alias("grp"))
    return mesh.for_each_face(external, internal, boundary=False).select("face", "cell", "int_grp", "ext_price")


@query("SELECT s.cell, CAST(sum(b.grp) AS BIGINT) AS total, count(b.grp) AS faces FROM sides s LEFT JOIN cells b ON b.gid = s.nbr_cell GROUP BY s.cell")
def face_payload_ext(mesh: Mesh, sf_dir: str) -> DataFrame:
    external = mesh.cell_data(0).select(F.col("gid").alias("cell"), "value")
    return mesh.for_each_face(external).groupBy("cell").agg(F.sum("ext_value").alias("total"), F.count("ext_value").alias("faces"))


FACES_SQL = "SELECT s.part, s.cell, CAST(coalesce(sum(b.grp), 0) AS BIGINT) AS total, count(b.grp) AS faces FROM sides s LEFT JOIN cells b ON b.gid = s.nbr_cell GROUP BY s.part, s.cell"


def placed_groups(mesh: Mesh) -> tuple[Placed, DataFrame]:
    """The mesh by part with its ghosts, and the groups of cells placed on it."""
    placed = Placed.of(mesh)
    return placed, placed.place(mesh.cells.select("part", F.col("gid").alias("cell"), "orig_gid").join(mesh.original_cell_data(0), "orig_gid").select("part", "cell", "value"))


@query(FACES_SQL)
def placed_faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    """The groups of each cell's neighbours, summed in the buckets of its part."""
    placed, values = placed_groups(mesh)
    sums = placed.for_each_face(values).groupBy("part", "cell").agg(F.coalesce(F.sum("ext_value"), F.lit(0)).alias("total"), F.count("ext_value").alias("faces"))
    made = Tables(mesh.raw_cells.sparkSession).kept(sums, stay=True)
    placed.drop()
    return made


@query(FACES_SQL)
def part_handlers(mesh: Mesh, sf_dir: str) -> DataFrame:
    """The same sums by a handler in Python for each part."""
    placed, values = placed_groups(mesh)
    sums = placed.fold_faces(placed.for_each_face(values), lambda part: CellSums(part, "ext_value"), "part int, cell long, total long, faces long")
    made = Tables(mesh.raw_cells.sparkSession).kept(sums, stay=True)
    placed.drop()
    return made


@query("SELECT cell, CAST(sum(t) AS BIGINT) AS total FROM (SELECT s.cell, coalesce(c.total, 0) AS t FROM sides s LEFT JOIN (SELECT s.cell, sum(b.grp) AS total FROM sides s JOIN cells b ON b.gid = s.nbr_cell GROUP BY s.cell) c ON c.cell = s.nbr_cell) GROUP BY cell")
def placed_two_steps(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Two steps of an iteration on a mesh that lies by part: sums over neighbours of sums over neighbours."""
    placed, values = placed_groups(mesh)
    for _ in range(2):
        step = placed.for_each_face(values).groupBy("part", "cell").agg(F.coalesce(F.sum("ext_value"), F.lit(0)).alias("value"))
        values = placed.place(step, lies=True)
    made = Tables(mesh.raw_cells.sparkSession).kept(values.where("not is_ghost").select("cell", F.col("value").alias("total")), stay=True)
    placed.drop()
    return made


@query("SELECT orig_gid, v0, v1, v2, v3, x, y, z FROM raw_cells c JOIN raw_vertices v ON v.vid = c.v0")
def mesh_round_trip(mesh: Mesh, sf_dir: str) -> DataFrame:
    """The mesh written to files, read back, and joined with its vertices."""
    spark = mesh.raw_cells.sparkSession
    folder = f"{shared_folder(spark)}/mesh-files-{uuid.uuid4().hex}"
    write_mesh(mesh, folder)
    found = read_mesh(spark, f"{folder}/cells", f"{folder}/vertices")
    rows = large(found.raw_cells).join(found.raw_vertices, F.col("v0") == F.col("vid")).drop("vid")
    made = Tables(spark).kept(rows, stay=True)
    delete(spark, folder)
    return made


@query("SELECT row_number() OVER (ORDER BY part, gid) - 1 AS line, part, gid, grp AS \"group\" FROM cells")
def groups_in_order(mesh: Mesh, sf_dir: str) -> DataFrame:
    """The groups of all cells by part, with a number that runs through all parts."""
    return in_order(mesh.cells.join(mesh.original_cell_data(0), "orig_gid").select("part", "gid", F.col("value").alias("group")), "part", "gid", PARTS)


@query("SELECT face, cell FROM sides WHERE nbr_cell IS NULL")
def boundary_faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    return mesh.face_sides.where("is_boundary").select("face", "cell")


@query("SELECT part, nbr_part, count(*) AS faces FROM sides WHERE part <> nbr_part GROUP BY part, nbr_part")
def halo_faces(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Faces that each pair of parts shares, from each side."""
    return mesh.face_sides.where("part <> nbr_part").groupBy("part", "nbr_part").agg(F.count("*").alias("faces"))


# -- dual graph -----------------------------------------------------------------


@query("SELECT eid, src, dst, face FROM dual")
def dual_edges(mesh: Mesh, sf_dir: str) -> DataFrame:
    return DualGraph(mesh).edges.select("eid", "src", "dst", "face")


@query("SELECT cell, degree, CAST(coalesce(sum(degree) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM degree")
def csr_displacement(mesh: Mesh, sf_dir: str) -> DataFrame:
    return DualGraph(mesh).displacement()


@query("SELECT part, count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS edges, CAST(coalesce(sum(count(*)) OVER w, 0) AS BIGINT) AS first_vertex, CAST(coalesce(sum(sum(degree)) OVER w, 0) AS BIGINT) AS first_edge FROM degree GROUP BY part WINDOW w AS (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def rank_distribution(mesh: Mesh, sf_dir: str) -> DataFrame:
    return DualGraph(mesh).distribution()


@query("SELECT count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS edges FROM degree")
def graph_counts(mesh: Mesh, sf_dir: str) -> DataFrame:
    return DualGraph(mesh).counts()


@query("SELECT d.eid, d.src, d.dst, b.grp AS ext_value, a.grp AS int_value FROM dual d JOIN cells a ON a.gid = d.src JOIN cells b ON b.gid = d.dst")
def local_edge_payload(mesh: Mesh, sf_dir: str) -> DataFrame:
    values = mesh.cell_data(0).select(F.col("gid").alias("cell"), "value")
    return DualGraph(mesh).for_each_local_edge(values, values).select("eid", "src", "dst", "ext_value", "int_value")


@query("SELECT c.gid AS cell, (a.x + b.x + e.x + f.x) / 4 AS x, (a.y + b.y + e.y + f.y) / 4 AS y, (a.z + b.z + e.z + f.z) / 4 AS z FROM cells c JOIN raw_vertices a ON a.vid = c.v0 JOIN raw_vertices b ON b.vid = c.v1 JOIN raw_vertices e ON e.vid = c.v2 JOIN raw_vertices f ON f.vid = c.v3")
def barycenter(mesh: Mesh, sf_dir: str) -> DataFrame:
    return DualGraph(mesh).barycenters()


# -- partitions and their quality -----------------------------------------------


def weighted_graph(mesh: Mesh) -> DualGraph:
    """Cells weigh 1 + their group, edges their id + 1."""
    graph = DualGraph(mesh)
    graph = graph.with_vertex_weights(mesh.cell_data(0).select(F.col("gid").alias("cell"), (F.col("value") + 1).cast("long").alias("w")))
    return graph.with_edge_weights(stats.weight_column("increasing", F.col("eid")))


@query("SELECT part, count(*) AS size, CAST(sum(grp + 1) AS BIGINT) AS size_weighted FROM cells GROUP BY part")
def part_sizes(mesh: Mesh, sf_dir: str) -> DataFrame:
    return stats.part_sizes(weighted_graph(mesh), None, PARTS)


@query("SELECT nbr_part AS part, count(*) AS cut, CAST(sum(eid + 1) AS BIGINT) AS cut_weighted FROM dual WHERE part <> nbr_part GROUP BY nbr_part")
def part_cut(mesh: Mesh, sf_dir: str) -> DataFrame:
    return stats.part_cut(weighted_graph(mesh), None, PARTS)


@query("SELECT nbr_part, part, CAST(sum(eid + 1) AS BIGINT) AS cut_weighted_detail FROM dual WHERE part <> nbr_part GROUP BY nbr_part, part")
def cut_matrix(mesh: Mesh, sf_dir: str) -> DataFrame:
    return stats.cut_matrix(weighted_graph(mesh), None)


@query(
    f"SELECT total_vertices, cut, cut_weighted, imbalance, imbalance_weighted FROM "
    f"(SELECT CAST(sum(size) AS BIGINT) AS total_vertices, max(size) / (sum(size) / {PARTS}) AS imbalance, max(w) / (sum(w) / {PARTS}) AS imbalance_weighted FROM (SELECT part, count(*) AS size, sum(grp + 1) AS w FROM cells GROUP BY part)), "
    f"(SELECT CAST(count(*) // 2 AS BIGINT) AS cut, CAST(sum(eid + 1) // 2 AS BIGINT) AS cut_weighted FROM dual WHERE part <> nbr_part)"
)
def cut_summary(mesh: Mesh, sf_dir: str) -> DataFrame:
    return stats.summary(weighted_graph(mesh), None, PARTS)


REPORT = "struct<total_vertices:bigint,total_edges:bigint,mpi_size:bigint,cut:bigint,cut_weighted:bigint,imbalance:double,rank_stats:array<struct<part:int,size:bigint,size_weighted:bigint,cut:bigint,cut_weighted:bigint,cut_weighted_detail:array<struct<from:int,w:bigint>>>>>"


@query(
    f"SELECT r.total_vertices, r.total_edges, CAST({PARTS} AS BIGINT) AS mpi_size, r.cut, r.imbalance, s.part, s.size, s.size_weighted, c.part_cut, c.part_cut_weighted, d.detail FROM "
    f"(SELECT (SELECT count(*) FROM cells) AS total_vertices, count(*) AS total_edges, CAST(count(*) FILTER (part <> nbr_part) // 2 AS BIGINT) AS cut, (SELECT max(n) / (sum(n) / {PARTS}) FROM (SELECT count(*) AS n FROM cells GROUP BY part)) AS imbalance FROM dual) r, "
    "(SELECT part, count(*) AS size, CAST(sum(grp + 1) AS BIGINT) AS size_weighted FROM cells GROUP BY part) s "
    "JOIN (SELECT nbr_part AS part, count(*) AS part_cut, CAST(sum(eid + 1) AS BIGINT) AS part_cut_weighted FROM dual WHERE part <> nbr_part GROUP BY nbr_part) c ON c.part = s.part "
    "JOIN (SELECT nbr_part AS part, string_agg(part || ':' || w, ',' ORDER BY part) AS detail FROM (SELECT nbr_part, part, CAST(sum(eid + 1) AS BIGINT) AS w FROM dual WHERE part <> nbr_part GROUP BY nbr_part, part) GROUP BY nbr_part) d ON d.part = s.part"
)
def partition_report(mesh: Mesh, sf_dir: str) -> DataFrame:
    found = stats.report(weighted_graph(mesh), None, PARTS, {"partitioner": "none", "nparts": PARTS})
    rows = found.select(F.from_json("value", REPORT).alias("r")).select("r.*", F.explode("r.rank_stats").alias("s"))
    detail = F.array_join(F.transform("s.cut_weighted_detail", lambda x: F.concat_ws(":", x["from"], x["w"])), ",")
    return rows.select(
        "total_vertices", "total_edges", "mpi_size", "cut", "imbalance", "s.part", "s.size", "s.size_weighted",
        F.col("s.cut").alias("part_cut"), F.col("s.cut_weighted").alias("part_cut_weighted"), detail.alias("detail"),
    )


@query("SELECT gid AS cell, part FROM cells")
def partition_none(mesh: Mesh, sf_dir: str) -> DataFrame:
    return partitioners.partition("none", DualGraph(mesh), partitioners.Target(PARTS))


@query("SELECT gid AS cell, CAST(CASE WHEN gid < (n % 10) * (n // 10 + 1) THEN gid // (n // 10 + 1) ELSE (gid - (n % 10) * (n // 10 + 1)) // (n // 10) + n % 10 END AS INTEGER) AS part FROM cells, (SELECT count(*) AS n FROM cells)")
def partition_block(mesh: Mesh, sf_dir: str) -> DataFrame:
    return partitioners.partition("block", DualGraph(mesh), partitioners.Target(10))


TEN = partitioners.Target(10, imbalance=0.01)
#: Ends of ten equal shares as they add up.
ENDS = [sum([0.1] * k, 0.0) for k in range(1, 10)]
#: Morton curve through the barycenters: each axis spread to every third bit.
CURVE_SQL = f""",
corners AS (SELECT c.gid AS cell, c.grp + 1 AS w, (a.x + b.x + e.x + f.x) / 4 AS x, (a.y + b.y + e.y + f.y) / 4 AS y, (a.z + b.z + e.z + f.z) / 4 AS z
            FROM cells c JOIN raw_vertices a ON a.vid = c.v0 JOIN raw_vertices b ON b.vid = c.v1 JOIN raw_vertices e ON e.vid = c.v2 JOIN raw_vertices f ON f.vid = c.v3),
axes AS (SELECT cell, w, 0 AS axis, x AS v FROM corners UNION ALL SELECT cell, w, 1, y FROM corners UNION ALL SELECT cell, w, 2, z FROM corners),
s0 AS (SELECT cell, w, axis, CAST(trunc((v - min(v) OVER (PARTITION BY axis)) / (max(v) OVER (PARTITION BY axis) - min(v) OVER (PARTITION BY axis)) * 1048575) AS HUGEINT) AS v FROM axes),
s1 AS (SELECT cell, w, axis, (v | (v << 32)) & {0x1F00000000FFFF} AS v FROM s0),
s2 AS (SELECT cell, w, axis, (v | (v << 16)) & {0x1F0000FF0000FF} AS v FROM s1),
s3 AS (SELECT cell, w, axis, (v | (v << 8)) & {0x100F00F00F00F00F} AS v FROM s2),
s4 AS (SELECT cell, w, axis, (v | (v << 4)) & {0x10C30C30C30C30C3} AS v FROM s3),
s5 AS (SELECT cell, w, axis, (v | (v << 2)) & {0x1249249249249249} AS v FROM s4),
curve AS (SELECT cell, w, CAST(sum(v << axis) AS BIGINT) AS place FROM s5 GROUP BY cell, w),
walked AS (SELECT cell, w, coalesce(sum(w) OVER (ORDER BY place, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER () AS total FROM curve)
"""


@query(f"{CURVE_SQL} SELECT cell, CAST(len(list_filter({ENDS}, lambda e: e <= (before + w / 2) / total)) AS INTEGER) AS part FROM walked")
def partition_geometric(mesh: Mesh, sf_dir: str) -> DataFrame:
    return partitioners.partition("parmetis-geo", weighted_graph(mesh), TEN)


@query()
def partition_refined(mesh: Mesh, sf_dir: str) -> DataFrame:
    return partitioners.partition("ptscotch-sb", DualGraph(mesh), partitioners.Target(10, tuple(stats.node_weights("harmonic", 10)), 0.01))


@query("SELECT count(*) AS cells, count(*) AS placed, CAST(0 AS BIGINT) AS astray, CAST(0 AS BIGINT) AS oversized, TRUE AS better FROM cells")
def partition_refined_quality(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Every cell once, in a part of the target, no part above its size, and a smaller cut than without refinement."""
    graph = DualGraph(mesh)
    start, found = partitioners.partition("parmetis-geo", graph, TEN), partitioners.partition("parhip-ultrafast", graph, TEN)
    cells = graph.mesh.total_cells()
    sizes = found.groupBy("part").agg(F.count("*").alias("n"))
    once = found.agg(F.count("*").alias("cells"), F.count_distinct("cell").alias("placed"), F.sum((~F.col("part").between(0, 9)).cast("long")).alias("astray"))
    oversized = sizes.agg(F.sum((F.col("n") > cells / 10 * 1.01 + 1).cast("long")).alias("oversized"))
    before, after = (stats.cut_edges(graph, p).agg(F.count("*").alias(n)) for p, n in ((start, "b"), (found, "a")))
    one = lambda df: df.withColumn("k", F.lit(0))
    return one(once).join(one(oversized), "k").join(one(before), "k").join(one(after), "k").select("cells", "placed", "astray", "oversized", (F.col("a") < F.col("b")).alias("better"))


def within(found: DataFrame, weights: DataFrame, most: DataFrame, slack: int) -> DataFrame:
    """(part, most, fits): whether each part's weight is at most ``most`` and the weight of one cell."""
    sizes = large(found).join(weights.select("cell", F.col("w").alias("weight")), "cell").groupBy("part").agg(F.sum("weight").alias("size"))
    return most.join(sizes, "part", "left").select("part", "most", (F.coalesce("size", F.lit(0)) <= F.col("most") + slack).alias("fits"))


def equal_shares(mesh: Mesh, parts: int, total: int, imbalance: float) -> DataFrame:
    """(part, most) of equal shares, rounded down."""
    return mesh.raw_cells.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.floor(F.lit(float(total)) / parts * (1 + imbalance)).alias("most"))


HARMONIC = sum(1.0 / (i + 1) for i in range(10))


@query(f"SELECT CAST(p AS INTEGER) AS part, CAST(floor(n / (p + 1) / {HARMONIC!r}) AS BIGINT) AS most, TRUE AS fits FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells), range(10) t(p)")
def partition_refined_sizes(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Harmonic shares, kept to one cell (strict sizes), by bisections along the tree of shares."""
    graph = DualGraph(mesh)
    found = partitioners.partition("ptscotch-sb", graph, partitioners.Target(10, tuple(stats.node_weights("harmonic", 10)), 0.01))
    most = mesh.raw_cells.sparkSession.range(10).select(F.col("id").cast("int").alias("part"), F.floor(F.lit(float(mesh.total_cells())) / (F.col("id") + 1) / F.lit(HARMONIC)).alias("most"))
    return within(found, graph.weighted_vertices(), most, 1)


@query(
    "SELECT c AS \"constraint\", CAST(p AS INTEGER) AS part, CAST(floor(total / 8 * 1.03) AS BIGINT) AS most, TRUE AS fits FROM "
    "(SELECT 0 AS c, CAST(count(*) AS DOUBLE) AS total FROM cells UNION ALL SELECT 1, CAST(sum(grp + 1) AS DOUBLE) FROM cells), range(8) t(p)"
)
def partition_constraints(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Cells and their groups balanced at once."""
    graph = DualGraph(mesh)
    weights = mesh.cell_data(0).select(F.col("gid").alias("cell"), F.array(F.lit(1), F.col("value") + 1).cast("array<bigint>").alias("w"))
    found = partitioners.partition("parmetis", graph.with_vertex_weights(weights), partitioners.Target(8, imbalance=0.03))
    out = None
    for c in (0, 1):
        own = weights.select("cell", F.col("w")[c].alias("w"))
        row = own.agg(F.sum("w").alias("total"), F.max("w").alias("top")).first()
        rows = within(found, own, equal_shares(mesh, 8, row["total"], 0.03), row["top"]).select(F.lit(c).alias("constraint"), "part", "most", "fits")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CAST(p AS INTEGER) AS part, CAST(floor(n / 6 * 1.01) AS BIGINT) AS most, TRUE AS fits FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells), range(6) t(p)")
def partition_rebalanced(mesh: Mesh, sf_dir: str) -> DataFrame:
    """From half of the curve in one part to equal parts, by flows between parts that touch."""
    graph = DualGraph(mesh)
    start = partitioners.partition("parmetis-geo", graph, partitioners.Target(6, (0.5, 0.1, 0.1, 0.1, 0.1, 0.1)))
    return within(partitioners.rebalanced(graph, start, partitioners.Target(6, imbalance=0.01)), graph.weighted_vertices(), equal_shares(mesh, 6, mesh.total_cells(), 0.01), 1)


@query(f"{CURVE_SQL}, curved AS (SELECT cell, len(list_filter({ENDS}, lambda e: e <= (before + 0.5) / total)) AS part FROM (SELECT cell, row_number() OVER (ORDER BY place, cell) - 1 AS before, count(*) OVER () AS total FROM curve)) "
       "SELECT count(*) // 2 AS curve_cut, TRUE AS better FROM dual d JOIN curved a ON a.cell = d.src JOIN curved b ON b.cell = d.dst WHERE a.part <> b.part")  # fmt: skip
def partition_levels_cut(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Levels cut at least a tenth less than runs along the curve."""
    graph, one = DualGraph(mesh), lambda df: df.withColumn("k", F.lit(0))
    cut = lambda name: stats.cut_edges(graph, partitioners.partition(name, graph, TEN)).agg(F.expr("count(*) div 2").alias("cut"))
    both = one(cut("parmetis-geo").withColumnRenamed("cut", "curve_cut")).join(one(cut("parmetis")), "k")
    return both.select("curve_cut", (F.col("cut") * 10 <= F.col("curve_cut") * 9).alias("better"))


@query("SELECT (SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) FROM lineitem) AS nodes, count(*) AS edges, TRUE AS whole, TRUE AS better FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def partition_social(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Parts and suppliers that were ordered together, a graph of hubs: every node has a part, and most of the weight is left uncut that equal shares by chance would cut."""
    lines = mesh.raw_cells.sparkSession.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = Tables(lines.sparkSession).kept(lines.groupBy((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).agg(F.count("*").alias("w")), stay=True, hinted=False)
    edges = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e")).select("e.*")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct().withColumn("w0", F.lit(1).cast("long"))
    found = partitioners.any_graph(nodes, edges, partitioners.Target(4, imbalance=0.05), partitioners.Effort("clustered", rounds=2, tries=2), summed=True)
    sides = pairs.join(met(found.select(F.col("cell").alias("a"), F.col("part").alias("pa"))), "a").join(met(found.select(F.col("cell").alias("b"), F.col("part").alias("pb"))), "b")
    cut = sides.agg(F.count("*").alias("edges"), F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w")).otherwise(0)).alias("cut"), F.sum("w").alias("all"))
    placed = found.agg(F.count("*").alias("nodes"), (F.count_distinct("cell") == F.count("*")).alias("whole"))
    one = lambda df: df.withColumn("k", F.lit(0))
    return one(placed).join(one(cut), "k").select("nodes", "edges", "whole", (F.col("cut") < F.col("all") * 0.75).alias("better"))


def random_sql(key: str) -> str:
    """The random weight of a key, in SQL."""
    step = lambda x: f"(({x} * 1103515245 + 12345) % 2147483648)"
    return f"({step(f'({step(f'(({key} + 123) % 2147483648)')} * 69069 % 2147483648)')} // 4096 % 1000 + 1)"


WEIGHTINGS = {"none": ("none", "none"), "random": ("random", "none"), "both": ("random", "random"), "increasing": ("increasing", "increasing")}


@query()
def partitions_together(mesh: Mesh, sf_dir: str) -> DataFrame:
    """Four partitions under four weightings, measured in one pass over the edges. Its SQL takes minutes in whole; a test holds it against one by one."""
    graph = DualGraph(mesh)
    cells = mesh.cells
    found = {
        "none": partitioners.partition("none", graph, partitioners.Target(PARTS)),
        "scattered": cells.select(F.col("gid").alias("cell"), (F.col("orig_gid") * 31 % 7).alias("part")),
        "curve": partitioners.partition("parmetis-geo", weighted_graph(mesh), TEN),
        "block": partitioners.partition("block", graph, partitioners.Target(10)),
    }
    return stats.measured_together(graph, found, WEIGHTINGS)


@query("SELECT gid, orig_gid * 5 + 2 AS orig_gid, part, v0, v1, v2, v3 FROM cells")
def sparse_cell_gid(mesh: Mesh, sf_dir: str) -> DataFrame:
    """The same mesh with gaps between the ids of the file."""
    dense = F.expr("(orig_gid - 2) div 5")
    part = F.pmod(dense * 7919 + F.expr("((orig_gid - 2) div 5) div 37"), F.lit(PARTS))
    return Mesh(mesh.raw_cells.withColumn("orig_gid", F.col("orig_gid") * 5 + 2), mesh.raw_vertices).partition_by(part, PARTS).cells


HARNESS = [("none", "none", "none"), ("none", "random", "none"), ("block", "random", "random"), ("block", "increasing", "increasing")]


@query(
    f""", spots AS MATERIALIZED (SELECT 'none' AS partitioner, gid AS cell, part FROM cells UNION ALL SELECT 'block', gid, CASE WHEN gid < (n % {PARTS}) * (n // {PARTS} + 1) THEN gid // (n // {PARTS} + 1) ELSE (gid - (n % {PARTS}) * (n // {PARTS} + 1)) // (n // {PARTS}) + n % {PARTS} END FROM cells, (SELECT count(*) AS n FROM cells)),
pairs AS MATERIALIZED (SELECT eid, src, dst FROM dual),
crossed AS MATERIALIZED (SELECT a.partitioner, p.eid FROM pairs p JOIN spots a ON a.cell = p.src JOIN spots b ON b.cell = p.dst AND b.partitioner = a.partitioner WHERE a.part <> b.part)
SELECT h.partitioner, h.vertex_weights, h.edge_weights, (SELECT count(*) FROM cells) AS total_vertices, CAST({PARTS} AS BIGINT) AS mpi_size, s.largest, s.largest_weighted, c.cut, c.cut_weighted
FROM (VALUES {", ".join(map(str, HARNESS))}) h(partitioner, vertex_weights, edge_weights)
JOIN (SELECT partitioner, vertex_weights, max(size) AS largest, CAST(max(w) AS BIGINT) AS largest_weighted FROM (
    SELECT partitioner, vertex_weights, part, count(*) AS size, sum(CASE vertex_weights WHEN 'random' THEN {random_sql('cell')} WHEN 'increasing' THEN cell + 1 ELSE 1 END) AS w FROM (
        SELECT 'none' AS partitioner, gid AS cell, part FROM cells UNION ALL SELECT 'block', gid, CASE WHEN gid < (n % {PARTS}) * (n // {PARTS} + 1) THEN gid // (n // {PARTS} + 1) ELSE (gid - (n % {PARTS}) * (n // {PARTS} + 1)) // (n // {PARTS}) + n % {PARTS} END FROM cells, (SELECT count(*) AS n FROM cells)),
        (VALUES ('none'), ('random'), ('increasing')) v(vertex_weights) GROUP BY ALL) GROUP BY ALL) s ON s.partitioner = h.partitioner AND s.vertex_weights = h.vertex_weights
JOIN (SELECT a.partitioner, edge_weights, CAST(count(*) // 2 AS BIGINT) AS cut, CAST(sum(CASE edge_weights WHEN 'random' THEN {random_sql('eid')} WHEN 'increasing' THEN eid + 1 ELSE 1 END) // 2 AS BIGINT) AS cut_weighted FROM crossed a, (VALUES ('none'), ('random'), ('increasing')) v(edge_weights) GROUP BY ALL) c ON c.partitioner = h.partitioner AND c.edge_weights = h.edge_weights"""
)
def harness_reports(mesh: Mesh, sf_dir: str) -> DataFrame:
    """From settings to reports: weights, partitioner and quality of each setting."""
    settings = [{"partitioner": p, "nparts": PARTS, "vertex_weights": v, "edge_weights": e} for p, v, e in HARNESS]
    out = None
    for setting, found in stats.harness(DualGraph(mesh), settings):
        r = found.select(F.from_json("value", REPORT).alias("r")).select(
            *[F.lit(setting[k]).alias(k) for k in ("partitioner", "vertex_weights", "edge_weights")], "r.total_vertices", "r.mpi_size",
            F.array_max("r.rank_stats.size").alias("largest"), F.array_max("r.rank_stats.size_weighted").alias("largest_weighted"), "r.cut", "r.cut_weighted",
        )
        out = r if out is None else out.unionByName(r)
    return out
