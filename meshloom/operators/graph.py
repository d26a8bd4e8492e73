"""The dual graph of a mesh: cells are vertices, two-sided faces are pairs of directed edges."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.numbering import running_sum
from meshloom.operators.mesh import Mesh
from meshloom.operators.tables import large


@dataclass(frozen=True)
class DualGraph:
    """``vertex_weights``: (cell, w) with w an array of longs; ``edge_weights``: (eid, w), or an expression over ``edges``."""

    mesh: Mesh
    vertex_weights: DataFrame | None = None
    edge_weights: DataFrame | Column | None = None

    # -- structure ------------------------------------------------------------

    @cached_property
    def degrees(self) -> DataFrame:
        """(cell, part, degree, first): number of neighbours, and of directed edges of all cells before."""
        sides = self.mesh.face_sides.where("not is_boundary").groupBy("cell").agg(F.count("*").alias("degree"))
        cells = self.mesh.cells.select(F.col("gid").alias("cell"), "part").join(sides, "cell", "left").fillna(0, ["degree"])
        return running_sum(cells, "cell", F.col("degree"), "first", max(1, self.mesh.total_cells())).select("cell", "part", "degree", "first")

    @cached_property
    def edges(self) -> DataFrame:
        """(eid, src, slot, dst, face, part, dst_part): directed edges.

        A cell's edges are in the order in which iteration meets them: faces within the part by id, then shared faces by
        the other part and id. ``eid`` counts the edges of all cells in this order.
        """
        remote = F.col("part") != F.col("nbr_part")
        near = F.struct(remote.alias("remote"), F.when(remote, F.col("nbr_part")).alias("at"), "face", "nbr_cell", "nbr_part")
        lists = self.mesh.face_sides.where("not is_boundary").groupBy("cell", "part").agg(F.sort_array(F.collect_list(near)).alias("near"))  # the faces of a cell
        placed = running_sum(lists, "cell", F.size("near"), "first", max(1, self.mesh.total_cells())).select("cell", "part", "first", F.posexplode("near").alias("slot", "n"))
        return placed.select(
            (F.col("first") + F.col("slot")).alias("eid"), F.col("cell").alias("src"), "slot", F.col("n.nbr_cell").alias("dst"), F.col("n.face").alias("face"), "part", F.col("n.nbr_part").alias("dst_part"),
        )

    def displacement(self) -> DataFrame:
        """(cell, degree, first): the row pointers of the compressed form."""
        return self.degrees.select("cell", "degree", "first")

    def distribution(self) -> DataFrame:
        """(part, vertices, edges, first_vertex, first_edge) of every part, also of those without cells."""
        counts = self.degrees.groupBy("part").agg(F.count("*").alias("vertices"), F.sum("degree").alias("edges"))
        every = self.mesh.raw_cells.sparkSession.range(self.mesh.parts).select(F.col("id").cast("int").alias("part"))
        rows = every.join(counts, "part", "left").fillna(0)
        before = Window.orderBy("part")  # a row for each part
        return rows.select("part", "vertices", "edges", (F.sum("vertices").over(before) - F.col("vertices")).alias("first_vertex"), (F.sum("edges").over(before) - F.col("edges")).alias("first_edge"))

    def counts(self) -> DataFrame:
        """(vertices, edges) in all; edges are directed."""
        return self.degrees.agg(F.count("*").alias("vertices"), F.sum("degree").alias("edges"))

    def for_each_local_edge(self, external: DataFrame, internal: DataFrame | None = None) -> DataFrame:
        """``edges`` with the values of the neighbour (ext_*) and, if given, of the own cell (int_*); frames as (cell, ...)."""
        ext = external.select(F.col("cell").alias("dst"), *[F.col(c).alias(f"ext_{c}") for c in external.columns if c != "cell"])
        out = self.edges.join(ext, "dst")
        if internal is not None:
            out = large(out).join(internal.select(F.col("cell").alias("src"), *[F.col(c).alias(f"int_{c}") for c in internal.columns if c != "cell"]), "src")
        return out

    def barycenters(self) -> DataFrame:
        """(cell, x, y, z): the mean of the cell's vertices, summed in the order of slots."""
        n = self.mesh.topology.vertices
        corners = self.mesh.cells.select(F.col("gid").alias("cell"), F.posexplode(F.array(*self.mesh.slots)).alias("slot", "vid"))
        at = corners.join(self.mesh.raw_vertices.select("vid", "x", "y", "z"), "vid")
        slots = at.groupBy("cell").agg(*[F.max(F.when(F.col("slot") == i, F.col(a))).alias(f"{a}{i}") for a in "xyz" for i in range(n)])
        mean = {a: sum((F.col(f"{a}{i}") for i in range(1, n)), F.col(f"{a}0")) / n for a in "xyz"}
        return slots.select("cell", *[v.alias(a) for a, v in mean.items()])

    # -- weights --------------------------------------------------------------

    def with_vertex_weights(self, weights: DataFrame | None) -> DualGraph:
        """(cell, w) with w a long or an array of longs; None changes nothing."""
        if weights is None:
            return self
        kind = weights.schema["w"].dataType.typeName()
        w = F.col("w").cast("array<bigint>") if kind == "array" else F.array(F.col("w").cast("bigint"))
        return replace(self, vertex_weights=weights.select("cell", w.alias("w")))

    def with_edge_weights(self, weights: DataFrame | Column | None) -> DualGraph:
        """(eid, w) for directed edges, or an expression over ``edges``, which needs no join; None changes nothing."""
        if weights is None:
            return self
        return replace(self, edge_weights=weights.cast("bigint") if isinstance(weights, Column) else weights.select("eid", F.col("w").cast("bigint").alias("w")))

    def constraints(self) -> int:
        """How many weights a cell has at most; 1 without weights."""
        return 1 if self.vertex_weights is None else self.vertex_weights.agg(F.max(F.size("w"))).first()[0] or 1

    def weighted_vertices(self) -> DataFrame:
        """(cell, part, w): the first weight of each cell, 1 without weights. Sizes and cuts are reported by it."""
        cells = self.mesh.cells.select(F.col("gid").alias("cell"), "part")
        if self.vertex_weights is None:
            return cells.withColumn("w", F.lit(1).cast("bigint"))
        return cells.join(self.vertex_weights.select("cell", F.col("w")[0].alias("w")), "cell", "left").fillna(1, ["w"])

    def weighted_cells(self) -> DataFrame:
        """(cell, w0, w1, ...): all weights of each cell, 1 for those it lacks."""
        cells, n = self.mesh.cells.select(F.col("gid").alias("cell")), self.constraints()
        if self.vertex_weights is None:
            return cells.withColumn("w0", F.lit(1).cast("bigint"))
        own = self.vertex_weights.select("cell", *[F.get("w", F.lit(c)).alias(f"w{c}") for c in range(n)])
        return cells.join(own, "cell", "left").fillna(1, [f"w{c}" for c in range(n)])

    def adjacency(self) -> DataFrame:
        """(src, dst, w) of all directed edges; without edge weights neither faces nor edges need numbers."""
        if self.edge_weights is not None:
            return self.weighted_edges().select("src", "dst", "w")
        a, b = F.get("sides", F.lit(0))["cell"], F.get("sides", F.lit(1))["cell"]
        ways = F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst"))))
        return self.mesh.face_groups.where("size(sides) = 2").select(ways.alias("e")).select("e.*", F.lit(1).cast("bigint").alias("w"))

    def weighted_edges(self) -> DataFrame:
        """``edges`` with w, 1 without weights."""
        if self.edge_weights is None:
            return self.edges.withColumn("w", F.lit(1).cast("bigint"))
        if isinstance(self.edge_weights, Column):
            return self.edges.withColumn("w", self.edge_weights)
        return self.edges.join(self.edge_weights, "eid", "left").fillna(1, ["w"])
