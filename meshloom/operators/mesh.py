"""A mesh as lazy tables: cells, faces, edges, vertices and how they touch.

Tables and their columns:

- ``cells``: gid, orig_gid, part, v0..v3. gid counts cells by (part, orig_gid).
- ``faces``: gid, k0, k1, k2 (vertices, ascending), cell0, cell1 (null: none), part0, part1, owner, parts
- ``edges``: gid, k0, k1, owner, parts
- ``vertices``: vid, x, y, z, owner, parts, and the vertex attributes that are asked for

``parts`` lists all parts that hold the entity, ascending; the owner is the first. Faces and
edges are numbered by their first position, cell gid * slots + slot: the order of owners,
and within an owner the order in which its cells meet them.

Parts are a column. They have nothing to do with Spark's partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.numbering import dense_ids, ids_by_part
from meshloom.functions.topology import TETRAHEDRON, Topology
from meshloom.operators.tables import large, many

CELL, VERTEX = "cell", "vertex"


@dataclass(frozen=True)
class Attribute:
    """A column of data for each cell (key orig_gid) or vertex (key vid): (key, value); ``sizes`` are its trailing dimensions."""

    kind: str
    values: DataFrame
    sizes: tuple[int, ...] = ()


def tags(table: str, columns: Sequence[str], df: DataFrame) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{table} lacks {', '.join(missing)}")


def extents(value: Column, outer: Sequence[int], n: int) -> Column:
    """Whether all arrays at this depth of a value have n elements."""
    return F.size(value) == n if not outer else F.forall(value, lambda inner: extents(inner, outer[1:], n))


@dataclass(frozen=True)
class Mesh:
    """``raw_cells``: (orig_gid, v0..v3); ``raw_vertices``: (vid, x, y, z); ``assignment``: (orig_gid, part) or an expression, else all in part 0.

    ``orig_gid`` is unique and not negative and may have gaps, as in a filtered file. ``cell_count`` says that it is
    0..cell_count-1, which saves a scan; a cell out of that range is an error.
    """

    raw_cells: DataFrame
    raw_vertices: DataFrame
    topology: Topology = TETRAHEDRON
    attributes: tuple[Attribute, ...] = field(default=())
    assignment: DataFrame | Column | None = None
    parts: int = 1
    cell_count: int | None = None

    def __post_init__(self) -> None:
        tags("cells", ["orig_gid", *self.slots], self.raw_cells)
        tags("vertices", ["vid", "x", "y", "z"], self.raw_vertices)

    @property
    def slots(self) -> list[str]:
        return [f"v{i}" for i in range(self.topology.vertices)]

    # -- data and distribution ------------------------------------------------

    def add_data(self, values: DataFrame, kind: str, sizes: tuple[int, ...] = (), key: str | None = None, value: str = "value") -> Mesh:
        """A mesh with one more attribute, addressed by its number among those of its kind."""
        if kind not in (CELL, VERTEX):
            raise ValueError(f"{kind} is neither {CELL} nor {VERTEX}")
        own = "orig_gid" if kind == CELL else "vid"
        tags("attribute", [key or own, value], values)
        depth, kind_of = 0, values.schema[value].dataType
        while kind_of.typeName() == "array":
            depth, kind_of = depth + 1, kind_of.elementType
        if depth != len(sizes):
            raise ValueError(f"the values have {depth} dimensions, {len(sizes)} were declared")
        table = values.select(F.col(key or own).alias(own), F.col(value).alias("value"))
        if sizes:  # a wrong extent is an error of the row that has it
            good = reduce(Column.__and__, (extents(F.col("value"), sizes[:k], n) for k, n in enumerate(sizes)))
            table = table.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.lit(f"a value isn't of the shape {sizes}"))))
        return self.changed(attributes=(*self.attributes, Attribute(kind, table, sizes)))

    def cell_data(self, i: int) -> DataFrame:
        """(gid, orig_gid, value) of the i-th cell attribute, aligned with the cells as distributed."""
        return self.cells.select("gid", "orig_gid").join(self.original_cell_data(i), "orig_gid")

    def vertex_data(self, i: int) -> DataFrame:
        """(vid, value) of the i-th vertex attribute for vertices that cells use."""
        return large(self.vertices.select("vid")).join(self.original_vertex_data(i), "vid")

    def original_cell_data(self, i: int) -> DataFrame:
        return [a for a in self.attributes if a.kind == CELL][i].values

    def original_vertex_data(self, i: int) -> DataFrame:
        return [a for a in self.attributes if a.kind == VERTEX][i].values

    def partition(self, assignment: DataFrame, parts: int) -> Mesh:
        """The mesh with its cells (and so their attributes) assigned to parts 0..parts-1; can be done again."""
        tags("assignment", ["orig_gid", "part"], assignment)
        return self.changed(assignment=assignment.select("orig_gid", F.col("part").cast("int").alias("part")), parts=parts)

    def partition_by(self, part: Column, parts: int) -> Mesh:
        """As ``partition``, by an expression over the raw cells: no join is needed."""
        return self.changed(assignment=part.cast("int"), parts=parts)

    def changed(self, **changes) -> Mesh:
        """A mesh of the same cells with other fields; what is known of the cells stays known."""
        new = replace(self, **changes)
        if "extent" in self.__dict__:
            new.__dict__["extent"] = self.extent
        return new

    @cached_property
    def distributed(self) -> DataFrame:
        """(orig_gid, part, v0..v3); a cell without a part, or with one out of range, is an error."""
        cells = large(self.raw_cells.select("orig_gid", *self.slots))
        if self.assignment is None:
            return cells.withColumn("part", F.lit(0))
        joined = cells.withColumn("part", self.assignment) if isinstance(self.assignment, Column) else cells.join(self.assignment, "orig_gid", "left")
        good = F.col("part").between(0, self.parts - 1)
        return joined.withColumn("part", F.when(good, F.col("part")).otherwise(F.raise_error(F.lit("a cell has no part in range"))))

    @cached_property
    def extent(self) -> tuple[int, int]:
        """(number of cells, one more than the largest orig_gid); one scan of the ids unless ``cell_count`` is given."""
        if self.cell_count is not None:
            return self.cell_count, self.cell_count
        row = self.raw_cells.agg(F.count("*").alias("n"), F.max("orig_gid").alias("top")).first()
        return row["n"], 0 if row["top"] is None else row["top"] + 1

    def total_cells(self) -> int:
        return self.extent[0]

    def original_counts(self) -> DataFrame:
        """(part, cells) of all parts that have cells."""
        return self.distributed.groupBy("part").agg(F.count("*").alias("cells"))

    # -- entities -------------------------------------------------------------

    @cached_property
    def cells(self) -> DataFrame:
        span = self.extent[1]
        inside = F.when(F.col("orig_gid").between(0, span - 1), F.col("orig_gid")).otherwise(F.raise_error(F.lit(f"a cell's orig_gid isn't in 0..{span - 1}")))
        keyed = self.distributed.withColumn("orig_gid", inside)
        return ids_by_part(keyed, "part", "orig_gid", "gid", span, self.parts).select("gid", "orig_gid", "part", *self.slots)

    @cached_property
    def face_slots(self) -> DataFrame:
        """(cell, part, slot, k0, k1, k2): every side of every cell."""
        rows = []
        for slot, own in enumerate(self.topology.faces):
            k = F.array_sort(F.array(*[F.col(f"v{i}") for i in own])) if len(own) != 3 else None
            if k is None:
                a, b, c = (F.col(f"v{i}") for i in own)
                low, high = F.least(a, b, c), F.greatest(a, b, c)
                keys = [low, a + b + c - low - high, high]
            else:
                keys = [F.element_at(k, i + 1) for i in range(len(own))]
            rows.append(F.struct(F.lit(slot).alias("slot"), *[x.alias(f"k{i}") for i, x in enumerate(keys)]))
        return self.cells.select(F.col("gid").alias("cell"), "part", F.explode(F.array(*rows)).alias("f")).select("cell", "part", "f.*")

    @property
    def face_keys(self) -> list[str]:
        return [f"k{i}" for i in range(self.topology.face_vertices)]

    @cached_property
    def edge_slots(self) -> DataFrame:
        """(cell, part, slot, k0, k1)"""
        rows = [F.struct(F.lit(slot).alias("slot"), F.least(f"v{a}", f"v{b}").alias("k0"), F.greatest(f"v{a}", f"v{b}").alias("k1")) for slot, (a, b) in enumerate(self.topology.edges)]
        return self.cells.select(F.col("gid").alias("cell"), "part", F.explode(F.array(*rows)).alias("e")).select("cell", "part", "e.*")

    @cached_property
    def face_groups(self) -> DataFrame:
        """Faces before numbering, with their sides (cell, slot, part) ascending; one shuffle by key makes them."""
        n = self.topology.cell_faces
        slots, wide = self.face_slots, many(self.raw_cells.sparkSession, self.total_cells() * n)
        grouped = (slots.repartition(wide, *self.face_keys) if wide else slots).groupBy(*self.face_keys).agg(F.sort_array(F.collect_list(F.struct("cell", "slot", "part"))).alias("sides"))
        first = F.col("sides")[0]
        manifold = F.when(F.size("sides") <= 2, F.col("sides")).otherwise(F.raise_error(F.concat(F.lit("more than two cells share the face "), F.to_json(F.array(*self.face_keys)))))
        return grouped.select(*self.face_keys, manifold.alias("sides"), (first["cell"] * n + first["slot"]).alias("first_pos"))

    @cached_property
    def numbered_faces(self) -> DataFrame:
        return dense_ids(self.face_groups, "first_pos", "gid", max(1, self.total_cells()) * self.topology.cell_faces)

    @cached_property
    def faces(self) -> DataFrame:
        a, b = F.get("sides", F.lit(0)), F.get("sides", F.lit(1))
        parts = F.sort_array(F.array_distinct(F.transform("sides", lambda s: s["part"])))
        return self.numbered_faces.select(
            "gid", *self.face_keys, a["cell"].alias("cell0"), b["cell"].alias("cell1"), a["part"].alias("part0"), b["part"].alias("part1"),
            parts[0].alias("owner"), parts.alias("parts"),
        )

    @cached_property
    def numbered_edges(self) -> DataFrame:
        """(gid, k0, k1, sides): edges with the places (cell, slot, part) where cells have them, ascending; one shuffle by key makes them."""
        n = self.topology.cell_edges
        slots, wide = self.edge_slots, many(self.raw_cells.sparkSession, self.total_cells() * n)
        grouped = (slots.repartition(wide, "k0", "k1") if wide else slots).groupBy("k0", "k1").agg(F.sort_array(F.collect_list(F.struct("cell", "slot", "part"))).alias("sides"))  # the cells around an edge
        first = F.col("sides")[0]
        return dense_ids(grouped.withColumn("first_pos", first["cell"] * n + first["slot"]), "first_pos", "gid", max(1, self.total_cells()) * n)

    @cached_property
    def edges(self) -> DataFrame:
        parts = F.array_sort(F.array_distinct(F.transform("sides", lambda s: s["part"])))
        return self.numbered_edges.select("gid", "k0", "k1", parts[0].alias("owner"), parts.alias("parts"))

    @cached_property
    def required_vertices(self) -> DataFrame:
        """(part, vid): the vertices that each part's cells use."""
        return self.distributed.select("part", F.explode(F.array(*self.slots)).alias("vid")).distinct()

    @cached_property
    def vertices(self) -> DataFrame:
        """Vertices that cells use, with the parts that hold them."""
        held = self.required_vertices.groupBy("vid").agg(F.sort_array(F.collect_set("part")).alias("parts"))
        return large(self.raw_vertices.select("vid", "x", "y", "z")).join(held, "vid").select("vid", "x", "y", "z", F.col("parts")[0].alias("owner"), "parts")

    def local_vertices(self) -> DataFrame:
        """(part, vid, lid, shared): local ids within each part, by vid, and the other parts that hold the vertex."""
        rows = large(self.required_vertices).join(self.vertices.select("vid", "parts"), "vid")
        return self.local_ids(rows, "vid").select("part", "vid", "lid", F.array_remove("parts", F.col("part")).alias("shared"))

    def local_ids(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` (part, key, ...) with dense local ids within each part, in the order of the key."""
        top = rows.agg(F.max(key)).first()[0]
        return ids_by_part(rows, "part", key, "lid", (top or 0) + 1, self.parts, local=True)

    # -- incidence ------------------------------------------------------------

    @cached_property
    def cell_faces(self) -> DataFrame:
        """(cell, slot, face, part): from the sides that each face already carries, without a join."""
        return self.numbered_faces.select(F.col("gid").alias("face"), F.explode("sides").alias("s")).select("s.cell", "s.slot", "face", "s.part")

    @cached_property
    def cell_edges(self) -> DataFrame:
        """(cell, slot, edge): from the places that each edge already carries, without a join."""
        return self.numbered_edges.select(F.col("gid").alias("edge"), F.explode("sides").alias("s")).select("s.cell", "s.slot", "edge")

    def neighbors(self, local: bool = False) -> DataFrame:
        """(cell, slot, face, neighbor): the cell on the other side, -1 for none; ``local``: also -1 where it is in another part."""
        other = F.get("sides", F.lit(1) - F.col("at"))
        near = F.when(other["part"] == F.col("s.part"), other["cell"]) if local else other["cell"]
        sides = self.numbered_faces.select(F.col("gid").alias("face"), "sides", F.posexplode("sides").alias("at", "s"))
        return sides.select("s.cell", "s.slot", "face", F.coalesce(near, F.lit(-1)).alias("neighbor"))

    def face_vertices(self) -> DataFrame:
        """(cell, slot, a, b, c): the vertices of each side in the order of the numbering, which isn't sorted."""
        rows = [F.struct(F.lit(slot).alias("slot"), *[F.col(f"v{i}").alias(n) for i, n in zip(own, "abcd", strict=False)]) for slot, own in enumerate(self.topology.faces)]
        return self.cells.select(F.col("gid").alias("cell"), F.explode(F.array(*rows)).alias("f")).select("cell", "f.*")

    def face_side(self, pairs: DataFrame) -> DataFrame:
        """(cell, face, side) of pairs (cell, face): the slot of the face in the cell, -1 if it isn't there."""
        return pairs.join(self.cell_faces.select("cell", "face", "slot"), ["cell", "face"], "left").select("cell", "face", F.coalesce("slot", F.lit(-1)).alias("side"))

    def face_by_vertices(self, keys: DataFrame) -> DataFrame:
        """The columns of ``keys`` (a, b, c in any order) and ``face``, -1 if there is none."""
        low, high = F.least("a", "b", "c"), F.greatest("a", "b", "c")
        asked = keys.withColumns({"k0": low, "k1": F.col("a") + F.col("b") + F.col("c") - low - high, "k2": high})
        found = asked.join(self.faces.select("k0", "k1", "k2", F.col("gid").alias("face")), ["k0", "k1", "k2"], "left")
        return found.select(*keys.columns, F.coalesce("face", F.lit(-1)).alias("face"))

    def face_cells(self) -> DataFrame:
        """(face, cell0, cell1), -1 for none."""
        return self.faces.select(F.col("gid").alias("face"), "cell0", F.coalesce("cell1", F.lit(-1)).alias("cell1"))

    @cached_property
    def edge_faces(self) -> DataFrame:
        """(edge, face): a face has the edges between its vertices."""
        pairs = [F.struct(F.col(a).alias("k0"), F.col(b).alias("k1")) for a, b in (("k0", "k1"), ("k0", "k2"), ("k1", "k2"))] if self.topology.face_vertices == 3 else None
        if pairs is None:
            slots = F.explode(F.array(*[F.struct(F.lit(e).alias("slot"), F.lit(f).alias("fslot")) for e, own in enumerate(self.topology.edge_faces) for f in own]))
            both = self.cells.select(F.col("gid").alias("cell"), slots.alias("m")).select("cell", "m.*")
            faces = self.cell_faces.select("cell", F.col("slot").alias("fslot"), "face")
            return large(both.join(self.cell_edges, ["cell", "slot"])).join(faces, ["cell", "fslot"]).select("edge", "face").distinct()
        sides = self.faces.select(F.col("gid").alias("face"), F.explode(F.array(*pairs)).alias("e")).select("face", "e.*")
        return sides.join(self.edges.select(F.col("gid").alias("edge"), "k0", "k1"), ["k0", "k1"]).select("edge", "face")

    @cached_property
    def vertex_edges(self) -> DataFrame:
        """(vertex, edge)"""
        return self.edges.select(F.explode(F.array("k0", "k1")).alias("vertex"), F.col("gid").alias("edge"))

    def edge_cells(self) -> DataFrame:
        """(edge, cell)"""
        return self.numbered_edges.select(F.col("gid").alias("edge"), F.explode(F.array_distinct(F.transform("sides", lambda s: s["cell"]))).alias("cell"))

    def vertex_faces(self) -> DataFrame:
        """(vertex, face)"""
        return self.faces.select(F.explode(F.array(*self.face_keys)).alias("vertex"), F.col("gid").alias("face"))

    def vertex_cells(self) -> DataFrame:
        """(vertex, cell)"""
        return self.cells.select(F.explode(F.array(*self.slots)).alias("vertex"), F.col("gid").alias("cell"))

    # -- both sides of faces --------------------------------------------------

    @cached_property
    def face_sides(self) -> DataFrame:
        """(face, slot, cell, part, nbr_cell, nbr_part, is_boundary): interior faces twice, once from each cell, boundary faces once."""
        sides = self.numbered_faces.select(F.col("gid").alias("face"), "sides", F.posexplode("sides").alias("at", "s"))
        other = F.get("sides", F.lit(1) - F.col("at"))
        rows = sides.select("face", "s.slot", "s.cell", "s.part", other["cell"].alias("nbr_cell"), other["part"].alias("nbr_part"))
        return rows.withColumn("is_boundary", F.col("nbr_cell").isNull())

    def for_each_face(self, external: DataFrame, internal: DataFrame | None = None, boundary: bool = True, sparse: bool = True) -> DataFrame:
        """``face_sides`` with the values of both cells.

        ``external``: (cell, value columns), seen from the other side as ext_*; ``internal`` (None: no values of the own cell)
        as int_*. Without ``boundary`` only two-sided faces. A handler is an expression, an aggregate or a ``mapInPandas``
        over the result. ``sparse`` is accepted and changes nothing: Spark moves what the join needs.
        """
        sides = self.face_sides if boundary else self.face_sides.where("not is_boundary")
        ext = external.select(F.col("cell").alias("nbr_cell"), *[F.col(c).alias(f"ext_{c}") for c in external.columns if c != "cell"])
        out = sides.join(ext, "nbr_cell", "left")
        if internal is not None:
            out = large(out).join(internal.select("cell", *[F.col(c).alias(f"int_{c}") for c in internal.columns if c != "cell"]), "cell", "left")
        return out


def merged(a: Column, b: Column) -> Column:
    """The sorted union of two lists of ids."""
    return F.array_sort(F.array_union(a, b))


def is_shared(parts: Column) -> Column:
    return F.size(parts) > 1


def shared(parts: Column, part: Column) -> Column:
    """The other parts that hold an entity."""
    return F.array_remove(parts, part)
