"""Partitioners of the dual graph, and the targets they meet.

All of them give (cell, part), a row for each cell, and are functions of graph, target and
seed alone. Sizes stay within one cell's weight of (1 + imbalance) times a part's share, in
every weight that cells have.

- none: the current parts.
- block: equal runs of cell ids.
- parmetis-geo: runs along a Morton curve through the barycenters, of the first weight; graphs
  with several weights are refused.
- all others: multilevel partitioning (``multilevel.py``). parmetis and the parhip presets refine
  all parts of the smallest graph together, the ptscotch ones keep to the bisections of the
  target's tree; their -b variants keep sizes to the shares themselves, without the imbalance.
  The social presets of parhip coarsen by clusters of labels, for graphs with hubs. Presets for
  quality or speed differ in tries at the smallest graph and rounds of refinement.

``any_graph`` partitions nodes and edges from any table, not just a mesh.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.distribute import Blocks
from meshloom.functions.numbering import how_many_below
from meshloom.operators.graph import DualGraph
from meshloom.operators.multilevel import Effort, balanced, graph_level, limits, multilevel
from meshloom.operators.tables import Tables, large


@dataclass(frozen=True)
class Target:
    """How many parts, their shares (empty: equal) and the allowed excess."""

    parts: int
    weights: tuple[float, ...] = field(default=())
    imbalance: float = 0.0

    def uniform(self, parts: int) -> Target:
        return replace(self, parts=parts, weights=())

    def weighted(self, weights: list[float]) -> Target:
        return replace(self, parts=len(weights), weights=tuple(w / sum(weights) for w in weights))

    @property
    def shares(self) -> tuple[float, ...]:
        return self.weights or (1 / self.parts,) * self.parts


class PartitionError(ValueError):
    """An unknown partitioner or an impossible target."""


def keep(graph: DualGraph, target: Target, seed: int = 1) -> DataFrame:
    return graph.mesh.cells.select(F.col("gid").alias("cell"), "part")


def block(graph: DualGraph, target: Target, seed: int = 1) -> DataFrame:
    blocks = Blocks(graph.mesh.total_cells(), target.parts)
    return graph.mesh.cells.select(F.col("gid").alias("cell"), blocks.part_column(F.col("gid")).alias("part"))


def spread(x: Column) -> Column:
    """The low 20 bits of a number with two zero bits between each and the next (fixed masks of bit interleaving)."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def along_curve(graph: DualGraph, tables: Tables) -> tuple[DataFrame, int]:
    """(cell, curve, w): the place of each barycenter on a Morton curve, 20 bits for each axis, and the sum of weights."""
    centers = tables.kept(large(graph.barycenters()).join(graph.weighted_vertices().select("cell", "w"), "cell"))
    box = centers.agg(F.sum("w").alias("total"), *[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max))]).first()
    scaled = []
    for a in "xyz":
        low, high = box[f"l{a}"] or 0.0, box[f"h{a}"] or 0.0
        scaled.append(((F.col(a) - low) / ((high - low) or 1.0) * ((1 << 20) - 1)).cast("long"))
    x, y, z = map(spread, scaled)
    places = centers.select("cell", x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2)).alias("curve"), "w")
    return tables.kept(places), box["total"] or 0  # kept: what reads it would compute the bits again, outside of generated code


def by_weight(rows: DataFrame, total: int, target: Target) -> DataFrame:
    """(cell, part) of rows (cell, w, before): the part whose share of the whole weight the middle of the cell falls in."""
    middle = (F.col("before") + F.col("w") / 2) / F.lit(float(max(total, 1)))
    ends, acc = [], 0.0
    for share in target.shares[:-1]:
        acc += share
        ends.append(acc)
    return rows.select("cell", how_many_below(middle, ends, "double").cast("int").alias("part"))


#: The most stretches of the curve whose weights are summed one by one.
STRETCHES = 4096


def geometric(graph: DualGraph, target: Target, seed: int = 1) -> DataFrame:
    """Runs of equal weight along the curve; cells at one place of it follow by id.

    Cells are dealt to stretches of the curve that hold about as many each, however the mesh is graded.
    """
    with Tables(graph.mesh.raw_cells.sparkSession) as tables:
        rows, total = along_curve(graph, tables)
        many = min(STRETCHES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        bounds = rows.agg(F.percentile_approx("curve", [k / many for k in range(1, many)], 10 * many).alias("b")).first()["b"] or []
        dealt = rows.withColumn("__l", how_many_below(F.col("curve"), sorted(set(bounds))))
        totals = dealt.groupBy("__l").agg(F.sum("w").alias("__t"))
        base = totals.select("__l", (F.sum("__t").over(Window.orderBy("__l")) - F.col("__t")).alias("__base"))  # a row for each stretch
        inner = Window.partitionBy("__l").orderBy("curve", "cell")
        summed = dealt.withColumn("__in", F.sum("w").over(inner) - F.col("w")).join(F.broadcast(base), "__l").withColumn("before", F.col("__base") + F.col("__in"))
        return tables.kept(by_weight(summed, total, target), stay=True)


def by_levels(effort: Effort) -> Callable[..., DataFrame]:
    def run(graph: DualGraph, target: Target, seed: int = 1) -> DataFrame:
        return any_graph(graph.weighted_cells(), graph.adjacency(), target, effort, seed)

    return run


def any_graph(nodes: DataFrame, edges: DataFrame, target: Target, effort: Effort, seed: int = 1, summed: bool = False) -> DataFrame:
    """(cell, part) of a graph in tables: nodes (cell, w0, w1, ...), edges (src, dst, w) in both directions, ``summed`` if none is parallel."""
    with Tables(nodes.sparkSession) as tables:
        level = graph_level(nodes, edges, len(nodes.columns) - 1, tables, summed)
        return Tables(nodes.sparkSession).kept(multilevel(level, target.shares, target.imbalance, effort, seed).select("cell", F.col("part").cast("int").alias("part")), stay=True)


def rebalanced(graph: DualGraph, assigned: DataFrame, target: Target, seed: int = 1, told: list | None = None) -> DataFrame:
    """(cell, part): ``assigned`` (cell, part) moved along flows between touching parts until it meets the target."""
    with Tables(assigned.sparkSession) as tables:
        nodes = graph.weighted_cells()
        level = graph_level(nodes, graph.adjacency(), len(nodes.columns) - 1, tables)
        return Tables(assigned.sparkSession).kept(balanced(level, tables.kept(assigned.select("cell", "part")), limits(level, target.shares, target.imbalance), seed, told=told), stay=True)


#: The names of all partitioners.
PARTITIONERS: dict[str, Callable[..., DataFrame]] = {
    "none": keep,
    "block": block,
    "parmetis": by_levels(Effort(rounds=4, tries=4)),
    "parmetis-geo": geometric,
    "ptscotch": by_levels(Effort(rounds=4, tries=4, together=False)),
    "ptscotch-q": by_levels(Effort(rounds=8, tries=8, together=False)),
    "ptscotch-b": by_levels(Effort(rounds=4, tries=4, together=False, strict=True)),
    "ptscotch-bq": by_levels(Effort(rounds=8, tries=8, together=False, strict=True)),
    "ptscotch-s": by_levels(Effort(rounds=2, tries=1, together=False)),
    "ptscotch-sb": by_levels(Effort(rounds=2, tries=1, together=False, strict=True)),
    "parhip-ultrafast": by_levels(Effort(rounds=2, tries=1)),
    "parhip-fast": by_levels(Effort(rounds=4, tries=2)),
    "parhip-eco": by_levels(Effort(rounds=10, tries=8)),
    "parhip-ultrafastsocial": by_levels(Effort("clustered", rounds=2, tries=1)),
    "parhip-fastsocial": by_levels(Effort("clustered", rounds=4, tries=2)),
    "parhip-ecosocial": by_levels(Effort("clustered", rounds=10, tries=8)),
}


def partition(name: str, graph: DualGraph, target: Target, seed: int = 1) -> DataFrame:
    """(cell, part) by the partitioner of that name."""
    if name not in PARTITIONERS:
        raise PartitionError(f"{name} is none of {', '.join(PARTITIONERS)}")
    if target.parts < 1 or target.imbalance < 0 or target.weights and len(target.weights) != target.parts:
        raise PartitionError("a target needs a part, a share for each, and no negative imbalance")
    if name == "parmetis-geo" and (n := graph.constraints()) > 1:
        raise PartitionError(f"{name} balances one weight for each cell, not {n}")
    return PARTITIONERS[name](graph, target, seed)
