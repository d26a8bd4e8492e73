"""Multilevel partitioning: contract the graph level by level, partition the smallest, refine on the way back.

A level is two tables: nodes (cell, w0, w1, ...) with one column for each balance constraint,
and directed edges (src, dst, w) with all parallel ones summed.

- Coarsening by handshakes (``matched``): a node picks the neighbour with the heaviest edge for
  its weight; nodes that picked each other are one node of the next level, and nodes whose
  pick is in such a pair follow it while the pair has room.
- Coarsening by labels (``clustered``): rounds of label propagation with an upper weight of a
  cluster, for graphs with hubs, which have few handshakes.
- Where one of these keeps nearly all nodes of a level, the other is tried.
- The smallest graph has COARSEST nodes and COARSEST_EDGES edges at most and is bisected along the tree of the target's
  shares on the driver (``coarse.py``). Where coarsening stalls above that, as it may with very
  many parts, nodes start in runs along their ids instead; what follows is the same.
- Refinement (``refined_level``): in each round half of the parts, drawn by a hash, may only give
  and half only take. So a cell's neighbours never move against it, every gain is real, and no
  round makes the cut worse. What a part takes stays within its room in every constraint: the
  cells with the largest gains go first, in lots; of the first lot that doesn't fit in whole
  single cells go, so the room is used at any size of the lots.
- Balancing (``balanced``): flows between adjacent parts that even out the sizes with the least
  sum of squares, carried by boundary cells, as long as a part is too large.

Nothing is ever gathered by a node: neighbours' values are joined to edges, and sums for each
(node, part) or (node, label) are combined before they meet. Edges that lead to a hub, a node
of more than HUB edges, are dealt by LOTS with a copy of the hub's value for each.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.numbering import literal
from meshloom.operators import coarse
from meshloom.operators.tables import Tables, met

#: The most nodes and directed edges of the graph that the driver partitions, and of numbers that it holds for (node, part).
COARSEST, COARSEST_EDGES, COARSEST_SUMS = 12_000, 2_000_000, 20_000_000
#: Coarsening ends when a level keeps more than this share of the nodes.
STALLED = 0.85
#: A node of more edges is a hub; its values are copied for LOTS lots of its edges.
HUB, LOTS = 10_000, 64
#: Classes of gain, and lots of each, in which cells move.
CLASSES, CLASS_LOTS = 64, 64


@dataclass(frozen=True)
class Level:
    """Nodes (cell, w0, ...), edges (src, dst, w), and the number of constraints."""

    nodes: DataFrame
    edges: DataFrame
    constraints: int
    tables: Tables

    @property
    def ws(self) -> list[str]:
        return [f"w{c}" for c in range(self.constraints)]

    @cached_property
    def hubs(self) -> DataFrame | None:
        """(cell) of nodes of more than HUB edges, None if there are none."""
        found = self.tables.kept(self.edges.groupBy(F.col("dst").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("cell"))
        return None if found.isEmpty() else found

    @cached_property
    def totals(self) -> tuple[int, list[int], list[int]]:
        """Number of nodes, and the sum and the largest of each weight."""
        row = self.nodes.agg(F.count("*").alias("n"), *[F.sum(w).alias(w) for w in self.ws], *[F.max(w).alias(f"m{w}") for w in self.ws]).first()
        return row["n"], [row[w] or 0 for w in self.ws], [row[f"m{w}"] or 0 for w in self.ws]

    @cached_property
    def crowded(self) -> bool:
        """Whether the driver would hold too many edges, though the nodes may be few."""
        return self.edges.count() > COARSEST_EDGES

    @cached_property
    def dealt_edges(self) -> DataFrame:
        """``edges`` with the lots of both ends: 0, or a hash of the other end if the node is a hub."""
        if self.hubs is None:
            return self.edges
        rows = self.edges
        for side, other in (("src", "dst"), ("dst", "src")):
            hub = F.broadcast(self.hubs.select(F.col("cell").alias(side), F.lit(True).alias("hub"))) if self.few_hubs else self.hubs.select(F.col("cell").alias(side), F.lit(True).alias("hub"))
            rows = rows.join(hub, side, "left").withColumn(f"{side}_lot", F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(LOTS))).otherwise(0)).drop("hub")
        return self.tables.kept(rows, hinted=False)

    @cached_property
    def few_hubs(self) -> bool:
        return self.hubs is not None and self.hubs.limit(100_001).count() <= 100_000

    def beside(self, rows: DataFrame, side: str, values: DataFrame, **names: str) -> DataFrame:
        """``rows`` of edges with columns of ``values`` (cell, ...) of the node at one end, renamed."""
        own = values.select(F.col("cell").alias(side), *[F.col(c).alias(n) for c, n in names.items()])
        if self.hubs is None:
            return rows.join(met(own), side)
        lots = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(LOTS - 1))).otherwise(F.array(F.lit(0)))
        own = own.join(self.hubs.select(F.col("cell").alias(side), F.lit(True).alias("hub")), side, "left").withColumn(f"{side}_lot", F.explode(lots)).drop("hub")
        return rows.join(met(own), [side, f"{side}_lot"])


def graph_level(nodes: DataFrame, edges: DataFrame, constraints: int, tables: Tables, summed: bool = False) -> Level:
    """The first level; edges that are ``summed`` have each (src, dst) once."""
    once = edges.select("src", "dst", "w") if summed else edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    rows = tables.widened(tables.kept(once, hinted=False))
    return Level(tables.kept(nodes), rows, constraints, tables)


def both(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


# -- coarsening -----------------------------------------------------------------


def matched(level: Level, caps: list[int], seed: int) -> DataFrame:
    """(cell, root): pairs that picked each other, with their followers; the others stay alone. No root exceeds ``caps``."""
    ws = level.ws
    rows = level.beside(level.dealt_edges, "dst", level.nodes, **{w: f"d{w}" for w in ws})
    rows = level.beside(rows, "src", level.nodes, **{w: f"s{w}" for w in ws})
    fits = both([F.col(f"s{w}") + F.col(f"d{w}") <= cap for w, cap in zip(ws, caps, strict=True)])
    weight = F.greatest(F.col("sw0"), F.lit(1)).cast("double") * F.greatest(F.col("dw0"), F.lit(1))
    rating = F.struct((F.col("w") * F.col("w") / weight).alias("r"), F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed)).alias("h"), "dst")
    picks = level.tables.kept(rows.where(fits).groupBy(F.col("src").alias("cell")).agg(F.max(rating).alias("p")).select("cell", F.col("p.dst").alias("to"), F.col("p.r").alias("r")))
    twice = picks.groupBy(F.least("cell", "to").alias("root"), F.greatest("cell", "to").alias("other")).agg(F.count("*").alias("n")).where("n = 2")
    pairs = level.tables.kept(twice.select("root", F.explode(F.array("root", "other")).alias("cell")))
    weights = level.nodes.select("cell", *ws)
    heavy = pairs.join(weights, "cell").groupBy("root").agg(*[F.sum(w).alias(f"p{w}") for w in ws])
    behind = picks.join(pairs.select("cell"), "cell", "left_anti").join(pairs.select(F.col("cell").alias("to"), "root"), "to").join(weights, "cell").join(heavy, "root")
    order = Window.partitionBy("root").orderBy(F.col("r").desc(), "cell").rowsBetween(Window.unboundedPreceding, 0)
    room = both([F.sum(w).over(order) + F.col(f"p{w}") <= cap for w, cap in zip(ws, caps, strict=True)])
    followers = behind.withColumn("ok", room).where("ok").select("cell", "root")
    return level.nodes.select("cell").join(pairs.unionByName(followers), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root"))


def clustered(level: Level, caps: list[int], seed: int, rounds: int = 4) -> DataFrame:
    """(cell, root): clusters of label propagation, none above ``caps``.

    In each round half of the nodes, drawn by a hash, may join the cluster of a neighbour, of those with room the one to which
    they have the most weight; ties are drawn by a hash of node and cluster. A cluster lets in lots of applicants, those with the most weight first, while they fit.
    """
    ws, labels = level.ws, level.nodes.select("cell", F.col("cell").alias("root"), *level.ws)
    for k in range(rounds):
        turn = lambda node: F.pmod(F.xxhash64(node, F.lit(seed * 1000 + k)), F.lit(2)) == 0  # noqa: B023, E731
        sizes = level.tables.kept(labels.groupBy("root").agg(*[F.sum(w).alias(f"s{w}") for w in ws]))
        roomy = both([F.col(f"s{w}") < cap for w, cap in zip(ws, caps, strict=True)])
        open_ = labels.join(sizes.where(roomy).select("root"), "root").select("cell", "root")
        rows = level.beside(level.dealt_edges.where(turn("src")), "dst", open_, root="root").select(F.col("src").alias("cell"), "root", "w")
        if level.hubs is None:  # both sums come from one exchange
            rows = rows.repartition("cell")
        sums = rows.groupBy("cell", "root").agg(F.sum("w").alias("pull"))
        # ties by node and cluster: by the cluster alone all would ask the same few, which can't let them in
        best = sums.groupBy("cell").agg(F.max(F.struct("pull", F.xxhash64("cell", "root", F.lit(seed + k)).alias("h"), "root")).alias("best"))
        asks = level.tables.kept(labels.where(turn("cell")).withColumnRenamed("root", "own").join(best, "cell").where("best.root <> own").select("cell", "own", F.col("best.root").alias("root"), "best.pull", *ws))
        lot = (F.lit(32) - F.least(F.floor(F.log2(F.col("pull").cast("double"))), F.lit(31))) * CLASS_LOTS + F.pmod(F.xxhash64("cell", F.lit(k)), F.lit(CLASS_LOTS))
        asks = asks.withColumn("lot", lot.cast("int"))
        demand = asks.groupBy("root", "lot").agg(*[F.sum(w).alias(w) for w in ws]).join(sizes, "root")
        upto = Window.partitionBy("root").orderBy("lot").rowsBetween(Window.unboundedPreceding, 0)  # a row for each lot
        ok = both([F.sum(w).over(upto) + F.col(f"s{w}") <= cap for w, cap in zip(ws, caps, strict=True)])
        moves = asks.join(demand.withColumn("ok", ok).where("ok").select("root", "lot"), ["root", "lot"]).select("cell", F.col("root").alias("to"))
        labels = level.tables.kept(labels.join(moves, "cell", "left").select("cell", F.coalesce("to", "root").alias("root"), *ws))
    return labels.select("cell", "root")


def contracted(level: Level, roots: DataFrame) -> Level:
    """The next level: a node for each root, with the sums of weights."""
    ws = level.ws
    nodes = level.nodes.join(roots, "cell").groupBy(F.col("root").alias("cell")).agg(*[F.sum(w).alias(w) for w in ws])
    rows = level.beside(level.beside(level.dealt_edges, "dst", roots, root="b"), "src", roots, root="a").where("a <> b")
    edges = rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
    return Level(level.tables.kept(nodes), level.tables.kept(edges, hinted=False), level.constraints, level.tables)


# -- refinement -----------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """What each part takes at most of each constraint, the shares it should hold, and the most that meets the target: (part, constraint)."""

    caps: np.ndarray
    shares: np.ndarray
    most: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.caps)


def limits(level: Level, shares: tuple[float, ...], imbalance: float, spare: list[int] | None = None) -> Limits:
    """Caps of (1 + imbalance) times the shares, rounded up, and ``spare`` of each weight beyond that; a target is met within one node's weight."""
    want = np.outer(np.array(shares), np.array(level.totals[1], np.float64))
    most = np.floor(want * (1 + imbalance) + np.array(level.totals[2]) + 1e-9).astype(np.int64)
    return Limits(np.ceil(want * (1 + imbalance) - 1e-9).astype(np.int64) + np.array(spare or [0] * level.constraints), want, most)


def sizes_of(level: Level, assigned: DataFrame, parts: int) -> np.ndarray:
    """(part, constraint): the weights that parts hold."""
    out = np.zeros((parts, level.constraints), np.int64)
    for r in assigned.join(level.nodes, "cell").groupBy("part").agg(*[F.sum(w).alias(w) for w in level.ws]).collect():  # a row for each part
        out[r["part"]] = [r[w] for w in level.ws]
    return out


def in_class(gain: Column, cell: str, salt: int) -> Column:
    """The lot of a move: lots of large gains come first, then of small ones, of none, and of losses."""
    half = CLASSES // 2
    step = F.least(F.floor(F.log2(F.abs(gain).cast("double") + 1) * 2), F.lit(half - 1))
    return (F.when(gain > 0, half - 1 - step).otherwise(half + step) * CLASS_LOTS + F.pmod(F.xxhash64(cell, F.lit(salt)), F.lit(CLASS_LOTS))).cast("int")


def moved(level: Level, assigned: DataFrame, asks: DataFrame, by: list[str], room: DataFrame, parts: int) -> tuple[DataFrame, np.ndarray]:
    """``assigned`` after the lots of ``asks`` (cell, from, to, lot, w...) that fit ``room`` (by..., r0, ...) and cells of the next lot that still fit, and the change of sizes."""
    ws = level.ws
    demand = asks.groupBy(*by, "lot").agg(*[F.sum(w).alias(w) for w in ws]).join(F.broadcast(room), by)
    upto = Window.partitionBy(*by).orderBy("lot").rowsBetween(Window.unboundedPreceding, 0)  # CLASSES * CLASS_LOTS rows at most
    sums = demand.withColumns({f"u{c}": F.sum(w).over(upto) for c, w in enumerate(ws)})
    whole = both([F.col(f"u{c}") <= F.col(f"r{c}") for c in range(len(ws))])
    begun = both([F.col(f"u{c}") - F.col(w) <= F.col(f"r{c}") for c, w in enumerate(ws)])
    lots = level.tables.kept(sums.where(begun).select(*by, "lot", whole.alias("whole"), *[(F.col(f"r{c}") - F.col(f"u{c}") + F.col(w)).alias(f"left{c}") for c, w in enumerate(ws)]))
    goes = asks.join(lots.where("whole").select(*by, "lot"), [*by, "lot"]).select("cell", "from", "to", *ws)
    one_by_one = Window.partitionBy(*by).orderBy(F.xxhash64("cell"), "cell").rowsBetween(Window.unboundedPreceding, 0)  # the cells of one lot
    last = asks.join(F.broadcast(lots.where("not whole").drop("whole")), [*by, "lot"])  # a row for each room
    fits = both([F.sum(w).over(one_by_one) <= F.col(f"left{c}") for c, w in enumerate(ws)])
    went = level.tables.kept(goes.unionByName(last.withColumn("fits", fits).where("fits").select("cell", "from", "to", *ws)))
    change = np.zeros((parts, level.constraints), np.int64)
    for r in went.groupBy("from", "to").agg(*[F.sum(w).alias(w) for w in ws]).collect():  # a row for each pair of parts that touch
        change[r["to"]] += [r[w] for w in ws]
        change[r["from"]] -= [r[w] for w in ws]
    if not change.any():
        return assigned, change
    return level.tables.kept(assigned.join(went.select("cell", "to"), "cell", "left").select("cell", F.coalesce("to", "part").alias("part"))), change


def pulls(level: Level, assigned: DataFrame, wanted: Column) -> DataFrame:
    """(cell, part, stay, best: (pull, h, to)): a cell's weight to its own part, and to the one it is drawn to most of those ``wanted``."""
    rows = level.beside(level.beside(level.dealt_edges, "dst", assigned, part="to"), "src", assigned, part="part")
    sums = rows.where((F.col("to") == F.col("part")) | wanted).groupBy(F.col("src").alias("cell"), "part", "to").agg(F.sum("w").alias("pull"))
    other = F.col("to") != F.col("part")
    return sums.groupBy("cell", "part").agg(F.sum(F.when(~other, F.col("pull")).otherwise(0)).alias("stay"), F.max(F.when(other, F.struct("pull", F.xxhash64("cell", "to").alias("h"), "to"))).alias("best")).where("best is not null")


def room_table(level: Level, rows: list[tuple], by: list[str]) -> DataFrame:
    kinds = ", ".join([*(f"{c} int" for c in by), *(f"r{c} long" for c in range(level.constraints))])
    return level.nodes.sparkSession.createDataFrame(rows, kinds)


def refined_level(level: Level, assigned: DataFrame, bounds: Limits, rounds: int, seed: int) -> DataFrame:
    """``assigned`` (cell, part) with a smaller cut; no part takes more than its room."""
    sizes, parts, idle = sizes_of(level, assigned, bounds.parts), bounds.parts, 0
    for k in range(rounds):
        draw = np.random.default_rng([seed, k])
        takes = draw.permutation(parts) < max(1, parts // 2)
        room = np.maximum(bounds.caps - sizes, 0)
        takes &= room.all(1)
        if not takes.any():
            takes = room.all(1)
            takes &= draw.random(parts) < 0.5
        flags = literal(takes.astype(int).tolist(), "int")
        at = lambda c: F.element_at(flags, F.col(c) + 1) == 1
        found = pulls(level, assigned, at("to") & ~at("part")).where("best.pull > stay")
        gain = F.col("best.pull") - F.col("stay")
        asks = level.tables.kept(found.select("cell", F.col("part").alias("from"), F.col("best.to").alias("to"), in_class(gain, "cell", k).alias("lot")).join(level.nodes, "cell"))
        table = room_table(level, [(p, *map(int, room[p])) for p in range(parts) if takes[p]], ["to"])
        assigned, change = moved(level, assigned, asks, ["to"], table, parts)
        sizes += change
        idle = 0 if change.any() else idle + 1
        if idle == 2:
            break
    return assigned


# -- balance --------------------------------------------------------------------


def flows(sizes: np.ndarray, want: np.ndarray, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """How much goes over each pair of touching parts to give each its wanted size, with the least sum of squares; positive: from the first."""
    n = len(sizes)
    laplace = np.zeros((n, n))
    for a, b in pairs:
        laplace[a, a] += 1
        laplace[b, b] += 1
        laplace[a, b] -= 1
        laplace[b, a] -= 1
    height = np.linalg.lstsq(laplace, sizes - want, rcond=None)[0]
    return {(a, b): float(height[a] - height[b]) for a, b in pairs}


#: Parts whose flows are solved as one dense system; with more, each pair of parts evens out what it differs by.
DENSE = 1500


def balanced(level: Level, assigned: DataFrame, bounds: Limits, seed: int, rounds: int = 12, told: list | None = None) -> DataFrame:
    """``assigned`` with every part within its cap, or within one node's weight of it.

    Each round solves the flows of the constraint that is exceeded most and lets boundary cells, those with the least loss
    first, carry them; no pair of parts passes more than its flow. Where parts don't touch, or after ``rounds``, cells of the
    parts that are too large go to parts with room, wherever they lie, until nothing moves any more. ``told`` gets (what is too much before the round, what
    moved, the sum of flows).
    """
    slack = np.array(level.totals[2])
    total = np.maximum(np.array(level.totals[1]), 1)
    sizes = sizes_of(level, assigned, bounds.parts)
    for k in itertools.count():
        over = np.maximum(sizes - bounds.most, 0) / total
        if not over.any():
            break
        c = int(over.sum(0).argmax())
        rows = level.beside(level.beside(level.dealt_edges, "dst", assigned, part="to"), "src", assigned, part="from")
        sums = level.tables.kept(rows.groupBy(F.col("src").alias("cell"), "from", "to").agg(F.sum("w").alias("pull")))  # one pass over the edges for flows and moves
        touching = sums.where(F.col("from") < F.col("to")).select("from", "to").distinct()
        pairs = [(r["from"], r["to"]) for r in touching.collect()]  # a row for each pair of parts that touch
        want = bounds.shares[:, c] * sizes[:, c].sum() / max(bounds.shares[:, c].sum(), 1)
        flow = flows(sizes[:, c], want, pairs) if bounds.parts <= DENSE else {(a, b): (sizes[a, c] - want[a] - sizes[b, c] + want[b]) / 4 for a, b in pairs}
        directed = {(a, b) if f > 0 else (b, a): abs(f) for (a, b), f in flow.items()}
        # as many whole nodes as come nearest to the flow
        carried = {pair: whole for pair, f in directed.items() if (whole := math.floor(f + slack[c] / 2)) > 0}
        room = [(a, b, *[f if x == c else int(total[x]) for x in range(level.constraints)]) for (a, b), f in carried.items()]
        change = np.zeros_like(sizes)
        if room and k < rounds:
            table = room_table(level, room, ["from", "to"])
            stays = sums.groupBy("cell").agg(F.sum(F.when(F.col("from") == F.col("to"), F.col("pull")).otherwise(0)).alias("stay"))
            open_ = sums.join(F.broadcast(table.select("from", "to")), ["from", "to"]).join(stays, "cell")
            best = open_.groupBy("cell", "from").agg(F.max(F.struct((F.col("pull") - F.col("stay")).alias("gain"), F.xxhash64("cell", "to", F.lit(k)).alias("h"), "to")).alias("m"))
            asks = level.tables.kept(best.select("cell", "from", F.col("m.to").alias("to"), in_class(F.col("m.gain"), "cell", k).alias("lot")).join(level.nodes, "cell"))
            assigned, change = moved(level, assigned, asks, ["from", "to"], table, bounds.parts)
        if not change.any():
            assigned, change = forced(level, assigned, bounds, sizes, seed + k)
        if told is not None:
            told.append((float(over.max()), int(np.abs(change[:, c]).sum() // 2), float(sum(directed.values()))))
        sizes = sizes + change
        if not change.any():
            break
    return assigned


def forced(level: Level, assigned: DataFrame, bounds: Limits, sizes: np.ndarray, seed: int) -> tuple[DataFrame, np.ndarray]:
    """``assigned`` after cells of parts that are too large, drawn by a hash, went to parts with room, whether or not they touch."""
    room = np.maximum(bounds.caps - sizes, 0)
    over = np.maximum(sizes - np.minimum(bounds.caps, bounds.most), 0)
    givers, takers = np.flatnonzero(over.any(1)), np.flatnonzero(room.all(1))
    if not len(takers):
        return assigned, np.zeros_like(sizes)
    ends = np.cumsum(room[takers].sum(1)) / room[takers].sum()
    draw = F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    to = F.element_at(literal(takers.tolist(), "int"), F.size(F.filter(literal(ends[:-1].tolist(), "double"), lambda e: e <= draw)) + 1)
    asks = assigned.where(F.col("part").isin([int(p) for p in givers])).select("cell", F.col("part").alias("from"), to.alias("to"), F.pmod(F.xxhash64("cell", F.lit(seed + 1)), F.lit(CLASSES * CLASS_LOTS)).cast("int").alias("lot")).join(level.nodes, "cell")
    heavy = over[givers].sum()
    rows = [(int(a), int(b), *[int(min(over[a, c] * max(room[b, c], 1) / max(room[takers, c].sum(), 1), room[b, c] * over[a, c] / max(over[givers, c].sum(), 1)) + level.totals[2][c]) if over[a, c] else int(room[b, c]) for c in range(level.constraints)]) for a in givers for b in takers] if heavy else []
    return moved(level, assigned, level.tables.kept(asks), ["from", "to"], room_table(level, rows, ["from", "to"]), bounds.parts) if rows else (assigned, np.zeros_like(sizes))


# -- all levels -----------------------------------------------------------------


@dataclass(frozen=True)
class Effort:
    """How coarse levels are made (``matched`` or ``clustered``), rounds of refinement at each level, tries at the coarsest, whether parts are refined there all together, and how strictly sizes are kept (0: to the shares)."""

    coarsen: str = "matched"
    rounds: int = 4
    tries: int = 4
    together: bool = True
    strict: bool = False


def coarsest_bound(parts: int) -> int:
    return max(1, min(COARSEST, COARSEST_SUMS // parts))


def too_large(level: Level, bound: int, parts: int = 0) -> bool:
    """Whether the driver can't hold the graph; one with few nodes for each of ``parts`` isn't contracted for its edges."""
    n = level.totals[0]
    return n > bound or n > 4 * parts and level.crowded


def multilevel(level: Level, shares: tuple[float, ...], imbalance: float, effort: Effort, seed: int) -> DataFrame:
    """(cell, part) of every node of the level."""
    parts, levels, maps = len(shares), [level], []
    bound = coarsest_bound(parts)
    while too_large(levels[-1], bound, parts):
        here = levels[-1]
        goal = min(bound, max(2 * parts, here.totals[0] // 2))
        caps = [max(2 * biggest if len(levels) == 1 else biggest, math.ceil(3 * total / goal)) for total, biggest in zip(here.totals[1], here.totals[2], strict=True)]
        for coarsen in (clustered, matched) if effort.coarsen == "clustered" else (matched, clustered):
            roots = level.tables.kept(coarsen(here, caps, seed + len(levels)))
            after = contracted(here, roots)
            if after.totals[0] <= STALLED * here.totals[0]:
                break
        else:
            break
        maps.append(roots)
        levels.append(after)
    allowed = 0.0 if effort.strict else imbalance
    spare = [w // 2 for w in level.totals[2]]  # within one cell's weight of the target
    assigned = first_parts(levels[-1], limits(levels[-1], shares, allowed, spare), shares, effort, seed, bound)
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        if k < len(levels) - 1:
            assigned = level.tables.kept(maps[k].join(assigned.withColumnRenamed("cell", "root"), "root").select("cell", "part"))
        if k < len(levels) - 1 or too_large(here, bound):
            assigned = refined_level(here, assigned, limits(here, shares, allowed, spare), effort.rounds, seed + k)
    return balanced(level, assigned, limits(level, shares, allowed), seed)


def first_parts(level: Level, bounds: Limits, shares: tuple[float, ...], effort: Effort, seed: int, bound: int) -> DataFrame:
    """(cell, part) of the coarsest level: by the driver, or in runs along the ids if it has too many nodes for that."""
    spark, n = level.nodes.sparkSession, level.totals[0]
    if too_large(level, bound):
        lots = min(n, 64 * len(shares))
        sums = level.nodes.groupBy(F.pmod(F.xxhash64("cell"), F.lit(lots)).alias("lot")).agg(F.sum("w0").alias("w"))
        before = (F.sum("w").over(Window.orderBy("lot")) - F.col("w") / 2) / F.lit(float(max(1, level.totals[1][0])))  # a row for each lot
        ends = literal(np.cumsum(shares)[:-1].tolist(), "double")
        part = F.size(F.filter(ends, lambda e: e <= F.col("at")))
        table = sums.withColumn("at", before).select("lot", part.cast("int").alias("part"))
        rows = level.nodes.select("cell", F.pmod(F.xxhash64("cell"), F.lit(lots)).alias("lot")).join(table, "lot").select("cell", "part")
        return balanced(level, level.tables.kept(rows), bounds, seed)
    nodes = level.nodes.orderBy("cell").toPandas()  # COARSEST nodes at most
    ids = nodes["cell"].to_numpy()
    edges = level.edges.toPandas()
    graph = coarse.Graph.of(np.searchsorted(ids, edges["src"].to_numpy()), np.searchsorted(ids, edges["dst"].to_numpy()), edges["w"].to_numpy(), nodes[level.ws].to_numpy())
    part = coarse.partitioned(graph, np.array(shares), bounds.caps, effort.tries, effort.together, seed)
    kind = "cell long, part int"
    return level.tables.kept(spark.createDataFrame(list(zip(ids.tolist(), part.tolist(), strict=True)), kind))
