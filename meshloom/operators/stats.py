"""Weights of test configurations, and the quality of a partition."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators.graph import DualGraph
from meshloom.operators.partitioners import Target, partition
from meshloom.operators.tables import Tables, large


def weight_column(kind: str, key: Column, seed: int = 123) -> Column | None:
    """A weight for each vertex or edge: none, uniform (1), random (1..1000, from the key and the seed), increasing (key + 1)."""
    if kind == "none":
        return None
    if kind == "uniform":
        return F.lit(1).cast("long")
    if kind == "random":  # two steps of a linear congruence, whose high bits count
        step = lambda x: F.pmod(x * F.lit(1103515245) + F.lit(12345), F.lit(1 << 31))
        drawn = step(F.pmod(step(F.pmod(key.cast("long") + F.lit(seed), F.lit(1 << 31))) * F.lit(69069), F.lit(1 << 31)))
        return (F.floor(drawn / F.lit(1 << 12)) % 1000 + 1).cast("long")
    if kind == "increasing":
        return (key + 1).cast("long")
    raise ValueError(f"{kind} is no kind of weight")


def node_weights(kind: str, parts: int, seed: int = 123) -> list[float]:
    """Shares of the parts, adding up to 1; empty: uniform."""
    if kind == "none":
        return []
    if kind == "uniform":
        raw = [1.0] * parts
    elif kind == "harmonic":
        raw = [1.0 / (i + 1) for i in range(parts)]
    elif kind == "random":
        import random

        draw = random.Random(seed)
        raw = [float(draw.randint(1, 1000)) for _ in range(parts)]
    else:
        raise ValueError(f"{kind} is no kind of weight")
    total = sum(raw)
    return [w / total for w in raw]


def every_part(graph: DualGraph, parts: int) -> DataFrame:
    return graph.mesh.raw_cells.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))


def size_rows(graph: DualGraph, partition: DataFrame | None) -> DataFrame:
    """(part, size, size_weighted) of parts with cells."""
    cells = graph.weighted_vertices()
    cells = cells if partition is None else large(cells.select("cell", "w")).join(partition.select("cell", "part"), "cell")
    return cells.groupBy("part").agg(F.count("*").alias("size"), F.sum("w").alias("size_weighted"))


def part_sizes(graph: DualGraph, partition: DataFrame | None, parts: int) -> DataFrame:
    """(part, size, size_weighted) of every part, empty ones included; ``partition``: (cell, part), None: the mesh's own."""
    return every_part(graph, parts).join(size_rows(graph, partition), "part", "left").fillna(0)


def cut_edges(graph: DualGraph, partition: DataFrame | None) -> DataFrame:
    """(part, nbr_part, w) of every directed edge between parts; edges know the mesh's own parts."""
    if partition is None:
        return graph.weighted_edges().where("part <> dst_part").select("part", F.col("dst_part").alias("nbr_part"), "w")
    side = partition.select("cell", "part")
    rows = large(large(graph.adjacency()).join(side.select(F.col("cell").alias("src"), "part"), "src")).join(side.select(F.col("cell").alias("dst"), F.col("part").alias("nbr_part")), "dst")
    return rows.where("part <> nbr_part").select("part", "nbr_part", "w")


def cut_rows(graph: DualGraph, partition: DataFrame | None) -> DataFrame:
    """(part, cut, cut_weighted) of parts that others touch: directed edges that reach each part from another."""
    return cut_edges(graph, partition).groupBy(F.col("nbr_part").alias("part")).agg(F.count("*").alias("cut"), F.sum("w").alias("cut_weighted"))


def part_cut(graph: DualGraph, partition: DataFrame | None, parts: int) -> DataFrame:
    """(part, cut, cut_weighted): directed edges that reach each part from another, also where there is none."""
    return every_part(graph, parts).join(cut_rows(graph, partition), "part", "left").fillna(0)


def cut_matrix(graph: DualGraph, partition: DataFrame | None) -> DataFrame:
    """(nbr_part, part, cut_weighted_detail) of the pairs of parts that touch."""
    return cut_edges(graph, partition).groupBy("nbr_part", "part").agg(F.sum("w").alias("cut_weighted_detail"))


MEASURES = ("size", "size_weighted", "cut", "cut_weighted")


def part_rows(graph: DualGraph, partition: DataFrame | None) -> DataFrame:
    """(part, size, size_weighted, cut, cut_weighted) of parts that aren't empty."""
    both = size_rows(graph, partition).unionByName(cut_rows(graph, partition), allowMissingColumns=True)
    return both.groupBy("part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MEASURES])


def totals(rows: DataFrame, parts: int) -> DataFrame:
    """One row of the ``part_rows``; edges in the cut are counted once, not from both sides."""
    worst = lambda c: F.max(c) / (F.sum(c) / F.lit(parts))
    return rows.agg(
        F.sum("size").alias("total_vertices"),
        F.expr("sum(cut) div 2").alias("cut"), F.expr("sum(cut_weighted) div 2").alias("cut_weighted"),
        worst("size").alias("imbalance"), worst("size_weighted").alias("imbalance_weighted"),
    )


def summary(graph: DualGraph, partition: DataFrame | None, parts: int) -> DataFrame:
    """One row: total_vertices, cut, cut_weighted (of undirected edges), imbalance, imbalance_weighted."""
    return totals(part_rows(graph, partition), parts)


def report(graph: DualGraph, partition: DataFrame | None, parts: int, configuration: dict, measured: dict | None = None) -> DataFrame:
    """One row, ``value``: totals, every part with its row of the cut matrix, the configuration and what was measured, as JSON.

    ``mpi_size`` is the number of parts. ``measured``: as ``timed`` returns it, or nothing.
    """
    detail = cut_matrix(graph, partition).groupBy(F.col("nbr_part").alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("from"), F.col("cut_weighted_detail").alias("w")))).alias("cut_weighted_detail"))  # a struct for each part that touches it
    rows = every_part(graph, parts).join(part_rows(graph, partition), "part", "left").fillna(0).join(detail, "part", "left")
    edges = graph.counts().select("edges")
    whole = rows.agg(*[e.alias(n) for n, e in (("rank_stats", F.sort_array(F.collect_list(F.struct("part", *MEASURES, "cut_weighted_detail")))),)])  # a struct for each part
    said = {"configuration": json.dumps(configuration, sort_keys=True), "mpi_size": parts, **(measured or {})}
    fields = ["total_vertices", "total_edges", "cut", "cut_weighted", "imbalance", "imbalance_weighted", *said, "rank_stats"]
    one = lambda df: df.withColumn("k", F.lit(0))
    made = one(totals(rows, parts)).join(one(whole), "k").join(one(edges.select(F.col("edges").alias("total_edges"))), "k")  # one row each
    return made.withColumns({k: F.lit(v) for k, v in said.items()}).select(F.to_json(F.struct(*fields)).alias("value"))


def measured_together(graph: DualGraph, partitions: dict[str, DataFrame], weightings: dict[str, tuple[str, str]]) -> DataFrame:
    """(partition, weighting, part, size, size_weighted, cut, cut_weighted) of many partitions under many weightings, in one pass over cells and one over edges.

    ``partitions``: (cell, part) by name; ``weightings``: kinds of vertex and edge weights by name (see ``weight_column``). Cells
    carry an array of their parts, edges meet it from both sides, and an edge is expanded only where it is cut. What is combined
    has a row for each partition and part, with a column for each weighting.
    """
    names, kinds = list(partitions), list(weightings)
    each = None
    for k, name in enumerate(names):
        rows = partitions[name].select("cell", F.struct(F.lit(k).alias("k"), F.col("part").cast("int").alias("part")).alias("own"))
        each = rows if each is None else each.unionByName(rows)
    cells = each.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list("own")), lambda x: x["part"]).alias("parts"))  # a number for each partition
    weight = lambda place, key: [F.coalesce(weight_column(weightings[w][place], key), F.lit(1).cast("long")).alias(f"w{i}") if weightings[w][place] != "none" else F.lit(1).cast("long").alias(f"w{i}") for i, w in enumerate(kinds)]
    ws = [f"w{i}" for i in range(len(kinds))]
    own = cells.select(*weight(0, F.col("cell")), F.posexplode("parts").alias("k", "part"))
    sizes = own.groupBy("k", "part").agg(F.count("*").alias("size"), *[F.sum(w).alias(f"s{w}") for w in ws])
    beside = large(graph.edges.select("eid", "src", "dst").join(cells.select(F.col("cell").alias("src"), F.col("parts").alias("a")), "src")).join(cells.select(F.col("cell").alias("dst"), F.col("parts").alias("b")), "dst")
    across = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.get("a", k) != F.get("b", k))
    cut = beside.select(*weight(1, F.col("eid")), "b", F.explode(across).alias("k")).select("k", F.get("b", F.col("k")).alias("part"), *ws)
    cuts = cut.groupBy("k", "part").agg(F.count("*").alias("cut"), *[F.sum(w).alias(f"c{w}") for w in ws])
    both = sizes.join(cuts, ["k", "part"], "left").fillna(0, ["cut", *(f"c{w}" for w in ws)])
    by_kind = F.explode(F.array(*[F.struct(F.lit(name).alias("weighting"), F.col(f"sw{i}").alias("size_weighted"), F.col(f"cw{i}").alias("cut_weighted")) for i, name in enumerate(kinds)]))
    name_of = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return both.select(name_of.alias("partition"), "part", "size", "cut", by_kind.alias("x")).select("partition", "x.weighting", "part", "size", "x.size_weighted", "cut", "x.cut_weighted")


def timed(make: Callable[[], DataFrame]) -> tuple[DataFrame, dict]:
    """(the table, {"time": seconds, "memory": bytes}) of a partition that is computed in full.

    ``memory`` is the largest peak of heap that the driver or any executor has told so far.
    """
    start = time.perf_counter()
    made = make()
    table = Tables(made.sparkSession).kept(made, stay=True)
    took = time.perf_counter() - start
    context = table.sparkSession.sparkContext
    store = context._jsc.sc().statusStore()
    peaks = [x.peakMemoryMetrics().get().getMetricValue("JVMHeapMemory") for x in _listed(store.executorList(False)) if x.peakMemoryMetrics().isDefined()]
    beans = context._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    own = sum(b.getPeakUsage().getUsed() for b in beans if b.getType().toString() == "Heap memory")
    return table, {"time": took, "memory": max([own, *peaks])}


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def harness(graph: DualGraph, settings: list[dict], seed: int = 1) -> Iterator[tuple[dict, DataFrame]]:
    """(configuration, report) of each setting: weights, then the partitioner, then its quality, time and memory.

    Settings: ``partitioner``, ``nparts``, ``imbalance``, and kinds of weights under ``vertex_weights``, ``edge_weights`` and
    ``node_weights``.
    """
    for setting in settings:
        parts = int(setting.get("nparts", graph.mesh.parts))
        own = weight_column(setting.get("vertex_weights", "none"), F.col("gid"))
        weighted = graph.with_vertex_weights(None if own is None else graph.mesh.cells.select(F.col("gid").alias("cell"), own.alias("w")))
        weighted = weighted.with_edge_weights(weight_column(setting.get("edge_weights", "none"), F.col("eid")))
        target = Target(parts, tuple(node_weights(setting.get("node_weights", "none"), parts)), float(setting.get("imbalance", 0.0)))
        found, measured = timed(lambda s=setting, g=weighted, t=target: partition(s.get("partitioner", "none"), g, t, int(s.get("seed", seed))))
        made = report(weighted, found, parts, setting, measured)
        yield setting, Tables(made.sparkSession).kept(made, stay=True)  # one row: together, the plans of many reports would fill the driver


def configurations(arguments: list[str]) -> list[dict]:
    """The product of JSON files and key=value settings: a list multiplies, later settings override earlier ones."""

    def one(argument: str) -> list[dict]:
        if "=" in argument and not Path(argument).exists():
            key, _, value = argument.partition("=")
            try:
                value = json.loads(value)
            except ValueError:
                pass
            return [{key: v} for v in (value if isinstance(value, list) else [value])]
        found = json.loads(Path(argument).read_text())
        return found if isinstance(found, list) else [found]

    def patched(base: dict, patch: dict) -> dict:
        out = dict(base)
        for key, value in patch.items():
            if value is None:
                out.pop(key, None)
            else:
                out[key] = patched(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
        return out

    made = [{}]
    for choices in map(one, arguments):
        made = [patched(base, choice) for base, choice in itertools.product(made, choices)]
    return made
