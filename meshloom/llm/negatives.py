"""Hard negatives by one-dimensional distance keys: an exact search by inner product.

Vectors of whole numbers get one more component, sqrt(M * M - |x| * |x|) with M the greatest
length; then the nearest vectors of a query (extended by 0) are those with the greatest inner
products. PIVOTS at most are fitted on a bounded sample (SAMPLE rows). Every vector is stored
under the key (pivot, distance to it) with its nearest pivot, sorted by it, and the distances
of each pivot are cut into intervals, cells, at their quantiles.

By the triangle inequality a vector of a cell is no nearer to a query than the query's own
distance to the pivot is to the cell's interval. Each query scans cells from the nearest on
(annuli around all pivots), a quota of rows in each round and GROWTH times as much in the
next. It is done when no cell that is left can hold a vector nearer than the last of its list:
that certifies the list, whatever the sample and the pivots were. There is no cap on rounds,
cells or candidates; data without structure are scanned in whole.

Queries go in chunks of CHUNK, cells in blocks of BLOCK rows, so a task compares two bounded
matrices at a time, however many rows share a cell (equal vectors). It keeps lists for one
chunk only. Between rounds, lists and visited cells are tables in the shared folder.

Lists that are searched have bounds of their score: positives none, the negatives of a
positive the range of its score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import tables_in_between, written

#: Rows on which pivots are fitted, and the most pivots and intervals of each.
SAMPLE, PIVOTS, INTERVALS = 4096, 128, 32
#: Rows in a block of a cell, queries in a chunk, rows that a query scans in the first round, and how much more in each next one.
BLOCK, CHUNK, FIRST, GROWTH = 2048, 512, 2048, 8


@dataclass(frozen=True)
class Space:
    """What is known of all vectors: how many, their dimension, the greatest square length, the type that holds components, and the pivots."""

    rows: int
    dim: int
    longest: int
    kind: str
    pivots: np.ndarray  # (pivots, dim + 1)

    def distances(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """From each vector to each pivot."""
        x = vectors.astype(np.float64)
        square = (x * x).sum(1)
        last = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.longest - square, 0))
        full = square + last * last
        inner = x @ self.pivots[:, : self.dim].T + np.outer(last, self.pivots[:, self.dim])
        return np.sqrt(np.maximum(full[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * inner, 0))

    def unpacked(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim)


@dataclass(frozen=True)
class Cells:
    """The cells' pivots, intervals of distance, numbers of rows and of blocks."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray


def whole(vectors: DataFrame, key: str, vector: str, label: str, scale: float, anchor: Column) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part, components as whole numbers."""
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fit
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(good).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def matrix(column: pa.Array, dim: int, kind: str = "<i8") -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), kind)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def space_of(rows: DataFrame) -> Space:
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    widest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    row = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("longest"), F.max(widest).alias("top")).first()
    dim, top = max(1, row["dim"] or 0), row["top"] or 0
    if dim * top * top >= 1 << 62:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    space = Space(row["n"], dim, int(math.ceil((row["longest"] or 0) * (1 + 1e-12))), kind, np.zeros((0, dim + 1)))
    sample = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    x = matrix(sample.column("v").combine_chunks(), dim).astype(np.float64)
    x = np.concatenate([x, np.sqrt(np.maximum(space.longest - (x * x).sum(1), 0))[:, None]], 1)
    many = min(PIVOTS, max(1, math.isqrt(space.rows) // 8), max(1, len(x)))
    return Space(space.rows, dim, space.longest, kind, centers(x, many))


def centers(x: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Means of clusters of the sample, from rows far from one another."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    picked, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < many:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    means = x[picked]
    for _ in range(rounds):
        near = ((means**2).sum(1)[None, :] - 2 * x @ means.T).argmin(1)
        counts = np.bincount(near, minlength=many)
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def keyed(rows: DataFrame, space: Space) -> DataFrame:
    """(pivot, distance, id, label, v, anchor): v as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), space.dim)
            far = space.distances(v)
            pivot = far.argmin(1)
            raw = [r.tobytes() for r in v.astype(space.kind)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(v)), pivot]), batch.column("id"), batch.column("label"), pa.array(raw, pa.binary()), batch.column("anchor")], names=["pivot", "distance", "id", "label", "v", "anchor"])

    return rows.mapInArrow(work, "pivot int, distance double, id long, label long, v binary, anchor boolean")


def in_rows(rows: DataFrame, size: int, kinds: str, same: list[str]) -> DataFrame:
    """Runs of at most ``size`` rows that agree in ``same``, each as one row: (same..., run, ids, labels, v) as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, task = 0, TaskContext.get().partitionId()
        own, ids, labels, vs = None, [], [], []

        def close() -> pa.RecordBatch:
            made = [[c] for c in own] + [[(task << 32) + run], [np.array(ids, "<i8").tobytes()], [np.array(labels, "<i8").tobytes()], [b"".join(vs)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, [*[pa.int32()] * len(same), pa.int64(), *[pa.binary()] * 3], strict=True)], names=[*same, "run", "ids", "labels", "v"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in same], strict=True) if same else iter(lambda: (), None)
            for key, i, label, v in zip(keys, batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=bool(same)):
                if own is not None and (key != own or len(ids) == size):
                    yield close()
                    run += 1
                    ids, labels, vs = [], [], []
                own = key
                ids.append(i)
                labels.append(label)
                vs.append(v)
        if ids:
            yield close()

    return rows.mapInArrow(work, f"{kinds}run long, ids binary, labels binary, v binary")


def stored_index(table: DataFrame, space: Space) -> tuple[DataFrame, Cells]:
    """The index (cell, block, run, ids, labels, v), sorted by (pivot, distance), and its cells."""
    many = min(INTERVALS, max(4, len(space.pivots) // 4))
    cuts = table.groupBy("pivot").agg(F.percentile_approx("distance", [k / many for k in range(1, many)], 10 * many).alias("cuts")).collect()  # a row for each pivot
    bounds = {r["pivot"]: sorted(set(r["cuts"] or [])) for r in cuts}
    longest = max([1, *map(len, bounds.values())])
    at = F.element_at(F.from_json(F.lit(json.dumps([bounds.get(p, []) for p in range(len(space.pivots))])), "array<array<double>>"), F.col("pivot") + 1)
    cell = (F.col("pivot") * (longest + 1) + F.size(F.filter(at, lambda b: b <= F.col("distance")))).cast("int")
    dealt = table.select(cell.alias("cell"), "distance", "id", "label", "v")
    stats = sorted(map(tuple, dealt.groupBy("cell").agg(F.min("distance"), F.max("distance"), F.count("*")).collect()))  # PIVOTS * INTERVALS rows at most
    number, low, high, rows = (np.array(c) for c in zip(*stats, strict=True))
    cells = Cells(number // (longest + 1), low.astype(float), high.astype(float), rows, -(-rows // BLOCK))
    of = [0] * (len(space.pivots) * (longest + 1))
    blocks = [1] * len(of)
    for k, (c, b) in enumerate(zip(number.tolist(), cells.blocks.tolist(), strict=True)):
        of[c], blocks[c] = k, b
    look = lambda values: F.element_at(F.from_json(F.lit(str(values)), "array<int>"), F.col("cell") + 1)
    spread = dealt.select(look(of).alias("cell"), F.pmod(F.monotonically_increasing_id(), look(blocks)).cast("int").alias("block"), "distance", "id", "label", "v")
    ordered = spread.repartition("cell", "block").sortWithinPartitions("cell", "block", "distance", "id")
    return written(in_rows(ordered, BLOCK, "cell int, block int, ", ["cell", "block"]), "annuli"), cells


def names(chunks: DataFrame) -> DataFrame:
    """(chunk, q, anchor_id) of every query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<i8") for x in batch.column("qids").to_pylist()]
            sizes = [len(x) for x in ids]
            q = np.concatenate([*map(np.arange, sizes), np.zeros(0, int)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("chunk").to_numpy(), sizes)), pa.array(q), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], names=["chunk", "q", "anchor_id"])

    return chunks.select("chunk", "qids").mapInArrow(work, "chunk long, q int, anchor_id long")


def state_rows(batch: pa.RecordBatch, space: Space) -> Iterator[tuple]:
    """Of each row its chunk's (vectors, ids, labels) and lists: (query, j, most, least, last score or None) as arrays."""
    lists = batch.column("lists")
    for k in range(batch.num_rows):
        own = lists[k].values
        fields = [own.field(c).to_numpy(zero_copy_only=False) for c in ("q", "j", "most", "least", "last", "full")] if own is not None else [np.zeros(0, np.int64)] * 6
        vectors = space.unpacked(batch.column("qv")[k].as_py())
        yield k, vectors, np.frombuffer(batch.column("qids")[k].as_py(), "<i8"), np.frombuffer(batch.column("qlabels")[k].as_py(), "<i8"), fields


#: No bound of a score.
NONE = 1 << 62


def planned(state: DataFrame, space: Space, cells: Cells, quota: int) -> DataFrame:
    """(chunk, cell, block, some): the queries (positions in the chunk) that scan a cell in this round; cell -1 has the cells visited by then."""
    margin = 1e-6 * (1 + math.sqrt(max(space.longest, 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v, _, _, (q, _, most, least, last, full) in state_rows(batch, space):
                chunk, seen = batch.column("chunk")[k].as_py(), batch.column("visited")[k].as_py()
                n, m = len(v), len(cells.rows)
                visited = np.unpackbits(np.frombuffer(seen, np.uint8), axis=None).reshape(n, -1)[:, :m].astype(bool) if seen is not None else np.zeros((n, m), bool)
                square = (v.astype(np.float64) ** 2).sum(1)
                far = lambda s, s2: np.sqrt(np.maximum(space.longest + s2 - 2 * s.astype(np.float64), 0))
                reach = np.where(full, far(last, square[q]), np.where(least > -NONE, far(least, square[q]), np.inf))
                reach = np.where(least > -NONE, np.minimum(reach, far(least, square[q])), reach)
                outer, inner = np.full(n, -1.0), np.full(n, np.inf)
                np.maximum.at(outer, q, reach)
                np.minimum.at(inner, q, np.where(most < NONE, far(most, square[q]), 0.0))
                at = space.distances(v, queries=True)[:, cells.pivot]
                near = np.maximum(np.maximum(at - cells.high, cells.low - at), 0)
                open_ = ~visited & (near <= outer[:, None] + margin) & (at + cells.high >= inner[:, None] - margin)
                near = np.where(open_, near, np.inf)
                order = np.argsort(near, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(np.where(open_, cells.rows, 0), order, 1), 1)
                before = np.concatenate([np.zeros((n, 1)), before[:, :-1]], 1)
                now = np.zeros((n, m), bool)
                np.put_along_axis(now, order, before < quota, 1)
                now &= open_
                rows = [(chunk, -1, -1, np.packbits(visited | now, axis=1).tobytes())]
                for c in np.flatnonzero(now.any(0)).tolist():
                    some = np.flatnonzero(now[:, c]).astype("<i4").tobytes()
                    rows += [(chunk, c, b, some) for b in range(int(cells.blocks[c]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["chunk", "cell", "block", "some"])

    return state.mapInArrow(work, "chunk long, cell int, block int, some binary")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def firsts(s: np.ndarray, ids: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k that fit in each row, by score descending and id ascending (columns are in the order of ids)."""
    rows, columns = np.nonzero(fit)
    if not len(rows):
        return rows, columns
    counts = np.bincount(rows, minlength=len(s))
    for r in np.flatnonzero(counts > 8 * k).tolist():  # what is below the k-th score can't be among them
        own = np.where(fit[r])[0]
        last = np.partition(s[r, own], len(own) - k)[len(own) - k]
        fit[r, own[s[r, own] < last]] = False
    rows, columns = np.nonzero(fit)
    order = np.lexsort((columns, -s[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], columns[place < k]


def scanned(pairs: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """(chunk, q, j, s, id): what a task has found for each list, k at most for each list and stay of its chunk in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, best = None, {}

        def told() -> pa.RecordBatch:
            rows = [(chunk, q, j, s, i) for (q, j), found in best.items() for s, i in found]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["chunk", "q", "j", "s", "id"])

        for batch in batches:
            for row, v, ids, labels, (q, j, most, least, last, full) in state_rows(batch, space):
                if chunk != batch.column("chunk")[row].as_py():
                    if best:
                        yield told()
                    chunk, best = batch.column("chunk")[row].as_py(), {}
                some = np.frombuffer(batch.column("some")[row].as_py(), "<i4")
                their = np.frombuffer(batch.column("ids")[row].as_py(), "<i8")
                order = np.argsort(their, kind="stable")
                their, label = their[order], np.frombuffer(batch.column("labels")[row].as_py(), "<i8")[order]
                s = scores(v[some], space.unpacked(batch.column("v")[row].as_py())[order])
                alike = labels[some][:, None] == label[None, :]
                mine = alike & (ids[some][:, None] != their[None, :]) if same else ~alike
                place = np.full(len(v), -1)
                place[some] = np.arange(len(some))
                for turn in np.unique(j).tolist():
                    use = np.flatnonzero((j == turn) & (place[q] >= 0))
                    at = place[q[use]]
                    floor = np.where(full[use], np.maximum(last[use], least[use]), least[use])
                    fit = mine[at] & (s[at] <= most[use][:, None]) & (s[at] >= floor[:, None])
                    r, c = firsts(s[at], their, fit, k)
                    for x, y, value in zip(q[use][r].tolist(), their[c].tolist(), s[at][r, c].tolist(), strict=True):
                        best.setdefault((x, turn), []).append((value, y))
                for name, found in best.items():
                    if len(found) > 4 * k:
                        best[name] = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        best = {name: sorted(found, key=lambda f: (-f[0], f[1]))[:k] for name, found in best.items()}
        if best:
            yield told()

    return pairs.mapInArrow(work, "chunk long, q int, j int, s long, id long")


FOUND = "array<struct<less:bigint,id:bigint>>"


def searched(index: DataFrame, chunks: DataFrame, asked: DataFrame, space: Space, cells: Cells, same: bool, k: int, told: Callable[[int, int], None] | None = None) -> DataFrame:
    """``asked`` (chunk, q, j, most, least) with ``found``: the first k by score of (minus the score, id) within the bounds, certified.

    ``same``: among other rows of the query's label, else among those of other labels. ``told`` gets the round and the pairs
    of chunk and block in it.
    """
    lists = written(asked.withColumn("found", F.array().cast(FOUND)), "lists")
    visited, quota = None, FIRST
    while True:
        last = F.when(F.size("found") == k, -F.element_at("found", -1)["less"]).otherwise(0)
        own = lists.groupBy("chunk").agg(F.collect_list(F.struct("q", "j", "most", "least", last.alias("last"), (F.size("found") == k).alias("full"))).alias("lists"))  # the lists of CHUNK queries
        state = chunks.join(own, "chunk")
        state = written(state.join(visited, "chunk", "left") if visited is not None else state.withColumn("visited", F.lit(None).cast("binary")), "state")
        plan = written(planned(state, space, cells, quota), "plan")
        pairs = plan.where("cell >= 0")
        if told:
            told(quota, pairs.count())
        if pairs.isEmpty():
            return lists
        visited = plan.where("cell < 0").select("chunk", F.col("some").alias("visited"))
        both = pairs.join(index.drop("run"), ["cell", "block"]).join(state.drop("visited"), "chunk").sortWithinPartitions("chunk")
        new = scanned(both, space, same, k).groupBy("chunk", "q", "j").agg(F.collect_list(F.struct((-F.col("s")).alias("less"), "id")).alias("new"))  # k for each task
        merged = F.slice(F.sort_array(F.concat("found", F.coalesce("new", F.array().cast(FOUND)))), 1, k)
        lists = written(lists.join(new, ["chunk", "q", "j"], "left").select("chunk", "q", "j", "most", "least", merged.alias("found")), "lists")
        quota *= GROWTH


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label", told: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each row where ``anchor`` holds.

    A component x counts as floor(scale * x); a score is an inner product. Positives: the first other rows of the anchor's
    label. Negatives of a positive: the first rows of other labels with low * positive <= 100 * negative <= high * positive.
    Higher scores first, ties by smaller id. Anchors without positives, and positives without negatives, have no rows.

    Rows without a key, label or vector, or with a null or non-finite component, take no part. Shorter vectors are filled with
    0. Rows that repeat a key are rows of their own, but none is a positive of its own key. Inner products beyond 62 bits are
    an error. An empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    spark = vectors.sparkSession
    with tables_in_between(spark):
        rows = whole(vectors, key, vector, label, scale, anchor)
        space = space_of(rows)
        if not space.rows:
            return spark.createDataFrame([], RESULT)
        table = written(keyed(rows, space), "keys")
        index, cells = stored_index(table, space)
        ordered = table.where("anchor").select("pivot", "distance", "id", "label", "v")
        spread = max(1, -(-ordered.count() // CHUNK))
        near = ordered.repartitionByRange(spread, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
        chunks = written(in_rows(near, CHUNK, "", []).select(F.col("run").alias("chunk"), F.col("ids").alias("qids"), F.col("labels").alias("qlabels"), F.col("v").alias("qv")), "chunks")
        free = names(chunks).select("chunk", "q", F.lit(0).alias("j"), F.lit(NONE).alias("most"), F.lit(-NONE).alias("least"))
        liked = searched(index, chunks, free, space, cells, True, positives, told)
        pairs = liked.select("chunk", "q", F.posexplode("found").alias("j", "p")).select("chunk", "q", "j", F.col("p.id").alias("positive_id"), (-F.col("p.less")).alias("positive_score"))
        share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
        most, least = F.floor(share(high)).cast("long"), F.ceil(share(low)).cast("long")
        wanted = pairs.where(share(low) <= share(high)).select("chunk", "q", "j", most.alias("most"), least.alias("least"))
        disliked = searched(index, chunks, wanted, space, cells, False, negatives, told)
        found = disliked.select("chunk", "q", "j", F.posexplode("found").alias("rank", "n"))
        made = found.join(pairs, ["chunk", "q", "j"]).join(names(chunks), ["chunk", "q"])
        out = made.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.less")).alias("negative_score"))
        return written(out, "negatives", keep=True)
