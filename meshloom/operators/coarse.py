"""The coarsest graph of the multilevel partitioner, of bounded size, in numpy on the driver.

It shrinks to FEW nodes for each part, which are bisected along the tree of the target's
shares: each bisection grows one side from a seed along the heaviest edges and improves both
by moves of single nodes that may get worse for a while (the best state is kept); the best of
several seeds counts. On the way back the same moves run over all parts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Graph:
    """Rows of neighbours: node i has those at start[i]..start[i + 1]; weights (node, constraint)."""

    start: np.ndarray
    to: np.ndarray
    w: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, src: np.ndarray, dst: np.ndarray, w: np.ndarray, weights: np.ndarray) -> Graph:
        order = np.lexsort((dst, src))
        return cls(np.searchsorted(src[order], np.arange(len(weights) + 1)), dst[order], w[order].astype(np.int64), weights.astype(np.int64))

    def within(self, nodes: np.ndarray) -> Graph:
        """The graph of some nodes, numbered anew."""
        number = np.full(len(self.weights), -1)
        number[nodes] = np.arange(len(nodes))
        src = np.repeat(np.arange(len(self.weights)), np.diff(self.start))
        inner = (number[src] >= 0) & (number[self.to] >= 0)
        return Graph.of(number[src[inner]], number[self.to[inner]], self.w[inner], self.weights[nodes])

    def cut(self, part: np.ndarray) -> int:
        src = np.repeat(np.arange(len(part)), np.diff(self.start))
        return int(self.w[part[src] != part[self.to]].sum()) // 2


def excess(sizes: np.ndarray, caps: np.ndarray, total: np.ndarray) -> float:
    return float((np.maximum(sizes - caps, 0) / total).sum())


def improved(graph: Graph, part: np.ndarray, caps: np.ndarray, passes: int = 3) -> np.ndarray:
    """Passes of single moves, each node once: the largest gain first that doesn't add to what exceeds ``caps``; the best state stays."""
    parts, n = len(caps), len(part)
    part, total = part.copy(), np.maximum(graph.weights.sum(0), 1)
    start, to, w, weights = graph.start.tolist(), graph.to, graph.w, graph.weights
    for _ in range(passes):
        src = np.repeat(np.arange(n), np.diff(graph.start))
        pull = np.zeros((n, parts), np.int64)
        np.add.at(pull, (src, part[to]), w)
        sizes = np.zeros((parts, weights.shape[1]), np.int64)
        np.add.at(sizes, part, weights)
        over, gained = excess(sizes, caps, total), 0
        best, best_at, moves, locked = (over, 0), 0, [], np.zeros(n, bool)
        heap, waiting = [], [[] for _ in range(parts)]  # nodes that wait for room in a part

        def offer(v: int, pull: np.ndarray = pull, heap: list = heap) -> None:
            row = pull[v] - pull[v, part[v]]
            row[part[v]] = np.iinfo(np.int64).min
            heapq.heappush(heap, (-int(row.max()), v))

        for v in (np.arange(n) if over else np.unique(src[part[src] != part[to]])).tolist():
            offer(v)
        while heap and len(moves) - best_at < 200 + n // 10:
            less, v = heapq.heappop(heap)
            if locked[v]:
                continue
            own = int(part[v])
            row = pull[v] - pull[v, own]
            row[own] = np.iinfo(np.int64).min
            if -int(row.max()) > less:  # an old offer
                offer(v)
                continue
            if over:
                after = np.maximum(sizes + weights[v] - caps, 0) / total - np.maximum(sizes - caps, 0) / total
                left = (np.maximum(sizes[own] - weights[v] - caps[own], 0) / total - np.maximum(sizes[own] - caps[own], 0) / total).sum()
                change = after.sum(1) + left
                fit = change < -1e-15 if row.max() <= 0 else change <= 1e-15
            else:
                fit = (sizes + weights[v] <= caps).all(1)
            fit[own] = False
            target = int(np.where(fit, row, np.iinfo(np.int64).min).argmax())
            if not fit[target] or row[target] < row.max() and row[target] < 0 and not over:
                if not over:
                    heapq.heappush(waiting[int(row.argmax())], (less, v))
                continue
            locked[v] = True
            moves.append((v, own))
            part[v] = target
            sizes[own] -= weights[v]
            sizes[target] += weights[v]
            gained += int(row[target])
            over = excess(sizes, caps, total) if over else 0.0
            a, b = start[v], start[v + 1]
            np.add.at(pull, (to[a:b], own), -w[a:b])
            np.add.at(pull, (to[a:b], target), w[a:b])
            near = to[a:b][~locked[to[a:b]]]
            rows = pull[near] - pull[near, part[near]][:, None]
            rows[np.arange(len(near)), part[near]] = np.iinfo(np.int64).min
            for gain, u in zip(rows.max(1).tolist(), near.tolist(), strict=True):
                heapq.heappush(heap, (-gain, u))
            for _ in range(min(4, len(waiting[own]))):  # the part they wait for has room now
                heapq.heappush(heap, heapq.heappop(waiting[own]))
            if (over, -gained) < best:
                best, best_at = (over, -gained), len(moves)
        for v, own in reversed(moves[best_at:]):
            part[v] = own
        if not best_at:
            break
    return part


def shrunk(graph: Graph, caps: np.ndarray, seed: int) -> tuple[np.ndarray, Graph]:
    """(the number of each node's new node, the next smaller graph): pairs that pick each other by their heaviest edges, and who follows them."""
    n = len(graph.weights)
    src, to, number = np.repeat(np.arange(n), np.diff(graph.start)), graph.to, np.arange(n)
    fits = (graph.weights[src] + graph.weights[to] <= caps).all(1)
    src, to, w = src[fits], to[fits], graph.w[fits].astype(float)
    load = np.maximum(graph.weights[:, 0], 1)
    draw = np.random.default_rng(seed).random(n)
    order = np.lexsort((draw[src] + draw[to], w * w / (load[src] * load[to]), src))
    last = np.flatnonzero(np.diff(src[order], append=-1))
    pick = np.full(n, -1)
    pick[src[order][last]] = to[order][last]
    paired = (pick >= 0) & (pick[pick] == number)
    root = np.where(paired, np.minimum(number, pick), number)
    follows = np.flatnonzero((pick >= 0) & ~paired & paired[pick])
    heavy = np.zeros_like(graph.weights)
    np.add.at(heavy, root, graph.weights)
    for v in follows.tolist():
        r = root[pick[v]]
        if (heavy[r] + graph.weights[v] <= caps).all():
            heavy[r] += graph.weights[v]
            root[v] = r
    roots, new = np.unique(root, return_inverse=True)
    weights = np.zeros((len(roots), graph.weights.shape[1]), np.int64)
    np.add.at(weights, new, graph.weights)
    a, b = new[np.repeat(np.arange(n), np.diff(graph.start))], new[graph.to]
    keys, at = np.unique((a * len(roots) + b)[a != b], return_inverse=True)
    return new, Graph.of(keys // len(roots), keys % len(roots), np.bincount(at, graph.w[a != b], len(keys)), weights)


def grown(graph: Graph, share: float, seed: int) -> np.ndarray:
    """1 for the nodes of a side that grows from a seed until it has its share of the weight, 0 for the rest."""
    n = len(graph.weights)
    load = (graph.weights / np.maximum(graph.weights.sum(0), 1)).mean(1)
    side, heap, reached = np.zeros(n, np.int64), [(0, seed)], 0.0
    seen = {seed: 0}
    rest = iter(np.random.default_rng(seed).permutation(n).tolist())
    while reached < share:
        while not heap:
            v = next(rest, None)
            if v is None:
                return side
            if not side[v]:
                heap.append((0, v))
        less, v = heapq.heappop(heap)
        if side[v] or less > seen.get(v, 0):
            continue
        if reached + load[v] / 2 > share and reached:
            break
        side[v] = 1
        reached += load[v]
        for u, w in zip(graph.to[graph.start[v] : graph.start[v + 1]].tolist(), graph.w[graph.start[v] : graph.start[v + 1]].tolist(), strict=True):
            if not side[u]:
                seen[u] = seen.get(u, 0) - w
                heapq.heappush(heap, (seen[u], u))
    return side


def bisected(graph: Graph, share: float, caps: np.ndarray, tries: int, seed: int) -> np.ndarray:
    """The best of several bisections; side 1 has ``share`` of every weight."""
    draw, best = np.random.default_rng(seed), None
    total = np.maximum(graph.weights.sum(0), 1)
    for _ in range(tries):
        side = improved(graph, grown(graph, share, int(draw.integers(len(graph.weights)))), caps)
        sizes = np.stack([graph.weights[side == s].sum(0) for s in (0, 1)])
        rank = excess(sizes, caps, total), graph.cut(side)
        if best is None or rank < best[0]:
            best = rank, side
    return best[1]


#: Nodes for each part at which the graph is small enough to be bisected.
FEW = 30


def partitioned(graph: Graph, shares: np.ndarray, caps: np.ndarray, tries: int, together: bool, seed: int) -> np.ndarray:
    """The part of each node. The graph shrinks further here; moves over all parts improve every size of it."""
    graphs, news, few = [graph], [], FEW * len(shares)
    most = np.maximum(graph.weights.max(0), np.ceil(2 * graph.weights.sum(0) / few))
    while len(graphs[-1].weights) > few:
        new, smaller = shrunk(graphs[-1], most, seed + len(news))
        if len(smaller.weights) > 0.9 * len(graphs[-1].weights):
            break
        news.append(new)
        graphs.append(smaller)
    part = along_tree(graphs[-1], shares, caps, tries, seed)
    if together:
        part = improved(graphs[-1], part, caps, 4)
    for smaller, new in zip(graphs[-2::-1], news[::-1], strict=True):
        part = improved(smaller, part[new], caps, 4 if together else 2)
    return part


def along_tree(graph: Graph, shares: np.ndarray, caps: np.ndarray, tries: int, seed: int) -> np.ndarray:
    """Bisections along the tree of shares; each takes its part of the slack that is left."""
    part = np.zeros(len(graph.weights), np.int64)
    open_ = [(np.arange(len(part)), 0, len(shares))]
    while open_:
        nodes, a, b = open_.pop()
        if b - a == 1 or not len(nodes):
            part[nodes] = a
            continue
        mid = (a + b) // 2
        sub = graph.within(nodes)
        have = sub.weights.sum(0)
        low, high = caps[a:mid].sum(0), caps[mid:b].sum(0)
        spare = np.maximum(low + high - have, 0) / max(1, int(np.ceil(np.log2(b - a))))
        want = high / np.maximum(low + high, 1)
        bounds = np.stack([np.minimum(low, np.ceil(have * (1 - want) + spare / 2)), np.minimum(high, np.ceil(have * want + spare / 2))]).astype(np.int64)
        side = bisected(sub, float(shares[mid:b].sum() / shares[a:b].sum()), bounds, tries, seed + a * 31 + b)
        open_ += [(nodes[side == 0], a, mid), (nodes[side == 1], mid, b)]
    return part
