"""Best-fit packing of token runs into sequences of a fixed capacity, by a configuration linear program.

The program has a row for each length that occurs and a column for each configuration, a
multiset of lengths that fits the capacity. Only the histogram of lengths reaches the
driver: as many numbers as the capacity, at any size of the corpus.

Solving, by multiplicative weights: every length has a price, every configuration that is
known an amount, its first one times exp(RATE * (worth - 1)), its worth being the sum of its lengths' prices. Prices
move, by Newton's method, until the amounts meet the demand for every length. A knapsack
dynamic program over the capacity then finds, for each length, the dearest configuration
that holds it, at prices between these and the best so far, and adds them to those known.
Prices divided by the value of the dearest configuration are a feasible dual: their sum over
all runs is a lower bound on the number of sequences (``Plan.bound``). While the bound stands
still the rate grows, which draws the amounts to the best configurations. Rounds end only when
fractional plan and bound are within GAP, however many that takes. Where they aren't at LAST_RATE,
beyond which weights are too steep for Newton's method, the simplex method goes on from the
configurations that are known by then (``finished``); each of its steps makes the plan smaller, so
it ends too.

The configurations of a best fit are among those known from the start, so the amounts can meet
the demand from the first round on. Where best fit comes within CLOSE of the volume over the
capacity, as it does for most corpora of short texts, no program can save more than that; rounds
then begin at its numbers, where others begin at equal amounts.

Rounding: the amounts, scaled to the corpus, are rounded along their running sum, or each to
the nearest whole number, the largest first; what is left is placed by best fit, longest first,
into the room of these sequences and new ones. The better of the two is the plan: it always
comes from the amounts.

Placing: the n-th run of a length takes the n-th place of that length. Runs are numbered
by task and by order within the task, and the task's first number is a running sum over
(length, task), so no task ever holds all runs of a frequent length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import binary_table, written
from meshloom.llm.units import WordUnits, blocks, kept

#: First and last rate of the amounts, its factor of growth, and the share of the best prices in those that are priced out.
RATE, LAST_RATE, GROW, STEADY = 40.0, 4000.0, 1.6, 0.7
#: The gap between fractional plan and bound at which rounds end; the work of a Newton step grows with the cube of the number of lengths.
GAP = 0.004
#: How near best fit must come to the volume for its numbers to be the first amounts.
CLOSE = 0.002
#: First amounts of all other configurations there, of the mean number of sequences for a length.
BEGUN = 0.001


@dataclass
class Plan:
    """Configurations ((length, number of such runs), ...) with the number of sequences of each, and a lower bound."""

    capacity: int
    patterns: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)
    bound: int = 0
    fractional: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def price_out(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the capacity: value of the dearest configuration of each width, and the index of a length in it (-1: none)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for width in range(1, capacity + 1):
        value[width], pick[width] = value[width - 1], -1
        n = fits[width]
        if n:
            gain = value[width - lengths[:n]] + prices[:n]
            best = int(gain.argmax())
            if gain[best] > value[width]:
                value[width], pick[width] = gain[best], best
    return value, pick


def unrolled(pick: np.ndarray, lengths: np.ndarray, width: int) -> Counter:
    """The configuration that the knapsack has for a width, as counts of indices of lengths."""
    found: Counter = Counter()
    while width > 0:
        if pick[width] < 0:
            width -= 1
        else:
            found[int(pick[width])] += 1
            width -= int(lengths[pick[width]])
    return found


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan for so many runs of each length (1 to capacity)."""
    plan = Plan(capacity)
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a length is outside 1..capacity")
    plan.bound = -(-sum(s * n for s, n in left.items()) // capacity)
    if whole := left.pop(capacity, 0):
        plan.patterns.append((((capacity, 1),), whole))
    if not left:
        return plan
    lengths = np.array(sorted(left), np.int64)
    count = np.array([left[int(s)] for s in lengths], np.int64)
    plain = best_fit(lengths, count, capacity)
    close = sum(plain.values()) + whole <= plan.bound * (1 + CLOSE) + 1
    amounts, bound, fractional = amounts_of(lengths, count, capacity, plain, close)
    plan.bound = max(plan.bound, whole + int(np.ceil(bound - 1e-6)))
    plan.fractional = whole + fractional
    best = min([way(amounts, lengths, count, capacity) for way in (rounded, nearest)], key=lambda f: sum(f.values()))
    plan.patterns += [(tuple((int(lengths[i]), a) for i, a in config), n) for config, n in sorted(best.items(), reverse=True)]
    return plan


@dataclass
class Known:
    """Configurations as (configuration, index of length, how many) triples, and the pairs of triples of one configuration."""

    keys: list[tuple[tuple[int, int], ...]]

    def __post_init__(self) -> None:
        sizes = np.array([len(c) for c in self.keys])
        self.config = np.repeat(np.arange(len(sizes)), sizes)
        self.row, times = np.array([x for c in self.keys for x in c]).T
        self.times = times.astype(float)
        again = np.repeat(sizes, sizes)
        self.one = np.repeat(np.arange(len(self.row)), again)
        self.two = np.arange(len(self.one)) - np.repeat(np.cumsum(again) - again, again) + np.repeat((np.cumsum(sizes) - sizes)[self.config], again)

    def worth(self, prices: np.ndarray) -> np.ndarray:
        return np.bincount(self.config, self.times * prices[self.row], len(self.keys))

    def cover(self, amounts: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.row, self.times * amounts[self.config], n)

    def curvature(self, amounts: np.ndarray, n: int) -> np.ndarray:
        one, two = self.one, self.two
        return np.bincount(self.row[one] * n + self.row[two], self.times[one] * self.times[two] * amounts[self.config[one]], n * n).reshape(n, n)


def merged(config: tuple[tuple[int, int], ...]) -> Counter:
    """The configuration with each length once."""
    out: Counter = Counter()
    for i, a in config:
        out[i] += a
    return out


def amounts_of(lengths: np.ndarray, count: np.ndarray, capacity: int, first: Counter | None = None, near: bool = False) -> tuple[Counter, float, float]:
    """(amounts of configurations that cover all runs, a lower bound, the sum of the amounts) of the fractional program; the configurations ``first`` are known from the start, and if they are ``near`` the least their numbers are the first amounts."""
    n, demand = len(lengths), count.astype(float)
    scale, rate = float(lengths @ count) / capacity / n, RATE
    base = scale * BEGUN if near else scale
    alone = {((i, int(capacity // s)),): base for i, s in enumerate(lengths.tolist())}
    for config, times in (first or {}).items():
        key = tuple(sorted(merged(config).items()))
        alone[key] = alone.get(key, 0) + times if near else base
    known, prices, best = dict(alone), lengths / capacity, lengths / capacity
    bound, least, found, still = 0.0, np.inf, Counter(), 0
    while True:
        asked = STEADY * best + (1 - STEADY) * prices
        value, pick = price_out(lengths, asked, capacity)
        here = float(demand @ asked) / value[capacity]
        still = 0 if here > bound * (1 + 1e-4) else still + 1
        if here > bound:
            bound, best = here, asked / value[capacity]
        for i in range(n):
            config = unrolled(pick, lengths, capacity - int(lengths[i]))
            config[i] += 1
            known.setdefault(tuple(sorted(config.items())), base)
        if still >= 3:
            rate, still = rate * GROW, 0
        table, begun = Known(list(known)), np.array(list(known.values()))
        top = table.worth(prices).max()
        if rate * (top - 1) > 5:
            prices = prices * (1 + 5 / rate) / top
        met = False
        for _ in range(20):
            amounts = begun * np.exp(np.minimum(rate * (table.worth(prices) - 1), 50))
            cover = table.cover(amounts, n)
            free = (prices > 0) | (cover < demand)
            lack = np.where(free, cover - demand, 0)
            met = np.abs(lack / demand).max() < 0.02
            if met:
                break
            slope = rate * table.curvature(amounts, n)
            slope[np.arange(n), np.arange(n)] += 1e-5 * rate * demand / lengths * capacity + 1e-12
            move = np.zeros(n)
            move[free] = np.linalg.solve(slope[np.ix_(free, free)], -lack[free])
            move *= min(1.0, 3 / (rate * np.abs(table.worth(move)).max() + 1e-12))
            prices = np.maximum(prices + move, 0)
        share = float((cover / demand).min())
        if share > 0 and amounts.sum() / share < least:
            least = float(amounts.sum() / share)
            found = Counter({c: x / share for c, x in zip(table.keys, amounts.tolist(), strict=True) if x > 1e-9 * least})
        if least <= bound * (1 + GAP):
            return found, bound, least
        if rate > LAST_RATE:
            return finished(lengths, demand, capacity, set(known), bound)
        if met and len(known) > 8 * n:
            known = {table.keys[c]: known[table.keys[c]] for c in np.argsort(-amounts)[: 4 * n].tolist()} | alone


def finished(lengths: np.ndarray, demand: np.ndarray, capacity: int, known: set[tuple[tuple[int, int], ...]], bound: float) -> tuple[Counter, float, float]:
    """(amounts, a lower bound, the sum of the amounts) within GAP, by the simplex method over ``known`` and what the knapsack adds to them.

    The demand is raised by up to a millionth at random, so that every step makes the sum smaller and none comes back.
    """
    n = len(lengths)
    raised = demand * (1 + 1e-6 * np.random.default_rng(1).random(n))
    basis = [((i, int(capacity // s)),) for i, s in enumerate(lengths.tolist())]
    known, columns, steps = known | set(basis), np.diag(capacity // lengths).astype(float), 0
    inverse, amounts = np.diag(1.0 / (capacity // lengths)), raised / (capacity // lengths)
    while True:
        table = Known(sorted(known))
        while True:
            prices = inverse.sum(0)
            worth = table.worth(prices)
            enters = int(worth.argmax())
            if worth[enters] <= 1 + 1e-7 or amounts.sum() <= bound * (1 + GAP):
                break
            column = np.zeros(n)
            for i, a in table.keys[enters]:
                column[i] = a
            ways = inverse @ column
            leaves = int(np.where(ways > 1e-9, amounts / np.maximum(ways, 1e-9), np.inf).argmin())
            basis[leaves], columns[:, leaves] = table.keys[enters], column
            steps += 1
            if steps % 100:
                inverse[leaves] /= ways[leaves]
                others = np.delete(np.arange(n), leaves)
                inverse[others] -= np.outer(ways[others], inverse[leaves])
            else:  # anew, without the errors of the steps before
                inverse = np.linalg.inv(columns)
            amounts = np.maximum(inverse @ raised, 0)
        asked = np.maximum(prices, 0)
        value, pick = price_out(lengths, asked, capacity)
        bound = max(bound, float(demand @ asked) / value[capacity])
        before = len(known)
        for i in range(n):
            config = unrolled(pick, lengths, capacity - int(lengths[i]))
            config[i] += 1
            known.add(tuple(sorted(config.items())))
        if amounts.sum() <= bound * (1 + GAP) or len(known) == before:
            return Counter({c: float(x) for c, x in zip(basis, amounts, strict=True) if x > 0}), bound, float(amounts.sum())


def rounded(amounts: Counter, lengths: np.ndarray, count: np.ndarray, capacity: int) -> Counter:
    """Whole numbers of configurations along the running sum of the amounts; best fit for the rest, into what room they leave."""
    left, out, run = count.copy(), Counter(), 0.0
    for config, n in sorted(amounts.items(), reverse=True):
        before, run = run, run + n
        due = int(run + 0.5) - int(before + 0.5)
        while due > 0 and config:
            times = min(due, *(int(left[i]) // a for i, a in config))
            if times:
                for i, a in config:
                    left[i] -= a * times
                out[config] += times
                due -= times
            config = tuple((i, min(a, int(left[i]))) for i, a in config if left[i])  # without what is used up
    return best_fit(lengths, left, capacity, out)


def nearest(amounts: Counter, lengths: np.ndarray, count: np.ndarray, capacity: int) -> Counter:
    """Whole numbers next to the amounts, the largest amounts first; best fit for the rest, into what room they leave."""
    left, out = count.copy(), Counter()
    for config, n in sorted(amounts.items(), key=lambda c: (-c[1], c[0])):
        times = min(int(n + 0.5), *(int(left[i]) // a for i, a in config))
        if times:
            for i, a in config:
                left[i] -= a * times
            out[config] += times
    return best_fit(lengths, left, capacity, out)


def best_fit(lengths: np.ndarray, count: np.ndarray, capacity: int, begun: Counter | None = None) -> Counter:
    """Longest first, each run into the fullest sequence that has room, those ``begun`` included; sequences alike are handled as one."""
    open_at: dict[int, Counter] = {}
    for config, n in (begun or {}).items():
        open_at.setdefault(capacity - sum(int(lengths[i]) * a for i, a in config), Counter())[config] += n
    gaps: list[int] = [*sorted(open_at), capacity]  # ascending; sequences not yet begun stand last
    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(count[i])
        while n:
            gap = gaps[bisect.bisect_left(gaps, size)]
            each = gap // size  # the fullest with room stays it until it has none
            if gap == capacity:
                config, many = (), -(-n // each)
            else:
                config, many = open_at[gap].popitem()
                if not open_at[gap]:
                    del open_at[gap], gaps[bisect.bisect_left(gaps, gap)]
            full = min(many, n // each)
            rest = n - full * each if full < many else 0
            for times, a in ((full, each), (1 if rest else 0, rest), (many - full - (1 if rest else 0), 0)):
                if times:
                    after = gap - a * size
                    if after < capacity and after not in open_at:
                        open_at[after] = Counter()
                        bisect.insort(gaps, after)
                    if after < capacity:
                        open_at[after][(*config, (i, a)) if a else config] += times
            n -= full * each + rest
    return sum(open_at.values(), Counter())


@dataclass
class Places:
    """For each length its places in order, as stretches of sequences that share a configuration."""

    first: np.ndarray  # length * 2**44 + number of the stretch's first place among those of its length
    sequence: np.ndarray  # the stretch's first sequence
    each: np.ndarray  # how many runs of this length each of its sequences has
    offset: np.ndarray  # of the first of them

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + nth
        at = np.searchsorted(self.first, key, side="right") - 1
        place = key - self.first[at]
        return self.sequence[at] + place // self.each[at], self.offset[at] + place % self.each[at] * length


def places(plan: Plan) -> Places:
    rows, used, sequence = [], Counter(), 0
    for config, times in plan.patterns:
        offset = 0
        for length, each in config:
            rows.append(((length << 44) + used[length], sequence, each, offset))
            used[length] += each * times
            offset += length * each
        sequence += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Places(*map(np.ascontiguousarray, columns))


def runs_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each run: (key, piece, start, length, ids_crc32), and its number among those of its length in its task.

    A null text is empty and is one run of the end id alone; a longer run than the capacity is cut.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met, encoder = TaskContext.get().partitionId(), [0] * (capacity + 1), kept(WordUnits, vocabulary)
        for part in blocks(batches):
            ids, sizes = encoder.encode(part.column("utf8").to_pylist())
            rows, at = [], 0
            for doc, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for k, start in enumerate(range(0, n + 1, capacity)):
                    piece = own[start : start + capacity]
                    rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes()), task, met[len(piece)]))
                    met[len(piece)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[key, "piece", "start", "length", "ids_crc32", "task", "nth"])

    return binary_table(docs, key, text).mapInArrow(work, f"{key} long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): the place of every run.

    An empty table gives no rows; repeated rows and null keys are packed like any others. Other columns, whatever their
    names, aren't read.
    """
    runs = written(runs_of(docs, vocabulary, capacity, end_id, key, text), "runs")
    counts = runs.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(solve(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            sequence, offset = where.of(length, nth)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = runs.join(bases, ["length", "task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("nth"))
    return numbered.mapInArrow(place, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
