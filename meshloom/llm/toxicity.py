"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (trigrams over boundary, a-z, other letters, digits and other
signs) is counted over all documents. Words that may be disguised, with digits or signs
among letters, letters repeated three times or more, or letters spelled one by one, become
lattices: a sign may stand for itself or for the letter it looks like, a separator may be a
boundary or nothing, a repeated letter may be one, two or all of them. Viterbi decoding
finds the reading that the language model and the channel's costs together make cheapest.

The restored words are scored by a logistic model over a few dozen units (words, and first
letters of words) that are chosen one by one, each for what the ones before leave
unexplained. It is fitted on a bounded sample of labelled rows: TOXIC_ROWS and CLEAN_ROWS at
most, of texts up to SAMPLE_CHARS characters, the lowest by a hash of the id. Prevalence
comes from all labels of the training folds. Only texts enter a score.

A null text is empty; it scores what a text without any word does. Repeated rows score
equally; a row without an id is scored and never learned from, an empty table gives no rows,
and other columns may have any names. Without a toxic or a clean label every score is the
prevalence (0 if unknown).
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import binary_table, tidy
from meshloom.llm.units import Seen, blocks, segments

#: The most labelled rows that a model is fitted on, and the longest text among them.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1500, 3000, 20_000
#: Rows whose crc32(id) has this remainder by FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: Classes of characters: boundary, a-z, other letters, digits, other signs.
BOUNDARY, OTHER, DIGIT, SIGN, CLASSES = 0, 27, 28, 29, 30
#: The letters that a sign may stand for (fixed values).
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l"}
SEPARATORS = " .-_*~,'/\\"
#: Costs (negative logarithms) of the channel: a sign for a letter, a separator that means nothing, a letter written more often than meant.
SIGN_COST, SEPARATOR_COST, REPEAT_COST = 1.5, 1.0, 1.0
#: Places of a lattice after which the start that all readings share is settled, so that long lattices take little memory.
SETTLE_CHARS = 4096


def class_table() -> np.ndarray:
    """The class of every code point up to 0x24F; all others are other letters."""
    table = np.full(0x251, OTHER, np.int64)
    for c in range(0x250):
        ch = chr(c)
        table[c] = BOUNDARY if ch.isspace() or c < 32 else ord(ch.lower()) - 96 if ch.isascii() and ch.isalpha() else OTHER if ch.isalpha() else DIGIT if ch.isdigit() else SIGN
    return table


CLASS = class_table()


def classes_of(text: str) -> np.ndarray:
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x250)]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts, CLASSES cubed of them at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            total = np.zeros(CLASSES**3, np.int64)
            for utf8 in part.column("utf8").to_pylist():
                for piece in segments(utf8):
                    c = np.concatenate([[BOUNDARY, BOUNDARY], classes_of(piece.decode()), [BOUNDARY]])
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["trigram", "n"])

    rows = docs.select(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("utf8")).mapInArrow(work, "trigram long, n long")
    counts = np.zeros(CLASSES**3, np.int64)
    for r in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[r["trigram"]] = r["n"]
    return counts


@dataclass
class Restorer:
    """Reads disguised words under a character language model."""

    counts: np.ndarray

    REPEATED = re.compile(r"(\w)\1\1")
    LETTER = re.compile(r"[^\W\d_]")
    LOOKING = re.compile(f"[{re.escape(''.join(LOOKS_LIKE))}]")
    BETWEEN = re.compile(r"[a-zà-öø-ÿ][^.\-_*~/\\]*[.\-_*~/\\]+[^a-zà-öø-ÿ]*[a-zà-öø-ÿ]")
    EDGES = re.compile(rf"^[^\w{re.escape(''.join(LOOKS_LIKE))}]+|[^\w{re.escape(''.join(LOOKS_LIKE))}]+$")
    PARTS = re.compile(r"\w+")

    @cached_property
    def costs(self) -> np.ndarray:
        """Negative log probabilities of a class after two others, mixed with those after one and after none."""
        c = self.counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        one = (c.sum((0, 1)) + 1) / (c.sum() + CLASSES)
        two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
        return -np.log((c + 5 * two[None]) / (c.sum(2)[..., None] + 5))

    def words(self, word: str) -> tuple[str, ...]:
        """The words that a run of characters other than white space, in lower case, is read as."""
        if word.isalpha() and not self.REPEATED.search(word):
            return (word,)
        bare = self.EDGES.sub("", word)
        if self.suspect(bare):
            return tuple(self.PARTS.findall(self.decode(bare)))
        return tuple(self.PARTS.findall(bare))

    def suspect(self, bare: str) -> bool:
        """Whether a word may be disguised: signs that look like letters anywhere beside letters, separators between letters, repeated letters."""
        return bool(self.LOOKING.search(bare) and self.LETTER.search(bare) or self.BETWEEN.search(bare) or self.REPEATED.search(bare))

    def spelled(self, letters: list[str]) -> tuple[str, ...]:
        """The words that letters written one by one are read as."""
        return tuple(self.PARTS.findall(self.decode(" ".join(letters))))

    def arcs(self, raw: str) -> Iterator[list[tuple[int, str, float]]]:
        """For each place the (next place, what is read, cost) that may follow."""
        for i, ch in enumerate(raw):
            first, end = i == 0 or raw[i - 1] != ch, i + 1
            while first and end < len(raw) and raw[end] == ch:
                end += 1
            if ch in LOOKS_LIKE:  # signs that repeat stand for themselves all or not at all
                here = [(end, raw[i:end], 0.0)] if first else []
                here += [(i + 1, letter, SIGN_COST) for letter in LOOKS_LIKE[ch]]
            elif ch in SEPARATORS:
                here = [(i + 1, " ", 0.0), (i + 1, "", SEPARATOR_COST)]
            else:
                here = [(i + 1, ch, 0.0)]
                if end - i > 2 and ch.isalpha():
                    here += [(end, ch, REPEAT_COST), (end, ch * 2, REPEAT_COST)]
            yield here

    def decode(self, raw: str) -> str:
        """The cheapest reading of all of it.

        A reading is a chain of steps [step before, what is read, place]. Readings that lose are freed, and what all
        that are left share is settled from time to time.
        """
        costs = self.costs
        first: list = [None, "", 0]
        best: dict[int, dict[tuple[int, int], tuple[float, list]]] = {0: {(BOUNDARY, BOUNDARY): (0.0, first)}}
        settled: list[str] = []
        settle_at = SETTLE_CHARS
        for i, here in enumerate(self.arcs(raw)):
            if i == settle_at:
                shared = common_step([step for states in best.values() for _, step in states.values()])
                settled.append(reading(shared))
                shared[:2] = None, ""
                settle_at = i + max(SETTLE_CHARS, i - shared[2])
            for (a, b), (cost, step) in best.pop(i).items():
                for to, read, extra in here:
                    x, y, now = a, b, cost + extra
                    for ch in read:
                        c = int(CLASS[min(ord(ch), 0x250)])
                        now += costs[x, y, c]
                        x, y = y, c
                    states = best.setdefault(to, {})
                    old = states.get((x, y))
                    if old is None or now < old[0]:
                        states[x, y] = (now, [step, read, to])
        _, last = min(((cost + costs[a, b, BOUNDARY], step) for (a, b), (cost, step) in best[len(raw)].items()), key=lambda found: found[0])
        return "".join(settled) + reading(last)


def reading(step: list | None) -> str:
    """What a chain of steps reads."""
    read = []
    while step is not None:
        read.append(step[1])
        step = step[0]
    return "".join(reversed(read))


def common_step(steps: list[list]) -> list:
    """The last step that these chains, which start with the same one, share."""
    heads = {id(step): step for step in steps}
    heap = [(-step[2], i) for i, step in heads.items()]
    heapq.heapify(heap)
    while len(heads) > 1:
        before = heads.pop(heapq.heappop(heap)[1])[0]
        if id(before) not in heads:
            heads[id(before)] = before
            heapq.heappush(heap, (-before[2], id(before)))
    return next(iter(heads.values()))


def units_of(word: str) -> list[str]:
    """The word, marked as whole, and its first three to seven letters."""
    return [word + "$", *(word[:n] for n in range(3, 8) if len(word) >= n)]


class Reader:
    """Texts to numbered restored words; tables are emptied when full."""

    def __init__(self, restorer: Restorer, limit: int = 300_000) -> None:
        self.restorer, self.limit = restorer, limit
        self.seen, self.single = Seen(), np.zeros(0, bool)

    def of_run(self, run: list[str]) -> list[tuple[str, ...]]:
        return [self.restorer.spelled(run)] if len(run) >= 3 else []

    def read(self, utf8: bytes) -> tuple[np.ndarray, list[tuple[str, ...]]]:
        """(numbers of the words as written, the words read from runs of single letters)."""
        numbers = []
        spelled: list[tuple[str, ...]] = []
        run: list[str] = []  # single letters up to where the next part goes on
        for part in segments(utf8):
            words = part.decode().lower().split()
            numbers.append(self.seen.of(words))
            fresh = self.seen.new[len(self.seen.new) - (len(self.seen) - len(self.single)) :]
            if fresh:
                self.single = np.concatenate([self.single, np.fromiter((len(w) == 1 and (w.isalpha() or w in LOOKS_LIKE) for w in fresh), bool, len(fresh))])
            one = self.single[numbers[-1]]
            if run and len(one) and not one[0]:
                spelled += self.of_run(run)
                run = []
            if one.any():
                edge = np.diff(np.concatenate([[0], one.astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    run += words[a:b]
                    if b < len(words):
                        spelled += self.of_run(run)
                        run = []
        spelled += self.of_run(run)
        return (np.concatenate(numbers) if numbers else np.zeros(0, np.int32)), spelled


@dataclass
class Model:
    """A logistic model over counts of units and their share of the words."""

    units: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = self.bias + columns(counts, n_words) @ self.weights if len(self.units) else np.full(len(n_words), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def columns(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Two columns for each unit: the logarithm of its count, and its share of the words."""
    return np.concatenate([np.log1p(counts), np.minimum(100 * counts / (n_words[:, None] + 50), 5)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method, with a penalty on the weights."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[Counter], labels: np.ndarray, prevalence: float, most: int = 40, least_docs: int = 8, least_z: float = 5.0) -> Model:
    """Choose units and fit their weights; ``texts`` are counts of restored words."""
    y = labels.astype(float)
    if not 0 < y.sum() < len(y):
        return Model(bias=float(np.log((prevalence + 1e-6) / (1 - prevalence + 1e-6))))
    in_toxic: Counter = Counter()
    for words, label in zip(texts, labels, strict=True):
        if label:
            in_toxic.update({u for w in words for u in units_of(w)})
    candidates = {u: n for u, n in in_toxic.items() if n >= least_docs}
    in_clean: Counter = Counter()
    for words, label in zip(texts, labels, strict=True):
        if not label:
            in_clean.update({u for w in words for u in units_of(w) if u in candidates})
    n1, n0 = y.sum(), len(y) - y.sum()
    kept = sorted((u for u, n in candidates.items() if n / n1 > 2 * (in_clean[u] + 1) / n0), key=lambda u: (-candidates[u] / (in_clean[u] + 1), u))[:2000]
    at = {u: k for k, u in enumerate(kept)}
    counts = np.zeros((len(texts), len(kept)), np.float32)
    for i, words in enumerate(texts):
        for w, n in words.items():
            for u in units_of(w):
                if u in at:
                    counts[i, at[u]] += n
    n_words = np.array([sum(t.values()) for t in texts], float)
    shown = np.log1p(counts)
    chosen: list[int] = []
    weights, bias = np.zeros(0), float(np.log(n1 / n0))
    while len(chosen) < most and kept:
        p = 1 / (1 + np.exp(-np.clip((columns(counts[:, chosen].astype(float), n_words) @ weights if chosen else np.zeros(len(y))) + bias, -30, 30)))
        z = shown.T @ (y - p) / np.sqrt((shown**2).T @ (p * (1 - p)) + 1e-3)
        z[chosen] = 0
        best = int(z.argmax())
        if z[best] < least_z:
            break
        chosen.append(best)
        weights, bias = logistic(columns(counts[:, chosen].astype(float), n_words), y)
    bias += np.log((prevalence + 1e-6) / (1 - prevalence + 1e-6)) - np.log(n1 / n0)  # the sample has more toxic rows than the corpus
    return Model([kept[k] for k in chosen], weights, float(bias))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, restorer: Restorer, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows outside the held-out fold."""
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prevalence = totals.get(1, 0) / max(1, sum(totals.values()))
    order = [F.xxhash64("k"), F.col("k")]
    ids = [tuple(r) for y, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)) for r in own.where(F.col("y") == y).orderBy(*order).limit(most).collect()]
    if not ids:
        return fit([], np.zeros(0, int), prevalence)
    # at most TOXIC_ROWS + CLEAN_ROWS ids: the only rows that are sent to every executor
    chosen = docs.sparkSession.createDataFrame(ids, "k long, y int")
    own_rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("t"))  # other columns may have any names
    rows = own_rows.join(F.broadcast(chosen), F.col("__key") == F.col("k")).where(F.length("t") <= SAMPLE_CHARS)
    reader = Reader(restorer)
    texts, y = [], []
    for r in rows.groupBy("k", "y").agg(F.min("t").alias("t")).orderBy("k").toLocalIterator():  # of rows that repeat an id, the least text
        words: Counter = Counter()
        for w, n in Counter(r["t"].lower().split()).items():
            for found in restorer.words(w):
                words[found] += n
        for found in reader.read(r["t"].encode())[1]:
            words.update(found)
        texts.append(words)
        y.append(r["y"])
    return fit(texts, np.array(y), prevalence)


class Scorer:
    """Scores texts in a task."""

    def __init__(self, restorer: Restorer, model: Model) -> None:
        self.restorer, self.model = restorer, model
        self.at = {u: k for k, u in enumerate(model.units)}
        self.leads = {u.removesuffix("$")[:3] for u in model.units}
        self.reset()

    def reset(self) -> None:
        self.reader = Reader(self.restorer)
        self.n_words, self.hit, self.hits = np.zeros(0, np.int64), np.zeros(0, bool), {}

    def units(self, words: tuple[str, ...]) -> list[int]:
        return [self.at[u] for w in words if w[:3] in self.leads for u in units_of(w) if u in self.at]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(self.reader.seen) > self.reader.limit:
            self.reset()
        read = [self.reader.read(t) for t in texts]
        new = self.reader.seen.take_new()
        base = len(self.n_words)
        words = [self.restorer.words(w) for w in new]
        found = [self.units(w) for w in words]
        self.n_words = np.concatenate([self.n_words, np.fromiter(map(len, words), np.int64, len(words))])
        self.hit = np.concatenate([self.hit, np.fromiter(map(bool, found), bool, len(found))])
        self.hits |= {base + i: f for i, f in enumerate(found) if f}
        counts, n = np.zeros((len(texts), len(self.at))), np.zeros(len(texts))
        for i, (numbers, spelled) in enumerate(read):
            n[i] = self.n_words[numbers].sum() + sum(map(len, spelled))
            for number in numbers[self.hit[numbers]].tolist():
                for k in self.hits[number]:
                    counts[i, k] += 1
            for some in spelled:
                for k in self.units(some):
                    counts[i, k] += 1
        return self.model.score(counts, n)


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    restorer = Restorer(trigram_counts(docs, text))
    model = train(docs, labels, restorer, key, text, label)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(restorer, model)
        for part in blocks(batches):
            score = scorer.score(part.column("utf8").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])

    scored = binary_table(docs, key, text).mapInArrow(work, f"{key} long, score double, predicted int")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; decided in the task that reads them."""
    restorer = Restorer(trigram_counts(docs, text))
    model = train(docs, labels, restorer, key, text)
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(restorer, model)
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place).cast(pa.binary()).fill_null(b"")], names=["i", "utf8"])
            scores = np.concatenate([scorer.score(part.column("utf8").to_pylist()) for part in blocks([whole])])
            yield batch.filter(pa.array(scores < threshold))
        scorer.reset()
        tidy()

    return docs.mapInArrow(work, docs.schema)
