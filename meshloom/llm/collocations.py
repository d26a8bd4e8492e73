"""Phrases whose words stand together more often than apart, mined level by level.

A text is lower-cased (A-Z only), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into
words ``[^\\x20\\x09]+``. Everything is counted for each language.

Apriori: pass k reads the texts and emits a run of k words only where both runs of k - 1 words
in it are frequent, so the table of level k holds nearly nothing that isn't. The frequent runs
of the level below go to every task as a bitmap of FILTER_BITS bits, two for each run: its size
is fixed, however many there are. A run that the bitmap takes for frequent by mistake is
counted and dropped by its count, so the bitmap costs time at worst, never a phrase.

Scores come from the level tables alone: each cut of a phrase is joined with the counts of its
two parts. Ranking keeps the first ``top`` of each of RANK_LOTS lots of a language before the
lots meet, so no task ranks all phrases of a language.

Null text: empty. Null language: ``und``. Repeated rows count each. An empty table gives no
rows. Columns other than the text and the language, whatever their names, aren't read.
A text is read in stretches that end between pieces: only a single piece is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import tables_in_between, tidy, views, written

#: Bytes of text that are counted at once.
STRETCH = 6 << 20
#: Bits of the bitmap of frequent runs; any number gives the same phrases.
FILTER_BITS = 1 << 26
#: Lots into which the phrases of a language are dealt before they are ranked.
RANK_LOTS = 256

#: Of each byte: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def stretches(lang: str, text: memoryview) -> Iterator[tuple[str, memoryview]]:
    """A text cut between pieces into stretches of about STRETCH bytes."""
    octets, at = np.frombuffer(text, np.uint8), 0
    while len(octets) - at > STRETCH:
        end = at + STRETCH
        while end < len(octets):
            here = np.flatnonzero(KIND[octets[end : end + STRETCH]] == 2)
            if len(here):
                end += int(here[0])
                break
            end += STRETCH
        yield lang, text[at:end]
        at = min(end, len(octets))
    yield lang, text[at:]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, memoryview]]]:
    """Stretches of texts in lists of about STRETCH bytes in all."""
    block, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), views(batch.column("utf8")), strict=True):
            for own in stretches(lang, text):
                block.append(own)
                size += len(own[1])
                if size >= STRETCH:
                    yield block
                    block, size = [], 0
    if block:
        yield block


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def extended(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run and one more word; a run of no words is 0."""
    return mixed((run ^ word) * np.uint64(0xD6E8FEB86659FD93))


def hash_of(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang))


def bits_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes >> np.uint64(shift)) % np.uint64(bits) for shift in (0, 32)]


class Words:
    """The words of a block, in order: their numbers among the block's distinct ones, and the pieces they stand in."""

    def __init__(self, block: list[tuple[str, memoryview]]) -> None:
        octets = np.frombuffer(b"\n".join(t for _, t in block).translate(LOWER), np.uint8)
        kind = KIND[octets]
        inside = np.concatenate([[False], kind == 0, [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(octets[kind == 0])]).dictionary_encode()
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        begins = np.cumsum([0, *(len(t) + 1 for _, t in block)])
        langs, of_text = np.unique([lang for lang, _ in block], return_inverse=True)
        lang = np.repeat(of_text, np.diff(np.searchsorted(starts, begins)))
        del octets, kind, inside, ends, offsets
        n = max(1, len(found.dictionary))
        self.at, distinct = pd.factorize(lang.astype(np.int64) * n + found.indices.to_numpy())
        self.lang = pa.array(langs.tolist(), pa.string()).take(pa.array(distinct // n))
        self.text = found.dictionary.take(pa.array(distinct % n))

    def hashes(self) -> np.ndarray:
        """Of each distinct word, with its language."""
        return np.array([hash_of(lang, w) for lang, w in zip(self.lang.to_pylist(), self.text.to_pylist(), strict=True)], np.uint64)

    def runs(self, k: int, frequent: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """(the distinct words of each distinct run of k words, how often each occurs) of those whose both shorter runs may be frequent."""
        n = len(self.at) - k + 1
        if n <= 0:
            return [np.zeros(0, np.int64)] * k, np.zeros(0, np.int64)
        good = self.piece[:n] == self.piece[k - 1 :]
        if k > 1:
            of_word, run = self.hashes()[self.at], np.zeros(n + 1, np.uint64)
            for j in range(k - 1):
                run = extended(run, of_word[j : j + n + 1])
            bits = len(frequent) * 64
            known = np.ones(n + 1, bool)
            for bit in bits_of(run, bits):
                known &= (frequent[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            good &= known[:-1] & known[1:]
        here = np.flatnonzero(good)
        code, width = self.at[here], len(self.text)
        for j in range(1, k):
            code = pd.factorize(code * width + self.at[here + j])[0]
        counts = np.bincount(code)
        first = np.zeros(len(counts), np.int64)
        first[code] = here
        present = np.flatnonzero(counts)
        return [self.at[first[present] + j] for j in range(k)], counts[present]


def level(docs: DataFrame, k: int, frequent: Broadcast | None, min_count: int) -> DataFrame:
    """(lang, phrase, n) of the runs of k words that occur ``min_count`` times; at level 1 also the words of each language, without a phrase."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "n"]
        for block in blocks_of(batches):
            words = Words(block)
            parts, counts = words.runs(k, None if frequent is None else frequent.value)
            phrase = pc.binary_join_element_wise(*[words.text.take(pa.array(p)) for p in parts], pa.scalar(b" ", pa.large_binary())) if k > 1 else words.text.take(pa.array(parts[0]))
            lang = words.lang.take(pa.array(parts[0]))
            yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.large_string()).cast(pa.string()), pa.array(counts.astype(np.int64))], names=names)
            if k == 1:
                totals = pd.Series(counts).groupby(lang.to_pandas().to_numpy()).sum()
                yield pa.RecordBatch.from_arrays([pa.array(totals.index.tolist(), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals.to_numpy().astype(np.int64))], names=names)
            del words, parts, counts, phrase, lang
        tidy()

    emitted = docs.mapInArrow(work, "lang string, phrase string, n long")
    return emitted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.col("phrase").isNull())


def bitmap(runs: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each (lang, phrase), in 64-bit words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                run = np.zeros(1, np.uint64)
                for word in phrase.encode().split(b" "):
                    run = extended(run, np.array([hash_of(lang, word)], np.uint64))
                at.append(run)
            bit = np.concatenate([x for part in [np.concatenate(at) if at else np.zeros(0, np.uint64)] for x in bits_of(part, bits)])
            word = (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(word)], names=["at", "word"])

    words = runs.where(F.col("phrase").isNotNull()).mapInArrow(work, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word"))
    found = words.toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(counts: DataFrame, min_words: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of ``min_words`` words or more, by its lowest cut."""
    words = F.split("phrase", " ")
    cuts = counts.where(F.size(words) >= min_words).select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.withColumns({"left": part(words, F.lit(1), F.col("k")), "right": part(words, F.col("k") + 1, F.size(words))})
    of = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    exact = [f"cast({c} as decimal(15,0))" for c in "alr"]  # products of 37 digits at most
    score = F.expr("cast(1000000 as decimal(7,0)) * ({0} * {0}) div ({1} * {2})".format(*exact))
    lowest = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")


def covered(counts: DataFrame, min_words: int) -> DataFrame:
    """(lang, phrase, within): of phrases inside longer ones, the count of the most frequent of those."""
    words, m = F.split("phrase", " "), F.size(F.split("phrase", " "))
    longer = counts.where(m > min_words).select("lang", words.alias("w"), "n")
    sizes = longer.select("lang", "w", "n", F.explode(F.sequence(F.lit(min_words), F.size("w") - 1)).alias("k"))
    inner = sizes.select("lang", "w", "n", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    return inner.select("lang", part(F.col("w"), F.col("i"), F.col("k")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("within"))


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, with their rank from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    lots = phrases.withColumn("__lot", F.pmod(F.xxhash64("phrase"), F.lit(RANK_LOTS)))
    near = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__lot").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("__lot")


def collocations(docs: DataFrame, min_words: int = 2, max_words: int = 3, min_count: int = 10, top: int = 2000, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    a, l and r are the counts of a phrase and of the two parts of its lowest cut, n the words of the language; the score is
    floor(1000000 * a * a / (l * r)), exact for counts below 10**15. Phrases inside a longer one that has at least half
    their count are dropped.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("utf8"))
    with tables_in_between(spark):
        levels = [written(level(rows, 1, None, min_count), "words")]
        for k in range(2, max_words + 1):
            frequent = spark.sparkContext.broadcast(bitmap(levels[-1], filter_bits))
            levels.append(written(level(rows, k, frequent, min_count), "runs"))
            frequent.unpersist()
        totals = levels[0].where("phrase is null").select("lang", F.col("n"))
        counts = reduce(DataFrame.unionByName, levels).where("phrase is not null")
        good = scored(counts, min_words).join(covered(counts, min_words), ["lang", "phrase"], "left").where("within is null or 100 * within < 50 * a").drop("within")
        first = ranked(good, top).join(totals, "lang")
        return written(first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
