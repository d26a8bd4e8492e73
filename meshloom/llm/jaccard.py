"""Jaccard self-join of word 5-grams with a token-group matrix, and its connected components.

A document's set holds the distinct runs of five words (all words as one, if fewer), words
being runs of characters other than ASCII white space with A-Z lowered. Two sets link when
100 * intersection >= 75 * union. Documents with equal sets are one node; links are sought
between nodes. No pair is left out. Runs of words are compared by 48 bits of a hash: two
sets of n and m tokens have a wrong overlap with a probability of n * m / 2**48, one in a
million for 17,000 words each; equal sets are told by their size and a 64-bit hash.

1.  Two linked sets share a token among the first n - ceil(0.75 n) + 1 of each, under any
    one order of all tokens. Frequent tokens come last in it, so that common passages join
    nobody. Nodes send their first tokens; those that only one node has go.
2.  Each token proposes a few of its nodes as stars, and each node is compared with the
    stars that share most of its tokens, one of each kind. Within a component of what links
    nothing more needs to be found.
3.  Nodes are partitioned into groups of similar ones, blocks of about GROUP nodes of a
    component, and the token-group matrix has an entry for each token and group. A node
    queries the groups of larger components through the tokens they share. Sizes and the
    number of shared tokens bound the overlap first, then the node's overlap with the
    group's token union; only groups that can still hold a linked set are opened, and every
    member of fitting size is compared exactly. Tokens of at most HOT groups are expanded,
    so there are at most HOT rows for each row of a node and token.
4.  Nodes that share a token of more groups are partitioned anew, by their most frequent
    token, into blocks of about BLOCK nodes. Blocks that share such a token meet as wholes,
    once, whatever number of tokens they share: one row for BLOCK * BLOCK pairs of nodes.
    There, too, the union of a block bounds a node's overlap before the block is opened. A
    block of one component doesn't meet others of the same component.

No step lists the pairs within a group of copies or near copies. Tables in between are
deleted when the components are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshloom.llm.common import tables_in_between, tidy, views, written
from meshloom.llm.units import blocks

#: Words in a token.
SHINGLE = 5
#: Nodes of a group: a union holds the tokens of about so many sets.
GROUP = 64
#: The share of a set's tokens, in hash order, among which frequent ones are counted: more than its first tokens.
COUNTED = 0.35
#: Tokens that a task counts at once, and buckets of counts for each input partition.
STRETCH, BUCKETS = 1_000_000, 8
#: Nodes that each token proposes as stars.
STARS = 3
#: A token of more sets comes last in the order, if it is among the HOT_TOKENS most frequent ones; a token of more groups is not expanded.
HOT = 24
#: The most tokens that are put last: they are sent to every task. Any number gives the same result.
HOT_TOKENS = 1_000_000
#: Nodes and tokens of a block of nodes that share a token of many groups.
BLOCK, BLOCK_TOKENS = 256, 100_000
#: Parts into which the rows of a frequent token are dealt.
SALTS = 256
#: Counts that are held at once when two blocks are compared.
OPENED = 4_000_000
#: Bits for each id of the filter through which the texts are read for the second time, and the most bits that are sent to every task.
BITS_PER_ID, FILTER_BITS = 16, 1 << 28


def needed(n: int) -> int:
    """The least overlap that a set of this size has with a linked one."""
    return -(-3 * n // 4)


def first_tokens(n: int) -> int:
    return n - needed(n) + 1


#: Random numbers that stand for bytes, and the odd number whose powers stand for places: words hash as sums of products.
BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
PLACE = 0xD1342543DE82EF95
CHUNK = 1 << 20
IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of PLACE and of its inverse, from 0 to n - 1."""
    out = []
    for base in (PLACE, pow(PLACE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of a text in lower case, where they begin)."""
    octets = np.frombuffer(raw, np.uint8)
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(octets):
        end = at + CHUNK
        if end < len(octets):  # cut at white space
            white = np.flatnonzero(IS_WHITE[octets[at:end]])
            while not len(white) and end < len(octets):
                end += CHUNK
                white = np.flatnonzero(IS_WHITE[octets[at:end]])
            if len(white) and end < len(octets):
                end = at + int(white[-1]) + 1
        part = octets[at:end]
        inside = np.concatenate([[False], ~IS_WHITE[part], [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        up, down = powers(CHUNK) if len(part) <= CHUNK else powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * up[: len(part)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def token_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit tokens of each text."""
    words, places = word_hashes(b"\n".join(texts).lower())
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    n_words = np.diff(np.searchsorted(places, begins))
    tokens = np.full(max(0, len(words) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE if len(tokens) else 0):
        tokens = mixed((tokens ^ words[k : k + len(tokens)]) * np.uint64(0x9E3779B97F4A7C15))
    out, at = [], 0
    for n in n_words.tolist():
        if n >= SHINGLE:
            out.append(np.unique(tokens[at : at + n - SHINGLE + 1]))
        else:
            one = np.full(min(n, 1), n, np.uint64)
            for k in range(n):
                one = mixed((one ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15))
            out.append(one)
        at += n
    return out


def short(tokens: np.ndarray) -> bytes:
    """Tokens by their first 48 bits."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def packed(tokens: np.ndarray) -> bytes:
    """48-bit integers as ``short`` has them."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def long(raw: bytes | memoryview | pa.Buffer) -> np.ndarray:
    """The 48-bit tokens of ``short`` as integers."""
    octets = np.frombuffer(raw, np.uint8)
    wide = np.zeros((len(octets) // 6, 8), np.uint8)
    wide[:, 2:] = octets.reshape(-1, 6)
    return wide.view(">u8").reshape(-1).astype(np.int64)


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("utf8"))


def short40(tokens: np.ndarray) -> np.ndarray:
    """The five bytes of each token below 2**40, as rows."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def long40(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1).astype(np.int64)


def frequent_tokens(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """The first 40 bits of tokens that more than HOT sets have among their first COUNTED ones, ascending.

    They go last in the order; any choice gives right results, so of more than HOT_TOKENS only the most frequent are taken.
    Each stretch of a task counts its tokens first and sends them in byte strings, one for each bucket of the hash: tokens
    met once, and others with their counts, so a token in a third of all texts is one entry for each stretch. There are
    BUCKETS buckets for each input partition, so what a bucket gets doesn't grow.
    """
    texts = texts_of(docs, key, text).select("utf8")
    bits = min(38, max(8, (BUCKETS * texts.rdd.getNumPartitions()).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strings() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            buckets = (tokens >> np.uint64(40 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            once, several = [], []
            for part, counts in zip(np.split(short40(tokens), cuts), np.split(n, cuts), strict=True):
                once.append(part[counts == 1].tobytes())
                several.append(part[counts > 1].tobytes() + counts[counts > 1].astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(buckets[np.append(0, cuts)]), pa.array(once, pa.binary()), pa.array(several, pa.binary())], names=["bucket", "once", "several"])

        held: dict[int, np.ndarray] = {}
        size = 0
        for part in blocks(batches):
            for tokens in token_sets(part.column("utf8").to_pylist()):
                first = tokens[: int(len(tokens) * COUNTED) + 1] >> np.uint64(24)
                if len(first) and held.setdefault(xxhash.xxh64_intdigest(tokens.tobytes()), first) is first:
                    size += len(first)
            if size > STRETCH:
                yield strings()
                held, size = {}, 0
        if held:
            yield strings()
        held.clear()
        tidy()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, tokens, counts = [], [], []
        for batch in batches:
            once.append(b"".join(batch.column("once").to_pylist()))
            for raw in batch.column("several").to_pylist():
                cut = len(raw) // 9 * 5
                tokens.append(long40(raw[:cut]))
                counts.append(np.frombuffer(raw, "<u4", offset=cut))
        single = long40(b"".join(once))
        tokens, at = np.unique(np.concatenate([single, *tokens]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.ones(len(single), np.int64), *counts]), len(tokens)).astype(np.int64)
        many = n > HOT
        yield pa.RecordBatch.from_arrays([pa.array(tokens[many]), pa.array(n[many])], names=["tok", "n"])

    counts = written(texts.mapInArrow(work, "bucket long, once binary, several binary").groupBy("bucket").applyInArrow(count, "tok long, n long"), "frequent")
    least, found = HOT, 0
    for size, n in sorted(map(tuple, counts.groupBy(F.floor(F.log2(F.col("n") / HOT))).agg(F.count("*")).collect()), reverse=True):
        found += n
        if found > HOT_TOKENS:
            least = HOT << int(size) + 1
            break
    return np.sort(counts.where(F.col("n") > least).select("tok").toPandas()["tok"].to_numpy(np.int64))


def within(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of the tokens (48 bits) begin as hot ones do (40 bits, ascending)."""
    if not len(hot):
        return np.zeros(len(tokens), bool)
    return hot[np.minimum(np.searchsorted(hot, tokens >> 8), len(hot) - 1)] == tokens >> 8


def in_order(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first tokens of a set (48 bits, ascending) in the order that puts hot tokens last."""
    return tokens[np.argsort(within(tokens, hot), kind="stable")][: first_tokens(len(tokens))]


def shingled(docs: DataFrame, key: str, text: str, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, first): set size, hash of the set, and its first tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            sizes, sigs, firsts = [], [], []
            for tokens in token_sets(part.column("utf8").to_pylist()):
                sizes.append(len(tokens))
                sigs.append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
                firsts.append(packed(in_order((tokens >> np.uint64(16)).astype(np.int64), hot)) if len(tokens) else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(firsts, pa.binary())], names=["doc_id", "n", "sig", "first"])
        tidy()

    return texts_of(docs, key, text).mapInArrow(work, "doc_id long, n long, sig long, first binary")


def first_rows(table: DataFrame, hot: np.ndarray) -> DataFrame:
    """(tok, salt, sig) of all sets' first tokens, once for each set and batch; ``salt`` is null but for hot tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = dict(zip(batch.column("sig").to_pylist(), batch.column("first").to_pylist(), strict=True))
            for i in range(0, len(sets), 500):
                some = list(sets.items())[i : i + 500]
                tokens = [long(raw) for _, raw in some]
                sig, tok = np.repeat(np.array([s for s, _ in some], np.int64), list(map(len, tokens))), np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array((sig % SALTS).astype(np.int32), mask=~within(tok, hot)), pa.array(sig)], names=["tok", "salt", "sig"])

    return table.where("n > 0").select("sig", "first").mapInArrow(work, "tok long, salt int, sig long")


def shared_tokens(table: DataFrame, reps: DataFrame, hot: np.ndarray) -> DataFrame:
    """(tok, rep, n): the first tokens that more than one node has, and all hot ones, whose rows are dealt out by a salt too."""
    rows = first_rows(table, hot)
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tok", "salt")
    same = Window.partitionBy("tok", "salt")
    several = F.col("salt").isNotNull() | (F.min("sig").over(same) != F.max("sig").over(same))
    found = dealt.withColumn("several", several).where("several").dropDuplicates(["tok", "salt", "sig"])
    return found.join(reps, "sig").select("tok", "rep", "n")


def bit_filter(ids: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """A Bloom filter over the ids, as 64-bit words."""
    bits = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(n_bits)) for k in range(2)])).alias("bit")
    words = ids.select(bits).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(n_bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, column: str, key: str, text: str) -> DataFrame:
    """(id, n, tokens) of the rows with these ids, and perhaps of a few more.

    The texts pass a filter of BITS_PER_ID bits for each id. Ids that would need more than FILTER_BITS are joined instead.
    """
    n_bits = 1 << max(12, (BITS_PER_ID * ids.count()).bit_length())
    rows = texts_of(docs, key, text).where("doc_id is not null")
    if n_bits > FILTER_BITS:
        rows, words, probes = rows.join(ids.select(F.col(column).alias("doc_id")), "doc_id", "left_semi"), None, []
    else:
        words = bit_filter(ids, column, n_bits)
        probes = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(n_bits)).alias(f"p{k}") for k in range(2)]

    n_probes = len(probes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passes = np.ones(batch.num_rows, bool)
            for k in range(n_probes):
                bit = batch.column(f"p{k}").to_numpy(zero_copy_only=False)
                passes &= (words[bit >> 6] >> (bit & 63) & 1).astype(bool)
            for part in blocks([batch.filter(pa.array(passes))]):
                tokens = token_sets(part.column("utf8").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, tokens)), pa.int64()), pa.array(list(map(short, tokens)), pa.binary())], names=["id", "n", "tokens"])
        tidy()

    return rows.select("*", *probes).mapInArrow(work, "id long, n long, tokens binary").where("n > 0")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link, each compared exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ra, rb in zip(views(batch.column("ta")), views(batch.column("tb")), strict=True):
                both = overlap(long(ra), long(rb))
                keep.append(100 * both >= 75 * ((len(ra) + len(rb)) // 6 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    left, right = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): the least node it is connected with.

    Large-star and small-star steps in turn, until no edge changes; each step's edges are a written table.
    """

    def step(edges: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        table = written(edges.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        return table, seen.get

    edges, before = step(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after, state = step(small)
        if state == before:
            break
        edges, before = after, state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def size_fits(n: Column, least: Column, most: Column) -> Column:
    """Whether a set of size n can link with one of a size in least..most."""
    return (4 * most >= 3 * n) & (4 * n >= 3 * least)


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each node b with up to STARS nodes a that share most of its tokens.

    Of each token's nodes, the one that shares the largest part of its own tokens with any node is a star, as an original
    among its edited copies would be, and the least ones by some hashes are others.
    """
    kinds = range(STARS)
    common = shared.groupBy("rep").agg((F.count("*") / F.first("n")).alias("q"))
    order = [F.struct("q", F.xxhash64("rep", F.lit(k))) if k == 0 else F.xxhash64("rep", F.lit(k)) for k in kinds]
    least = shared.join(common, "rep").groupBy("tok").agg(*[F.max_by(F.struct("rep", "n"), by).alias(f"lead{k}") for k, by in enumerate(order)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"lead{k}.rep").alias("a"), F.col(f"lead{k}.n").alias("m")) for k in kinds]))
    pairs = shared.join(least, "tok").select("rep", "n", each.alias("s")).select("rep", "n", "s.*").where("rep <> a").groupBy("rep", "n", "k", "a", "m").agg(F.count("*").alias("c"))
    alike = pairs.where(size_fits(F.col("n"), F.col("m"), F.col("m")) & (F.col("c") > F.least("n", "m") / 16))
    return alike.groupBy(F.col("rep").alias("b"), "k").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b").distinct()


def in_groups(shared: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tok, rep, n, comp, size, block) of the shared tokens, and the groups (comp, block, low, high): the sizes of their sets.

    ``size`` is the number of the component's nodes. Nodes without a link are a component each.
    """
    nodes = shared.select("rep", "n").distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / GROUP)).alias("block")
    nodes = written(nodes.join(sizes, "comp").select("rep", "n", "comp", "size", block), "groups")
    placed = shared.drop("n").join(nodes, "rep").select("tok", "rep", "n", "comp", "size", "block")
    return placed, nodes


def candidates(placed: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(rep, n, gcomp, block, low): query nodes with the groups of larger components that may hold a linked set.

    ``degrees``: (tok, k) with k groups, of two components or more. Tokens of more than HOT groups aren't expanded here.
    """
    used = degrees.where(F.col("k") <= HOT).select("tok")
    rows = placed.join(used, "tok")
    ranges = nodes.groupBy(F.col("comp").alias("gcomp"), F.col("size").alias("gsize"), "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = rows.select("tok", F.col("comp").alias("gcomp"), "block").distinct()
    cells = matrix.join(ranges, ["gcomp", "block"])
    larger = (F.col("size") < F.col("gsize")) | (F.col("size") == F.col("gsize")) & (F.col("comp") < F.col("gcomp"))
    met = rows.drop("block").join(cells, "tok").where(larger & size_fits(F.col("n"), F.col("low"), F.col("high")))
    met = met.groupBy("rep", "n", "gcomp", "block", "low", "high").agg(F.count("*").alias("c"))
    low, high = F.greatest(F.col("low"), 3 * F.col("n") / 4), F.least(F.col("high"), 4 * F.col("n") / 3)
    # of two sets all tokens up to the end of the shorter reach are known: what is left of one of them has to do
    least = lambda m: 3 * (F.col("n") + m) / 7 - 3 * F.greatest(F.col("n"), m) / 4 - 1
    return met.where(F.col("c") >= F.least(least(low), least(high))).select("rep", "n", "gcomp", "block", "low")


def group_links(met: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the links of candidates with the members ``own`` (rep, n, gcomp, block) of their groups."""
    of_rep = sets.select(F.col("id").alias("rep"), "tokens")

    def union(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.zeros(0, np.int64)
        for batch in groups:
            tokens = np.unique(np.concatenate([tokens, *(long(raw) for raw in views(batch.column("tokens")))]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([packed(tokens)], pa.binary())], names=["gcomp", "block", "tu"])

    unions = own.join(of_rep, "rep").select("gcomp", "block", "tokens").groupBy("gcomp", "block").applyInArrow(union, "gcomp long, block long, tu binary")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for raw, whole, low in zip(views(batch.column("tokens")), views(batch.column("tu")), batch.column("low").to_pylist(), strict=True):
                n = len(raw) // 6
                keep.append(overlap(long(raw), long(whole)) >= max(needed(n), -(-3 * (n + low) // 7)))
            yield batch.select(["rep", "n", "gcomp", "block"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    queries = met.join(of_rep, "rep").join(unions, ["gcomp", "block"]).select("rep", "n", "gcomp", "block", "low", "tokens", "tu")
    opened = queries.mapInArrow(bound, "rep long, n long, gcomp long, block long").join(own.select("gcomp", "block", F.col("rep").alias("b"), F.col("n").alias("m")), ["gcomp", "block"])
    return linked(opened.where(size_fits(F.col("n"), F.col("m"), F.col("m"))).select(F.col("rep").alias("a"), "b").distinct(), sets)


def in_blocks(placed: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks (gid, rep, comp) of nodes that share a token of more than HOT groups, and the pairs (ga, gb) of blocks to compare.

    A node goes by its most frequent such token. A component that fills a block with the nodes of one token has blocks of
    its own, which needn't meet each other; all others are mixed.
    """
    rows = placed.join(degrees.where(F.col("k") > HOT), "tok")
    homes = rows.groupBy("rep", "n", "comp").agg(F.max_by("tok", F.struct("k", "tok")).alias("home"))
    alone = homes.groupBy("home", "comp").agg(F.count("*").alias("alike"))
    kinds = homes.join(alone, ["home", "comp"]).withColumn("kind", F.when(F.col("alike") >= BLOCK, F.col("comp")))
    sizes = kinds.groupBy("home", "kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("many"))
    same = (F.col("home") == F.col("h")) & F.col("kind").eqNullSafe(F.col("c"))
    gid = F.concat_ws(":", "home", F.coalesce(F.col("kind").cast("string"), F.lit("mixed")), F.pmod(F.xxhash64("rep"), F.col("many"))).alias("gid")
    members = written(kinds.join(sizes.select(F.col("home").alias("h"), F.col("kind").alias("c"), "many"), same).select(gid, "kind", "rep", "n", "comp"), "blocks")
    ranges = members.groupBy("gid", "kind").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    cells = rows.select("tok", "rep").join(members.select("rep", "gid"), "rep").select("tok", "gid").distinct().join(ranges, "gid")
    other = cells.select("tok", *[F.col(c).alias(f"{c}_b") for c in ("gid", "kind", "low", "high")])
    apart = F.col("kind").isNull() | F.col("kind_b").isNull() | (F.col("kind") != F.col("kind_b"))
    fits = (4 * F.col("high") >= 3 * F.col("low_b")) & (4 * F.col("high_b") >= 3 * F.col("low"))
    pairs = cells.join(other, "tok").where((F.col("gid") <= F.col("gid_b")) & apart & fits)
    return members, written(pairs.select(F.col("gid").alias("ga"), F.col("gid_b").alias("gb")).distinct(), "block-pairs")


def compared(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Links between the nodes of two blocks, enough to connect their components.

    A block: (nodes, their components, sizes of their sets, the sets end to end).
    """
    union, at = np.unique(b[3], return_inverse=True)
    n_b = len(b[0])
    order = np.argsort(at, kind="stable")
    member = np.repeat(np.arange(n_b), b[2])[order]
    first = np.searchsorted(at[order], np.arange(len(union) + 1))
    where = np.searchsorted(union, a[3])
    where[where == len(union)] = 0
    hit = union[where] == a[3] if len(union) else np.zeros(len(a[3]), bool)
    query = np.repeat(np.arange(len(a[0])), a[2])
    bound = np.bincount(query[hit], minlength=len(a[0]))
    n = a[2]
    hit &= (bound >= np.maximum(-(-3 * n // 4), -(-3 * (n + int(b[2].min())) // 7)))[query]  # the blocks that stay shut for a node
    where, query = where[hit], query[hit]
    many = first[where + 1] - first[where]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    found: list[tuple[int, int]] = []
    ends = np.cumsum(many)
    i = 0
    while i < len(where):  # whole queries, about OPENED counts at a time
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + OPENED, side="right")), i + 1)
        j = int(np.searchsorted(query, query[j - 1], side="right"))
        m = many[i:j]
        flat = np.repeat(first[where[i:j]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        lowest = int(query[i])
        both = np.bincount((np.repeat(query[i:j], m) - lowest) * n_b + member[flat], minlength=(int(query[j - 1]) - lowest + 1) * n_b)
        cell = np.flatnonzero(both)
        q, v = cell // n_b + lowest, cell % n_b
        links = (100 * both[cell] >= 75 * (n[q] + b[2][v] - both[cell])) & (a[1][q] != b[1][v])
        q, v = q[links], v[links]
        _, one = np.unique(np.stack([a[1][q], b[1][v]], 1), axis=0, return_index=True)
        for k in one.tolist():
            x, y = root(int(a[1][q[k]])), root(int(b[1][v[k]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((int(a[0][q[k]]), int(b[0][v[k]])))
        i = j
    return found


def block_links(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the links between the nodes of each pair of blocks; a block is one row."""

    def gather(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, comps, tokens = [], [], []
        for batch in groups:
            reps += batch.column("rep").to_pylist()
            comps += batch.column("comp").to_pylist()
            tokens += batch.column("tokens").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([reps]), pa.array([comps]), pa.array([[len(raw) // 6 for raw in tokens]]), pa.array([b"".join(tokens)], pa.binary())], names=["gid", "reps", "comps", "sizes", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = ((*(np.array(batch.column(f"{c}_{k}")[row].as_py(), np.int64) for c in ("reps", "comps", "sizes")), long(batch.column(f"tokens_{k}")[row].as_buffer())) for k in "ab")
                found = compared(a, b)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("ga", "gb")).alias("gid")).distinct()
    own = members.join(wanted, "gid", "left_semi").join(sets.select(F.col("id").alias("rep"), "tokens"), "rep").select("gid", "rep", "comp", "tokens").distinct()
    whole = written(own.groupBy("gid").applyInArrow(gather, "gid string, reps array<long>, comps array<long>, sizes array<long>, tokens binary"), "blocks")
    side = lambda k: whole.select(F.col("gid").alias(f"g{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("reps", "comps", "sizes", "tokens")])
    return pairs.join(side("a"), "ga").join(side("b"), "gb").drop("ga", "gb").mapInArrow(compare, "a long, b long")


def node_components(docs: DataFrame, table: DataFrame, reps: DataFrame, repeats: DataFrame, hot: np.ndarray, key: str, text: str) -> DataFrame:
    """(node, comp) of the nodes that link with others, or are tied to them by ``repeats`` (a, b)."""
    of = lambda ids: written(sets_of(docs, ids, "rep", key, text), "sets")
    shared = written(shared_tokens(table, reps, hot), "shared")
    if shared.isEmpty():
        return components(repeats)
    pairs = written(star_pairs(shared), "pairs")
    stars = linked(pairs, of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()))
    comps = components(stars.unionByName(repeats))
    placed, nodes = in_groups(shared, comps)
    placed = written(placed, "placed")
    cells = placed.select("tok", "comp", "block").distinct()
    degrees = written(cells.groupBy("tok").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok", "k"), "degrees")
    met = written(candidates(placed, nodes, degrees), "candidates")
    own = nodes.withColumnRenamed("comp", "gcomp").join(met.select("gcomp", "block").distinct(), ["gcomp", "block"]).select("rep", "n", "gcomp", "block")
    ids = met.select("rep").unionByName(own.select("rep"))
    members = None
    if not degrees.where(F.col("k") > HOT).isEmpty():
        members, block_pairs = in_blocks(placed, degrees)
        ids = ids.unionByName(members.join(block_pairs.select(F.explode(F.array("ga", "gb")).alias("gid")).distinct(), "gid", "left_semi").select("rep"))
    elif met.isEmpty():
        return comps
    sets = of(ids.distinct())
    found = group_links(met, own, sets)
    found = written(found if members is None else found.unionByName(block_links(block_pairs, members, sets)), "links")
    if found.isEmpty():
        return comps
    # what was found lies between components: they are joined as wholes
    of_node = nodes.select(F.col("rep").alias("node"), "comp")
    for side in "ab":
        found = found.join(of_node.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")), side)
    joined = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    before = comps.unionByName(nodes.select(F.col("comp").alias("node"), "comp").distinct()).distinct()
    return before.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("c")), "comp", "left").select("node", F.coalesce("c", "comp").alias("comp"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row: set size, and the least key reachable by links, its own included.

    A document without words (empty, null) links with nothing. Rows that repeat a key are one document, linked by any of
    their texts. A row without a key makes no link; it gets the component of the documents with an equal set, else null.
    An empty table gives no rows.
    """
    return components_of_sets(docs, key, text).drop("sig")


def components_of_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, component_id, sig) of each row, with the hash of its set: a written table."""
    with tables_in_between(docs.sparkSession):
        hot = frequent_tokens(docs, key, text)
        table = written(shingled(docs, key, text, hot), "shingles")
        reps = written(table.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("rep")), "nodes")
        rows = table.select("doc_id", "n", "sig").join(reps.select("sig", "n", "rep"), ["sig", "n"], "left")
        # rows that repeat a key with other texts: all their sets belong together
        placed = rows.where("doc_id is not null and rep is not null").select("doc_id", "rep")
        several = placed.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b <> c").select("doc_id", "b")
        repeats = placed.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
        comps = node_components(docs, table, reps, repeats, hot, key, text)
        rows = rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "rep"))
        return written(rows.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), "sig"), "jaccard", keep=True)


def with_sets(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the size and the hash of each row's set."""
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place).cast(pa.binary()).fill_null(b"")], names=["i", "utf8"])
            at = 0
            for part in blocks([whole]):
                sets = [(len(tokens), xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)) for tokens in token_sets(part.column("utf8").to_pylist())]
                columns = [*batch.slice(at, part.num_rows).columns, pa.array([n for n, _ in sets], pa.int64()), pa.array([sig for _, sig in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__n", "__sig"])
                at += part.num_rows

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField("__n", LongType()), StructField("__sig", LongType())]))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least key of their component, with all their columns.

    Rows without a key stay unless a document has an equal set.
    """
    found = components_of_sets(docs, key, text)
    own = F.col(key).cast("long")
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct()
    copied = found.where(F.col(key).isNull() & F.col("component_id").isNotNull()).select(F.col("n_shingles").alias("__n"), F.col("sig").alias("__sig")).distinct()
    kept = docs.where(own.isNotNull()).join(gone, own == F.col("__gone"), "left_anti")
    keyless = with_sets(docs.where(own.isNull()), text).join(copied, ["__n", "__sig"], "left_anti")
    return kept.unionByName(keyless.select(*docs.columns))
