"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each distinct run of five words (a shingle) is hashed once. The top bits of its hash choose
one of BINS bins, the lowest hash of a bin represents it. A bin that got no shingle takes
the value of another by optimal densification: it probes the bins in an order of its own,
an order that depends on the empty bin alone, and copies the first that has a value, so
equal sets fill their bins equally and no bin is favoured. Each bin's value is then hashed
with the bin's number and the low BITS bits are kept, in hexadecimal: bins that copied the
same value agree by chance independently of one another. Two fingerprints agree by chance in
a share of 2**-BITS of the bins; ``likeness`` corrects for that.

Words are runs of characters other than ASCII white space, in lower case. A text of fewer
than five words is one shingle; a text without words (empty, null) has the empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0).
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import WORD_SPLIT, input_parts, literals
from meshloom.llm.token_file import quantile_bounds, range_part

#: Words in a shingle.
SHINGLE = 5
#: Bins of a fingerprint, a power of two.
LOG_BINS = 7
BINS = 1 << LOG_BINS
#: Bits kept of each bin: two hexadecimal digits.
BITS = 8


@cache
def probe_orders() -> str:
    """For each bin the order in which it probes all bins, as JSON: the bins sorted by a hash of both."""

    def mix(x: int) -> int:
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & (1 << 64) - 1
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & (1 << 64) - 1
        return x ^ (x >> 33)

    return json.dumps([sorted(range(BINS), key=lambda b: (mix((own + 1 << 32) + b + 1), b)) for own in range(BINS)])


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT, -1), "")


def with_bins(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the array ``name`` of the low bits of all bins (empty without words).

    One projection for each step, so that no step is evaluated again inside the next.
    """
    w, h, m, b = (f"__{name}_{x}" for x in "whmb")
    n = F.size(w)
    shingles = F.when(n > SHINGLE, F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).when(n > 0, F.array(F.xxhash64(F.col(w))))
    df = df.withColumn(w, words_of(F.col(text)))
    # the sign bit goes, so that the order of numbers is that of the hashes; sorted, a bin's lowest hash comes first
    positive = F.transform(F.coalesce(shingles, F.array().cast("array<bigint>")), lambda x: F.shiftrightunsigned(x, 1))
    df = df.withColumn(h, F.sort_array(positive)).drop(w)
    bin_of = lambda x: F.shiftrightunsigned(x, 63 - LOG_BINS)
    shifted = F.concat(F.array(F.lit(-1).cast("bigint")), F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))))
    first = F.array_compact(F.zip_with(F.col(h), shifted, lambda x, before: F.when((before < 0) | (bin_of(x) != bin_of(before)), x)))
    df = df.withColumn(m, F.when(F.size(h) > 0, first).otherwise(F.array().cast("array<bigint>"))).drop(h)
    df = df.withColumn(b, F.transform(m, lambda x: bin_of(x).cast("int")))
    source = F.transform(F.from_json(F.lit(probe_orders()), "array<array<int>>"), lambda order, own: F.coalesce(F.nullif(F.array_position(b, own), F.lit(0)), F.array_position(b, F.element_at(F.array_intersect(order, F.col(b)), 1))).cast("int"))
    kept = lambda at, own: F.xxhash64(F.element_at(m, at), own).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return df.withColumn(name, F.when(F.size(b) > 0, F.transform(source, kept)).otherwise(F.array().cast("array<int>"))).drop(b, m)


def packed_hex(bins: str) -> Column:
    """The bins' low bits in hexadecimal, in the order of the bins."""
    return F.array_join(F.transform(bins, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two arrays of bins, corrected for chance, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each text; nothing is shuffled."""
    return with_bins(docs.select(key, text), text, "bins").select(key, packed_hex("bins").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the start of the next document's.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next document is the one
    with the next lower key, the last one's is the first; rows with the same key follow one another by text. A row
    without a key has no place in the order: its next document is empty. An empty table gives no rows.

    The rows go to ranges of the key in one shuffle. Each range also gets the row that follows its last one, the first of
    the range below it, so every row finds its next one in its own range.
    """
    parts = parts or input_parts(docs.select(key))
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bounds = quantile_bounds(docs, key, parts)
    part = F.lit(len(bounds)) - range_part(F.col(key), bounds)  # ranges in descending order of the key
    tops = sorted(tuple(r) for r in rows.where(F.col(key).isNotNull()).groupBy(part.alias("part")).agg(F.max(key)).collect())
    keyed = with_bins(rows.where(F.col(key).isNotNull()), "t", "bins").withColumn("part", part)
    top, above = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for (p, k), (q, _) in zip(tops, [*tops[-1:], *tops[:-1]], strict=True):
        top[p], above[p] = k, q
    own = F.struct(F.col("part").alias("p"), F.lit(0).alias("extra"))
    twice = F.array(own, F.struct(F.element_at(literals(above, "int"), F.col("part") + 1).alias("p"), F.lit(1).alias("extra")))
    is_top = F.col(key) == F.element_at(literals(top), F.col("part") + 1)
    dealt = keyed.withColumn("to", F.explode(F.when(is_top, twice).otherwise(F.array(own)))).select(key, "t", "bins", "to.*")
    window = Window.partitionBy("p").orderBy("extra", F.col(key).desc(), F.col("t").desc())
    ordered = dealt.repartitionById(len(top), F.col("p"))
    paired = ordered.select(key, "t", "bins", "extra", F.lead("t").over(window).alias("next_t"), F.lead("bins").over(window).alias("next_bins")).where("extra = 0").drop("extra")
    loose = with_bins(rows.where(F.col(key).isNull()), "t", "bins").select(key, "t", "bins", F.lit("").alias("next_t"), F.array().cast("array<int>").alias("next_bins"))
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = paired.unionByName(loose).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("t", F.lit(1), n - half), F.substring("next_t", F.lit(1), half))).drop("t", "next_t")
    done = with_bins(edited, "edited", "edited_bins")
    return done.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed_hex("bins").alias("fingerprint"), packed_hex("edited_bins").alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )
