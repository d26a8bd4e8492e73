"""Shards of nearly equal size by fixed virtual slots, in DataFrame functions only.

Every record belongs to one of SLOTS virtual slots by the hash of its key, for good. Bytes are
summed for each slot, and a versioned map says which shard holds which slot. Records never
move on their own: to rebalance, or to add a shard, slots are given another shard in the map,
as few bytes as will do, and the edited map is stored under the next version (``edited``,
``stored``, ``map_of``). Old versions stay readable.

A slot can be far larger than the rest: all records that lack a key, or share one, are in the
same. Such a slot, one of more than 1/HEAVY of a shard's share, is dealt by LOTS of single
rows, each with an entry of its own in the map; every other slot has one entry, lot -1.

The texts are read once: the key, size, checksum, slot and lot of each record are written
down, and everything else reads that table. A record's place in its shard is the running sum
of the shard's entries before its own plus its number among those of its entry, so no task
ever holds a whole shard. The map has SLOTS * LOTS entries at most, at any size of the corpus.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.llm.common import written

SLOTS, LOTS = 4096, 64
#: A slot above this part of a shard's share is dealt by lots.
HEAVY = 32

MAP = "version int, slot int, lot int, shard int, bytes long, rows long"
Entry = tuple[int, int]


def slot_of(key: Column) -> Column:
    """The virtual slot of a key, which depends on nothing else (null: a slot of its own)."""
    return F.coalesce(F.pmod(F.xxhash64(key.cast("string")), F.lit(SLOTS)), F.lit(0)).cast("int")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, slot, lot) of each record; a null text has no bytes. The size counts one byte more than the text."""
    utf8 = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    one = F.monotonically_increasing_id()  # rows that are alike in everything also go to different lots
    return docs.select(
        F.col(key).cast("long").alias(key), (F.octet_length(utf8) + F.lit(1)).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"),
        slot_of(F.col(key)).alias("slot"), F.pmod(F.xxhash64(one), F.lit(LOTS)).cast("int").alias("lot"),
    )


def measured(records: DataFrame, shards: int) -> dict[Entry, tuple[int, int]]:
    """(bytes, rows) of each entry (slot, lot) that the map needs; of SLOTS * LOTS rows at most."""
    lots = records.groupBy("slot", "lot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    whole = Window.partitionBy("slot")
    heavy = F.sum("bytes").over(whole) * F.lit(shards * HEAVY) > F.lit(records.agg(F.sum("size")).first()[0] or 0)
    entry = lots.withColumn("lot", F.when(heavy, F.col("lot")).otherwise(-1)).groupBy("slot", "lot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return {(r["slot"], r["lot"]): (r["bytes"], r["rows"]) for r in entry.collect()}


def balanced(sizes: dict[Entry, int], shards: int) -> dict[Entry, int]:
    """A shard for each entry: the largest first, each to the lightest shard, then exchanges between shards."""
    load, out = [0] * shards, {}
    for entry in sorted(sizes, key=lambda e: (-sizes[e], e)):
        out[entry] = min(range(shards), key=lambda s: (load[s], s))
        load[out[entry]] += sizes[entry]
    return evened(out, sizes, shards)


def evened(shard_of: dict[Entry, int], sizes: dict[Entry, int], shards: int) -> dict[Entry, int]:
    """The map after exchanges of single entries that bring the heaviest and the lightest shard nearer, while there are any."""
    out = dict(shard_of)
    load = [0] * shards
    own: list[list[tuple[int, Entry]]] = [[] for _ in range(shards)]
    for entry, shard in out.items():
        load[shard] += sizes[entry]
        own[shard].append((sizes[entry], entry))
    for entries in own:
        entries.sort()
    for _ in range(64 * shards):
        high, low = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap, best = load[high] - load[low], None
        for size, entry in own[high]:  # for its place either nothing or the entry that leaves the smallest gap
            at = bisect.bisect_left(own[low], (size - gap // 2, (-1, -2)))
            for other in [(0, None), *own[low][max(0, at - 1) : at + 1]]:
                moved = size - other[0]
                if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                    best = abs(gap - 2 * moved), (size, entry), other
        if best is None or best[0] >= gap:
            break
        _, there, back = best
        for entry, source, target in ((there, high, low), (back, low, high)):
            if entry[1] is not None:
                own[source].remove(entry)
                bisect.insort(own[target], entry)
                out[entry[1]] = target
                load[source] -= entry[0]
                load[target] += entry[0]
    return out


def edited(shard_of: dict[Entry, int], sizes: dict[Entry, int], shards: int) -> dict[Entry, int]:
    """A map for ``shards`` shards made from an earlier one by giving away no more than what shards have above an equal share.

    Shards that are over their share, and those that are no more, give entries, the largest that fit first; the lightest shard
    takes each: a new one until it is as full as the others. Entries that the earlier map lacks go the same way.
    """
    share = sum(sizes.values()) / shards
    out, load, free = {}, [0] * shards, []
    for entry in sorted(sizes, key=lambda e: (-sizes[e], e)):
        shard = shard_of.get(entry, shard_of.get((entry[0], -1)))
        if shard is not None and shard < shards:
            out[entry] = shard
            load[shard] += sizes[entry]
        else:
            free.append(entry)
    for entry in sorted(out, key=lambda e: (-sizes[e], e)):
        shard = out[entry]
        if load[shard] - sizes[entry] >= share:
            load[shard] -= sizes[entry]
            free.append(entry)
            del out[entry]
    for entry in sorted(free, key=lambda e: (-sizes[e], e)):
        out[entry] = min(range(shards), key=lambda s: (load[s], s))
        load[out[entry]] += sizes[entry]
    return out


def map_table(spark: SparkSession, version: int, shard_of: dict[Entry, int], measures: dict[Entry, tuple[int, int]], before: dict[Entry, int] | None = None) -> DataFrame:
    """The map's rows of one version: all entries, or those that differ from the version before."""
    changed = [(version, *e, s, *measures[e]) for e, s in sorted(shard_of.items()) if before is None or before.get(e) != s]
    return spark.createDataFrame(changed, MAP)


def stored(versions: Iterable[DataFrame]) -> DataFrame:
    """The map with all its versions, as a table in the shared folder."""
    first, *rest = versions
    for one in rest:
        first = first.unionByName(one)
    return written(first, "slot-map", keep=True)


def map_of(table: DataFrame, version: int) -> DataFrame:
    """(slot, lot, shard, bytes, rows) as of a version: of each entry the last row up to it."""
    last = F.max_by(F.struct("shard", "bytes", "rows"), "version").alias("m")
    return table.where(F.col("version") <= version).groupBy("slot", "lot").agg(last).select("slot", "lot", "m.*")


def placed(records: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """``records`` with shard, virtual_slot, lot (of the map's entry) and slot: the place in the shard, gapless from 0."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot", "entry_lot")) - F.col("rows")  # SLOTS * LOTS rows at most
    entries = slot_map.withColumnsRenamed({"slot": "virtual_slot", "lot": "entry_lot"}).select("virtual_slot", "entry_lot", "shard", before.alias("before"))
    # an entry has its own lot in the map or -1: the slots that are dealt by lots are few
    heavy = F.broadcast(slot_map.where("lot >= 0").select(F.col("slot").alias("virtual_slot")).distinct().withColumn("dealt", F.lit(True)))
    rows = records.withColumnRenamed("slot", "virtual_slot").join(heavy, "virtual_slot", "left")
    rows = rows.withColumn("entry_lot", F.when(F.col("dealt"), F.col("lot")).otherwise(-1)).drop("dealt", "lot")
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "entry_lot").orderBy(key, "text_crc32", "size")) - 1
    numbered = rows.withColumn("nth", nth).join(F.broadcast(entries), ["virtual_slot", "entry_lot"])
    return numbered.withColumn("slot", (F.col("before") + F.col("nth")).cast("long")).drop("before", "nth").withColumnRenamed("entry_lot", "lot")


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, next_shard) of each record.

    The law is ``bytes``: shards are as near in size as whole slots (or lots of heavy slots) allow. slot is the place in the
    shard. next_shard is the shard under the next version of the map, edited for one shard more: what was within its new share
    stays. grown_shard is null, as bytes and not the key alone decide. Null keys are records like others;
    rows that repeat a key share its slot; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    records = written(sized(docs, key, text), "records", keep=True)
    measures = measured(records, shards)
    sizes = {e: b for e, (b, _) in measures.items()}
    first = balanced(sizes, shards)
    grown = edited(first, sizes, shards + 1)
    table = stored([map_table(spark, 1, first, measures), map_table(spark, 2, grown, measures, first)])
    later = map_of(table, 2).select(F.col("slot").alias("virtual_slot"), "lot", F.col("shard").alias("next_shard"))
    rows = placed(records, map_of(table, 1), key).join(F.broadcast(later), ["virtual_slot", "lot"])
    return rows.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")
