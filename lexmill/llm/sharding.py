"""Sharding by jump consistent hashing: a stable key and the shard count decide, without a table of ring points.

Going from n to n + 1 shards moves only the rows that the new shard takes. Slots number the rows of a shard from 0
without gaps. A shard is cut into ranges by a hash of whole rows, so that the rows of a hot key (or of no key) spread over
ranges too; slots come from counts of the ranges and each row's number in its range, so no task holds a whole shard.

Cases: a null key hashes as its own value; rows of one key go to one shard and get different slots; a row's slot depends
on the table's rows alone, whatever their order or layout, and rows equal in all columns (maps left out) share the slots
of their place; where they fill a range, their distinct rows are counted and the copies dealt in pieces (in tables with maps
one task numbers such a range, with spill); a null text has no bytes; an empty table gives no rows; other columns
are left alone, but for those that have a result's name, which it replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.frames import free
from lexmill.session import save, ship_package, table

#: Rows that a hash range of a shard should hold.
RANGE_ROWS = 20_000
#: A range of so many times as many rows has a row with many copies.
HEAVY = 4


def jump(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each unsigned 64-bit key, and with one more shard; after few steps (log of the shards) no key jumps any more."""
    keys = keys.astype(np.uint64, copy=True)
    at, to = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(left):
            at[left] = to[left]
            keys[left] = keys[left] * np.uint64(2862933555777941757) + np.uint64(1)
            to[left] = ((at[left] + 1) * (float(1 << 31) / ((keys[left] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            left = left[to[left] < shards]
    return at, np.where(to == shards, to, at)


def jump_columns(key, shards: int):
    """The shard and the grown shard (struct of ints) of a 64-bit hash column."""
    ship_package(SparkSession.active())

    @F.arrow_udf("struct<shard:int,grown:int>")
    def place(h: pa.Array) -> pa.Array:
        own, grown = jump(h.to_numpy(), shards)
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(grown, pa.int32())], ["shard", "grown"])

    return place(key)


def _copies(rows: DataFrame, slot: str, within: list[str], order: list[str]) -> DataFrame:
    """``rows`` numbered within ranges by running counts of distinct rows, whose copies are dealt in pieces of ``RANGE_ROWS``."""
    count, base, start = free(rows, "_copies", "_base", "_start")
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    distinct = distinct.withColumn(base, F.coalesce(F.sum(count).over(before), F.lit(0)))
    pieces = distinct.withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(RANGE_ROWS).cast("long")))).repartition(*within, start)
    each = F.sequence(F.col(start), F.least(F.col(start) + RANGE_ROWS, F.col(count)) - 1)
    return pieces.withColumn(slot, F.explode(each)).withColumn(slot, (F.col(base) + F.col(slot)).cast("int")).select(*rows.columns, slot)


def shard(docs: DataFrame, shards: int, key_col: str = "doc_id", prefix: str = "") -> DataFrame:
    """``docs`` with ``shard``, ``slot`` and ``grown_shard`` (with one more shard), named with ``prefix``.

    Columns of these names are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ship_package(docs.sparkSession)
    own, slot, grown = (f"{prefix}{x}" for x in ("shard", "slot", "grown_shard"))
    docs = docs.drop(own, slot, grown)
    place, one, two, part, base, s, r = free(docs, "_place", "_one", "_two", "_range", "_base", "_s", "_r")
    rows = docs.count()
    ranges = max(1, -(-rows // (shards * RANGE_ROWS)))
    whole = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    no_maps = len(whole) == len(docs.columns)
    docs = docs.withColumn(place, jump_columns(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("\0null"))), shards))
    docs = docs.withColumn(own, F.col(f"{place}.shard")).withColumn(grown, F.col(f"{place}.grown")).drop(place)
    docs = docs.withColumn(one, F.xxhash64(*whole)).withColumn(part, F.pmod(one, F.lit(ranges)).cast("int"))
    sizes = save(docs.groupBy(F.col(own).alias(s), F.col(part).alias(r)).count(), "ranges")
    before = Window.partitionBy(s).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(s, r, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    docs = docs.withColumn(two, F.xxhash64(F.lit(1), *whole))
    number = F.row_number().over(Window.partitionBy(own, part).orderBy(one, two)) - 1
    in_range = (F.col(own) == F.col(s)) & (F.col(part) == F.col(r))
    heavy = sizes.filter(F.col("count") > HEAVY * RANGE_ROWS).select(s, r)
    if no_maps and not heavy.isEmpty():
        light = docs.join(heavy, in_range, "left_anti").withColumn(slot, number)
        numbered = light.unionByName(_copies(docs.join(heavy, in_range, "left_semi"), slot, [own, part], [one, two]))
    else:
        numbered = docs.withColumn(slot, number)
    placed = numbered.join(offsets, in_range)
    return placed.withColumn(slot, (F.col(base) + F.col(slot)).cast("long")).drop(s, r, base, one, two, part)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``key``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard(docs, 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
