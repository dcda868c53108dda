"""Pages of a large ordered table by a rank index: ranges in order with their counts, so a page reads its own ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_tramo"
#: A table newest first.
NEWEST = ["anio desc nulls last", "numero desc nulls last", "id asc nulls last"]


def _order(order: list[str]) -> list[Column]:
    out = []
    for text in order:
        name, way, *nulls = text.split()
        c = F.col(name)
        out.append({("desc", "last"): c.desc_nulls_last, ("desc", "first"): c.desc_nulls_first, ("asc", "last"): c.asc_nulls_last, ("asc", "first"): c.asc_nulls_first}[way, nulls[-1]]())
    return out


def write_ranks(rows: DataFrame, path: str, order: list[str] = NEWEST, ranges: int = 64) -> None:
    """Write rows in ranges of the order (a total one) below ``path``, and the number of rows before each range."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges, *_order(order)).withColumn(RANGE, F.spark_partition_id())
    dealt.sortWithinPartitions(RANGE, *_order(order)).write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    sizes = spark.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    sizes.withColumn("antes", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


@dataclass
class Page:
    """Rows with their ``puesto`` from 1, the number of all rows, and the next cursor, or none."""

    rows: DataFrame
    total: int
    next_cursor: int | None
    ranges: list[int]


def rank_page(spark: SparkSession, path: str, schema: T.StructType, cursor: int = 0, limit: int = 20, order: list[str] = NEWEST) -> Page:
    """The ``limit`` rows from place ``cursor`` on; only the ranges that hold them are read."""
    if limit < 1 or cursor < 0:
        raise ValueError("limit or cursor is out of bounds")
    sizes = spark.read.parquet(f"{path}/ranges")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = sizes.filter((F.col("antes") < cursor + limit) & (F.col("antes") + F.col("n") > cursor)).select(RANGE, "antes").collect()
    first = {r[RANGE]: r["antes"] for r in own}
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{path}/rows").filter(F.col(RANGE).isin(list(first)))
    base = F.coalesce(*[F.when(F.col(RANGE) == k, v) for k, v in first.items()], F.lit(0))
    place = base + F.row_number().over(Window.partitionBy(RANGE).orderBy(*_order(order)))
    rows = rows.withColumn("puesto", place.cast("long")).filter((F.col("puesto") > cursor) & (F.col("puesto") <= cursor + limit)).drop(RANGE)
    return Page(rows, total, cursor + limit if cursor + limit < total else None, sorted(first))
