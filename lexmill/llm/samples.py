"""Bounded samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import save

#: Class counts are broadcast up to this many classes; more are joined by shuffle.
BROADCAST_CLASSES = 10_000
#: Bytes of the texts of a sample, which the driver holds.
MOST_BYTES = 64 << 20
#: How many times as many rows as a class may give pass the hash before they are ranked.
SLACK = 2


def sample_rows(rows: DataFrame, label: str, keys: list[str], per_class: int, most: int, text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """At most ``per_class`` rows of each value of ``label`` and ``most`` in all, whole, with their ``rank`` in the class, and
    of these the ranks whose texts have ``most_bytes`` together; where rank 1 alone has more, its texts of a fair share.

    The draw is by a hash of ``keys`` (the id and the text, so that copies of a text are drawn one by one): exact class
    counts give the share of the hash's range that passes, twice what is asked for, and the least hashes of those stay.
    Rows equal in all keys pass together, and are then cut at the bound like others. The counts stay on Spark; with
    more classes than ``most``, some have no row.
    """
    counts = rows.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_count"))
    counts = save(counts, "classes")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_CLASSES else counts
    share = F.lit(float(SLACK * per_class)) / F.col("_count") * float(1 << 52)
    h = F.shiftrightunsigned(F.xxhash64(*keys), 12)
    passed = rows.withColumn("_h", h).join(counts, F.col(label) == F.col("_class")).filter(F.col("_h") < share).drop("_class", "_count")
    order = [F.col(x) for x in ("_h", *keys)]
    ranked = passed.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order))).filter(F.col("rank") <= per_class)
    sample = save(ranked.orderBy("rank", label).limit(most), "sample")
    size = F.coalesce(F.octet_length(text), F.lit(0))
    totals = sorted(sample.groupBy("rank").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
    last, used = 0, 0
    for rank, held, _ in totals:
        used += held
        if used > most_bytes:
            break
        last = rank
    if totals and not last:
        return sample.filter((F.col("rank") == 1) & (size <= most_bytes // totals[0].n)).orderBy(label)
    return sample.filter(F.col("rank") <= last).orderBy("rank", label)
