"""Incremental ingest with Structured Streaming: new files once, known content ids never twice, failures set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmill.operators.joins import append_new


def stream_tables(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; each is read once, as the checkpoint remembers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Partitions of an ingest's target, by a hash of the key.
BUCKETS = 64
BUCKET = "cubo"


def auto_ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "contenido_id", order: str = "boletin", once: bool = True, interval: str = "60 seconds", prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append rows whose key the target doesn't have. A batch that is run again after a failure appends nothing twice.

    The target is partitioned by ``cubo``, a hash of the key, so a batch reads known keys only where its own fall (at most
    ``BUCKETS`` numbers reach the driver). ``once`` takes what is there and ends; else a batch starts at every ``interval``.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = (prepare(rows) if prepare else rows).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        rows.persist()
        try:
            touched = [r[0] for r in rows.filter(F.col(key).isNotNull()).select(BUCKET).distinct().collect()]
            try:
                known = spark.read.parquet(target).filter(F.col(BUCKET).isin(touched)).select(key)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                known = rows.select(key).limit(0)
            append_new(known, rows, key, order).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(target)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def first_arrivals(stream: DataFrame, key: str = "contenido_id", time_col: str | None = None, delay: str | None = None) -> DataFrame:
    """A stream's rows with the first of each key, by Spark's state store.

    With ``time_col`` and ``delay``, state is kept for that delay only: a key that comes again later than that counts as
    new. Without them it is kept for ever, which suits bounded key sets; use ``auto_ingest`` where keys go on growing.
    """
    if time_col is None or delay is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def staged(rows: DataFrame, result: str, error: str) -> DataFrame:
    """``rows`` with ``estado``: error where there is an error, done where there is a result, else pending."""
    return rows.withColumn("estado", F.when(F.col(error).isNotNull(), "error").when(F.col(result).isNotNull(), "hecho").otherwise("pendiente"))


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what goes on, what is set aside)."""
    return rows.filter("estado <> 'error'"), rows.filter("estado = 'error'")


def retry(rows: DataFrame, tried: str = "intentos", most: int = 3) -> DataFrame:
    """Failed rows that have tries left, pending again."""
    return rows.filter((F.col("estado") == "error") & (F.col(tried) < most)).withColumn("estado", F.lit("pendiente")).withColumn(tried, F.col(tried) + 1)
