"""Retries of failing items by keyed state and timers: waits that double, a limit of tries, a quarantine.

Each item keeps its failures, whether it has succeeded, and when it may be tried again. A failure sets a timer, which
fires once the stream's time has passed it, and says that the item is due; after ``most`` failures it goes to quarantine
instead. A success ends the item, whatever else comes. State survives a restart by the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexmill.session import ship_package

DONE, WAITING, DUE, QUARANTINE = "hecho", "en_espera", "por_reintentar", "cuarentena"
OUTPUT = "item long, version int, intentos int, estado string, vence timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Retries(StatefulProcessor):
    """One row for each change of an item: its version, failures, state and the time from which it may be tried again."""

    def __init__(self, most: int, wait_ms: int) -> None:
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("item", "version int, intentos int, hecho boolean, ultimo long")

    def _row(self, key: tuple, version: int, failures: int, state: str, due: int | None) -> pd.DataFrame:
        at = pd.Timestamp(due, unit="ms", tz="UTC") if due is not None else pd.NaT
        return pd.DataFrame({"item": [int(key[0])], "version": [version], "intentos": [failures], "estado": [state], "vence": pd.Series([at], dtype="datetime64[ns, UTC]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, failures, done, last = self.kept.get() if self.kept.exists() else (0, 0, False, 0)
        for batch in rows:
            failed = batch["fallo"].astype(bool)
            failures += int(failed.sum())
            done = bool(done) or bool((~failed).any())
            if failed.any():
                last = max(last, int(batch.loc[failed, "ms"].max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due, state = None, DONE
        if not done:
            state = QUARANTINE
            if failures < self.most:
                due, state = last + self.wait_ms * 2 ** (failures - 1), WAITING
                self.handle.registerTimer(due)
        self.kept.update((version + 1, failures, done, last))
        yield self._row(key, version + 1, failures, state, due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, failures, done, last = self.kept.get()
        self.kept.update((version + 1, failures, done, last))
        yield self._row(key, version + 1, failures, DUE, int(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def retry_states(attempts: DataFrame, target: str, checkpoint: str, most: int = 3, wait_ms: int = 60_000, delay: str = "1 minute") -> StreamingQuery:
    """Start a stream over attempts (item long, ts timestamp, fallo boolean) that writes each item's changes as Parquet.

    Takes what is there and ends. Times count in whole milliseconds, rounded half up. The state store with timers is chosen for this query alone.
    """
    spark = attempts.sparkSession
    ship_package(spark)
    attempts = attempts.withColumn("ts", F.timestamp_millis(F.expr("(unix_micros(ts) + 500) div 1000")))
    rows = attempts.withWatermark("ts", delay).select("item", "ts", "fallo", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("item").transformWithStateInPandas(Retries(most, wait_ms), OUTPUT, "Append", "EventTime")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        return out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def last_states(changes: DataFrame) -> DataFrame:
    """(item, intentos, estado, vence): the last change of each item."""
    last = Window.partitionBy("item").orderBy(F.desc("version"))
    return changes.withColumn("_k", F.row_number().over(last)).filter("_k = 1").select("item", "intentos", "estado", "vence")


def quarantined(changes: DataFrame) -> DataFrame:
    return last_states(changes).filter(F.col("estado") == QUARANTINE)
