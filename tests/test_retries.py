"""Retries by state and timers: waits, quarantine, success at any time, restarts."""

import datetime

from pyspark.sql import functions as F

from lexmill.streaming import retries as Y


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_states_over_restarts(spark, tmp_path):
    schema = "item long, ts timestamp, fallo boolean"
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        Y.retry_states(stream, target, checkpoint, most=3, wait_ms=600_000, delay="1 second").awaitTermination()
        changes = spark.read.parquet(target)
        return changes.count(), {r.item: (r.intentos, r.estado, r.vence) for r in Y.last_states(changes).collect()}

    arrive([(1, at(0), True), (2, at(1), False), (3, at(2), True), (3, at(3), True), (4, at(4), True), (4, at(4), True), (4, at(5), True)])
    n, got = run()
    assert got == {1: (1, Y.WAITING, at(10)), 2: (0, Y.DONE, None), 3: (2, Y.WAITING, at(23)), 4: (3, Y.QUARANTINE, None)}
    assert run() == (n, got)  # nothing new: nothing is written
    arrive([(5, at(15), False)])
    _, got = run()
    assert got[1] == (1, Y.DUE, at(10)) and got[3] == (2, Y.WAITING, at(23)) and got[5] == (0, Y.DONE, None)
    arrive([(1, at(16), True), (3, at(16), False), (4, at(17), False), (6, at(60), False)])
    _, got = run()
    assert got[1] == (2, Y.DUE, at(36)) and got[3] == (2, Y.DONE, None) and got[4] == (3, Y.DONE, None)
    assert [r.item for r in Y.quarantined(spark.read.parquet(target)).collect()] == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != Y.ROCKS


def test_whole_milliseconds_in_any_time_zone(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    micros = {1: 1_700_000_000_666_499, 2: 1_700_000_000_666_500, 3: 1_700_000_000_999_999}
    spark.createDataFrame(list(micros.items()), "item long, us long").select("item", F.timestamp_micros("us").alias("ts"), F.lit(True).alias("fallo")).write.parquet(source)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = spark.readStream.schema("item long, ts timestamp, fallo boolean").parquet(source)
        Y.retry_states(stream, target, checkpoint, wait_ms=10).awaitTermination()
        got = {r.item: r.ms for r in Y.last_states(spark.read.parquet(target)).select("item", F.unix_millis("vence").alias("ms")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {1: 1_700_000_000_676, 2: 1_700_000_000_677, 3: 1_700_000_001_010}
