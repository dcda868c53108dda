"""Tables that change together: parts of all of them are written aside and become visible by one pointer.

A set of tables is split into parts by a column that each of them has (a municipality, a bucket of a key). A change
writes the touched parts of every table into a folder of its own and then adds a commit, a small file with the folder
that holds each part and the tables' schemas. Readers follow the last commit, so a writer that dies leaves the state
before it; parts that weren't touched are neither read nor written. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.joins import upsert
from lexmill.session import hadoop_files

BUCKET, BUCKETS = "_cubo", 64


def _commits(spark: SparkSession, path: str) -> list[str]:
    p, files = hadoop_files(spark, f"{path}/commits")
    return sorted(x.getPath().getName() for x in files.listStatus(p) if x.getPath().getName().endswith(".json")) if files.exists(p) else []


def state(spark: SparkSession, path: str) -> dict:
    """The last commit: ``parts`` (folder of each part, by the part's JSON), ``schemas`` (by table), ``part_col``; empty without any."""
    names = _commits(spark, path)
    if not names:
        return {}
    (row,) = spark.read.text(f"{path}/commits/{names[-1]}", wholetext=True).collect()
    return json.loads(row.value)


def _commit(spark: SparkSession, path: str, new: dict) -> None:
    """The pointer: written under another name first, so that no reader sees a part of it."""
    name = f"{len(_commits(spark, path)):08d}.json"
    draft, files = hadoop_files(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    final, _ = hadoop_files(spark, f"{path}/commits/{name}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"another writer has committed {name}")


def write_parts(tables: dict[str, DataFrame], path: str, part_col: str) -> str:
    """Write tables below a new folder of ``path``, split by ``part_col``; nothing of it is visible yet.

    Small parts share a task, and Spark splits large ones.
    """
    folder = f"{path}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.hint("rebalance", part_col).write.partitionBy(part_col).parquet(f"{folder}/{name}")
    return folder


def replace_parts(spark: SparkSession, tables: dict[str, DataFrame], path: str, part_col: str = "codigo_localidad", parent: str | None = None, touched: list | None = None) -> None:
    """Put the parts of ``tables`` in place of the stored ones, children with their parents.

    The touched parts are those that the ``parent`` table (the first) has, or the ones given; all tables of the set are
    given each time, and a touched part of which a table has no row becomes empty there. Rows of other parts are an error.
    """
    old = state(spark, path)
    if old and (set(old["schemas"]) != set(tables) or old["part_col"] != part_col):
        raise ValueError("the tables of a set and the column of its parts stay the same")
    folder = write_parts(tables, path, part_col)
    written = {n: {r[0] for r in spark.read.schema(df.schema).parquet(f"{folder}/{n}").select(part_col).distinct().collect()} for n, df in tables.items()}
    touched = written[parent or next(iter(tables))] if touched is None else set(touched)
    for name, parts in written.items():
        if parts - touched:
            raise ValueError(f"{name} has rows of parts that aren't replaced")
    parts = old.get("parts", {}) | {json.dumps(x): folder for x in touched}
    _commit(spark, path, {"part_col": part_col, "parts": parts, "schemas": {n: json.loads(df.schema.json()) for n, df in tables.items()}})


def read_parts(spark: SparkSession, path: str, name: str, only: list | None = None) -> DataFrame:
    """A table of the set as of its last commit; ``only`` reads some parts."""
    now = state(spark, path)
    if not now:
        raise ValueError(f"nothing is committed at {path}")
    schema, part = T.StructType.fromJson(now["schemas"][name]), now["part_col"]
    by_folder: dict[str, list] = {}
    for key, folder in now["parts"].items():
        value = json.loads(key)
        if only is None or value in only:
            by_folder.setdefault(folder, []).append(value)
    out = spark.createDataFrame([], schema)
    for folder, values in sorted(by_folder.items()):
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
        kept = F.col(part).isin([v for v in values if v is not None])
        out = out.unionByName(rows.filter(kept | F.col(part).isNull() if None in values else kept))
    return out


def upsert_buckets(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], order: str, name: str = "filas") -> None:
    """Put a batch's rows in place of stored ones of their keys, in the buckets of keys that it touches; the newest row of
    a key by ``order`` holds, stored ones included."""
    batch = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]
    old = read_parts(spark, path, name, touched) if state(spark, path) else batch.limit(0)
    replace_parts(spark, {name: upsert(old.limit(0), old.unionByName(batch), keys, order)}, path, BUCKET, touched=touched)
