"""Session helpers: test tables, the shared folder, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lexmill-"), "lexmill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"lexmill/{p.relative_to(root)}")
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share, as a full URI.

    A path without a scheme is one of Hadoop's default filesystem, to Spark's writers as to others that open the URI.
    Where the setting is unset, a local master (tests, one machine) gets a temporary folder; a cluster is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def hadoop_files(spark: SparkSession, path: str):
    """The Hadoop path and its filesystem."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, files = hadoop_files(spark, path)
    return files.exists(p)


def file_state(spark: SparkSession, path: str) -> tuple:
    """(path, size, time of change) of every file below a path: equal states mean the same data."""
    p, files = hadoop_files(spark, path)
    found, out = files.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def save(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and executor loss costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
