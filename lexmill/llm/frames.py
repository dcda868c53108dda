"""Names for columns in between that don't clash with a table's own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs inside hand whole texts to Python in batches of at most so many rows, which bounds what both sides hold of them."""
    before = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, str(before))


def free(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until the table has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def free_prefix(df: DataFrame, prefix: str, *names: str) -> str:
    """``prefix`` with underscores put before it until no column of the table is one of the prefixed names (in any case)."""
    taken = {c.lower() for c in df.columns}
    while any(f"{prefix}{x}".lower() in taken for x in names):
        prefix = f"_{prefix}"
    return prefix
