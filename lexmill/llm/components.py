"""Connected components of an edge table, by rounds of contraction; no step sees more than a batch or a vertex's minimum.

Each round, batches of edges are first thinned to spanning stars. Then every vertex moves to the least of itself and
its neighbours in an order hashed anew each round, and the edges between moved vertices make the next, smaller table;
in such an order a constant share of vertices leaves per round, whatever the shape (long paths too). Tables of each
round are written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import save, ship_package


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges and the least vertex of each one's component."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(vertices)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return vertices, vertices[[root(x) for x in range(len(vertices))]] if len(vertices) else vertices


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, r = union_find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(r[v != r], pa.int64()), pa.array(v[v != r], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b): label is the least vertex that it reaches."""
    ship_package(edges.sparkSession)
    thin = lambda e: e.filter("a is not null and b is not null and a <> b").mapInArrow(_stars, "a long, b long")
    edges = save(thin(edges.select("a", "b")), "edges")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        order = F.xxhash64(F.col("w"), F.lit(len(moves))) if moves else F.col("w")
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))).alias("e")).select("e.u", "e.w")
        own = F.xxhash64(F.col("u"), F.lit(len(moves))) if moves else F.col("u")
        least = ends.groupBy("u").agg(F.min(F.struct(order.alias("h"), "w")).alias("m"))
        move = save(least.select("u", F.when(F.col("m.h") < own, F.col("m.w")).otherwise(F.col("u")).alias("to")), "moves")
        moves.append(move)
        a, b = move.select(F.col("u").alias("a"), F.col("to").alias("x")), move.select(F.col("u").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = save(thin(moved), "edges")
    labels = vertices.select("v", F.col("v").alias("at"))
    for move in moves:
        labels = labels.join(move, F.col("at") == F.col("u"), "left").select("v", F.coalesce("to", "at").alias("at"))
    labels = save(labels, "labels")
    least = labels.groupBy("at").agg(F.min("v").alias("label"))
    return labels.join(save(least, "labels"), "at").select("v", "label")
