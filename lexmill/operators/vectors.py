"""Vector search: exact top-k by matrix products in Arrow batches, fusion of rankings, batch embedding.

Queries reach the tasks in parts of at most ``QUERY_BYTES``; each task gives a local top-k per query, and a window
over (query, score) takes the global one, so what is shuffled is k rows per query and batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import ship_package

QUERY_BYTES = 64 << 20


def valid_vectors(df: DataFrame, c: str, size: int | None = None) -> DataFrame:
    """Rows whose vector has the size, only finite entries and a norm over 0; the vector scaled to length 1."""
    v = F.col(c)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good & (F.size(v) == size) if size is not None else good
    out = df.filter(good).withColumn("_norm", norm).filter("_norm > 0")
    return out.withColumn(c, F.transform(v, lambda x: (x / F.col("_norm")).cast("float"))).drop("_norm")


def decode_vectors(df: DataFrame, c: str, size: int) -> DataFrame:
    """A binary column of little-endian float32 as arrays; a wrong length gives null."""

    def decode(batch: pa.Array) -> pa.Array:
        return pa.array([None if b is None or len(b) != 4 * size else np.frombuffer(b, "<f4") for b in batch.to_pylist()], pa.list_(pa.float32()))

    return df.withColumn(c, F.arrow_udf(decode, "array<float>")(F.col(c)))


def vector_from_json(c: Column, size: int) -> Column:
    """A JSON array as doubles; null if it isn't one of the size."""
    v = F.from_json(c, "array<double>")
    return F.when(F.size(v) == size, v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays: 0 if one has norm 0; vectors of different length are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double"))
    return F.coalesce(same, F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = 0.0, query_id: str = "query_id", corpus_id: str = "id", vector: str = "vector", exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, id, score, puesto): each query's best documents by cosine of at least ``threshold``, ties in order of id."""
    ship_package(corpus.sparkSession)
    spark = corpus.sparkSession
    sizes = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    parts = max(1, -(-(sizes[0] * (sizes[1] or 1) * 8) // QUERY_BYTES))
    out = None
    for part in range(parts):
        own = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part) if parts > 1 else queries
        got = own.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast((got["q"].to_numpy(), np.concatenate([_matrix(c) for c in got["v"].chunks if len(c)])))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own_ids, m = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if m.shape[1] != q.shape[1]:
                    raise ValueError("vectors of different length")
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                for a in range(0, len(q), 256):
                    s = np.round(q[a : a + 256] @ m.T, digits)
                    s[s < threshold] = -np.inf
                    if exclude_self:
                        s[ids[a : a + 256][:, None] == own_ids[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(own_ids, s.shape), -s), axis=1)[:, :k]
                    best = np.take_along_axis(s, order, 1)
                    row, place = np.nonzero(best > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(own_ids[order[row, place]]), pa.array(best[row, place])], ["query_id", "id", "score"])

        hits = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null").mapInArrow(search, "query_id long, id long, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double, puesto int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= k)


def article_search(queries: DataFrame, articles: DataFrame, norms: DataFrame, k: int = 10, threshold: float = 0.4, in_force_only: bool = False, filter_first: bool = True) -> DataFrame:
    """Best articles with their norms: in-force norms are picked before the top k, or (as an option) after one twice as long."""
    keep = norms.filter(F.col("estado").isin("vigente", "modificada")) if in_force_only else norms
    pool = articles.join(keep.select(F.col("id").alias("norma_id")), "norma_id", "left_semi") if filter_first and in_force_only else articles
    hits = top_k(queries, pool, k if filter_first else 2 * k, threshold)
    joined = hits.join(articles.select("id", "norma_id"), "id").join(keep.select(F.col("id").alias("norma_id"), "titulo"), "norma_id")
    w = Window.partitionBy("query_id").orderBy("puesto")
    return joined.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= k)


def over_fetched(queries: DataFrame, corpus: DataFrame, k: int = 10, factor: int = 5, threshold: float = 0.0, keep: Column | None = None) -> DataFrame:
    """The best ``factor`` times k as an index would give them, then those that ``keep`` and ``threshold`` let through, cut to k.

    With a filter this can give fewer than k; filter the corpus before ``top_k`` to get k.
    """
    hits = top_k(queries, corpus, factor * k, -1.0).join(corpus.drop("vector"), "id").filter(F.col("score") >= threshold)
    hits = hits if keep is None else hits.filter(keep)
    w = Window.partitionBy("query_id").orderBy("puesto")
    return hits.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= k)


def build_index(rows: DataFrame, path: str, encoder: Callable[[list[str]], np.ndarray], model: str, generation: str, manifests: DataFrame, resume: bool = True, id_col: str = "id", text_col: str = "texto", least: int = 5) -> DataFrame:
    """Embed the rows that the index at ``path`` lacks and append them; returns the manifests with this generation active."""
    spark = rows.sparkSession
    done = None
    if resume:
        try:
            done = spark.read.parquet(path).select(id_col)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    todo = rows.filter(F.length(F.trim(text_col)) > least)
    embed(todo, done, encoder, id_col, text_col).write.mode("append" if resume else "overwrite").parquet(path)
    return next_manifest(manifests, generation, model, spark.read.parquet(path).count())


def combined(norm_hits: DataFrame, article_hits: DataFrame, limit: int = 10) -> DataFrame:
    """Both kinds of hits by score, tagged, ``limit`` per query."""
    both = norm_hits.withColumn("clase", F.lit("norma")).unionByName(article_hits.withColumn("clase", F.lit("articulo")), allowMissingColumns=True)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("clase"), "id")
    return both.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= limit)


def rank_fusion(rankings: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """(query_id, id, score, canales, puesto): the sum of 1 / (k + rank) over channels (query_id, canal, id, puesto); then more channels, then id."""
    sums = rankings.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("puesto"))), 6).alias("score"), F.countDistinct("canal").alias("canales"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("canales"), "id")
    return sums.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= limit)


def test_encoder(size: int) -> Callable[[list[str]], np.ndarray]:
    """Deterministic vectors of length 1, seeded by the sum of a text's code points modulo 1000."""

    def encode(texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(sum(map(ord, t)) % 1000).normal(size=size) for t in texts]
        return np.array([r / np.linalg.norm(r) for r in rows], np.float32).reshape(len(texts), size)

    return encode


test_encoder.__test__ = False


def embed(rows: DataFrame, done: DataFrame | None, encoder: Callable[[list[str]], np.ndarray], id_col: str = "id", text_col: str = "texto", batch: int = 64) -> DataFrame:
    """(id, vector) of the rows that ``done`` doesn't have, by an encoder given as a function of a list of texts."""
    ship_package(rows.sparkSession)
    todo = rows if done is None else rows.join(done.select(id_col).distinct(), id_col, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                v = encoder([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(np.asarray(v, np.float32)), pa.list_(pa.float32()))], ["id", "vector"])

    kind = todo.schema[id_col].dataType.simpleString()
    return todo.select(id_col, text_col).mapInArrow(run, f"id {kind}, vector array<float>")


def next_manifest(manifests: DataFrame, generation: str, model: str, total: int) -> DataFrame:
    """The manifests with a new active generation and the old ones inactive."""
    spark = manifests.sparkSession
    new = spark.createDataFrame([(generation, model, total, True)], "generation_id string, modelo string, total long, active boolean")
    return manifests.filter(F.col("generation_id") != generation).withColumn("active", F.lit(False)).unionByName(new)


def vector_json(c: Column) -> Column:
    return F.to_json(c)

