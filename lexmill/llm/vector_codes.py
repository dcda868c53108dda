"""Product codes of vectors: each of eight parts is stored as the number of its nearest codebook entry.

Vectors become integers (4096 times each component, rounded down), so that sums, centres and distances are exact whatever
the order of rows. Each round reads the integer table once; tasks give sums for each part and entry, Spark adds them, and
the driver gets the 8 x 16 sums alone.

The nearest entry is found by slices and masks. For each dimension of a part the entries' coordinates are sorted, and
prefix masks say which entries the first k of them are. The least distance to the entries next in the two widest dimensions
gives an initial radius; the coordinates within it are a range of each dimension, whose entries are two prefix masks' difference,
and the AND over all dimensions leaves the candidates: every entry as near as the radius is among them, so the least
distance (ties to the lower number) among candidates is exact.

Cases: vectors that are null, empty or hold a null or non-finite component go, and so do those of another length than the
most frequent one that 8 divides (of equally frequent ones the longer); repeated rows count as rows, of an id's several
vectors the least begins a codebook; null ids are coded but begin none; with fewer than 16 ids codebooks have fewer
entries, and without any id there are no rows; an empty table gives no rows; integers beyond 2^27 (components of 32,768) are
cut to it, so that distances stay within 64 bits up to 127 components of that size; other columns are left alone, but for
those that have a result's name, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.frames import free
from lexmill.session import save, ship_package, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 27
#: Vectors that one step of the arrays takes.
BLOCK = 4096
#: Label sums are broadcast up to this many labels; more are joined by shuffle.
BROADCAST_LABELS = 250_000


class Nearest:
    """Exact nearest entries of one part's codebook (at most 64 entries), by masks of coordinate ranges."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.sort(entries, axis=0).T.copy()
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.masks = np.concatenate([np.zeros((len(order), 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        self.order = order
        self.widest = np.argsort(entries.min(0) - entries.max(0), kind="stable")[:2]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For each vector, a mask of the entries that lie within the initial radius in every dimension."""
        square = np.full(len(x), np.iinfo(np.int64).max)
        for d in self.widest:
            line, own = self.sorted[d], x[:, d]
            at = np.searchsorted(line, own)
            low, high = np.maximum(at - 1, 0), np.minimum(at, len(line) - 1)
            near = self.entries[self.order[d][np.where(own - line[low] <= line[high] - own, low, high)]]
            square = np.minimum(square, ((x - near) ** 2).sum(1))
        radius = np.sqrt(square.astype(np.float64)).astype(np.int64) + 1  # no less than the root, whatever the rounding
        mask = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(x.shape[1]):
            left = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            right = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            mask &= self.masks[d][right] ^ self.masks[d][left]
        return mask

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest entry and the squared distance."""
        mask = self.candidates(x)
        has = (mask[:, None] >> np.arange(len(self.entries), dtype=np.uint64)) & np.uint64(1)
        row, entry = np.nonzero(has)
        square = ((x[row] - self.entries[entry]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(square, first) if len(x) else np.zeros(0, np.int64)
        best = np.where(square == least[row], entry, len(self.entries))
        return (np.minimum.reduceat(best, first) if len(x) else best), least


def _blocks(vectors: pa.Array, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, rows x dims) of lists that all have ``dims`` components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for a in range(0, len(flat), BLOCK):
        yield a, min(a + BLOCK, len(flat)), flat[a : a + BLOCK].astype(np.int64)


def integer_vectors(vectors: DataFrame, vector_col: str, name: str) -> DataFrame:
    """``vectors`` with an array<int> column ``name``; null where the vector is null or has a null or non-finite component."""
    cut = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.withColumn(name, F.when(F.col(vector_col).isNotNull() & ~bad, F.transform(vector_col, cut)))


def _dims(ints: DataFrame, name: str) -> int:
    """The most frequent length that the number of parts divides; 0 without any."""
    n = F.size(name)
    top = ints.filter((n > 0) & (n % PARTS == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top.n if top else 0


def _first_entries(ints: DataFrame, id_col: str, name: str, dims: int) -> np.ndarray:
    """The codebooks' entries as PARTS x entries x components, from the vectors of the least ids."""
    rows = ints.filter(F.col(id_col).isNotNull())
    ids: list = []
    while len(ids) < ENTRIES:  # once, unless the least ids are repeated
        left = rows.filter(F.col(id_col) > F.lit(ids[-1])) if ids else rows
        more = sorted({r[0] for r in left.select(id_col).orderBy(id_col).limit(ENTRIES).collect()})
        if not more:
            break
        ids += more[: ENTRIES - len(ids)]
    one = rows.filter(F.col(id_col).isin(ids)).groupBy(F.col(id_col).alias("id")).agg(F.min(name).alias("v")).orderBy("id")
    rows = np.array([r.v for r in one.collect()], np.int64).reshape(-1, PARTS, dims // PARTS)
    return rows.transpose(1, 0, 2).copy()


def _sums(ints: DataFrame, name: str, books: np.ndarray) -> np.ndarray:
    """For each part and entry the number of assigned vectors and their component sums, as Python integers."""
    parts, entries, width = books.shape
    dims = parts * width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [Nearest(b) for b in books]
        for batch in batches:
            total = np.zeros((parts, entries, width + 1), np.int64)
            for _, _, x in _blocks(batch.column(0), dims):
                for p, near in enumerate(nearest):
                    part = x[:, p * width : (p + 1) * width]
                    entry, _ = near.find(part)
                    for d in range(width):  # sums of a block stay below 2^53
                        total[p, :, d] += np.bincount(entry, part[:, d], entries).astype(np.int64)
                    total[p, :, width] += np.bincount(entry, minlength=entries)
            part, entry = np.nonzero(total[:, :, width])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "sums"])

    each = ints.select(name).mapInArrow(add, "part long, entry long, sums array<long>")
    exact = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width + 1)]
    out = np.zeros((parts, entries, width + 1), object)
    for r in each.groupBy("part", "entry").agg(*exact).collect():
        out[r.part, r.entry] = [int(r[f"s{k}"]) for k in range(width + 1)]
    return out


def train_codebooks(ints: DataFrame, id_col: str, name: str, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """PARTS x entries x components after ``rounds`` of assignment and floored means; unused entries stay."""
    books = _first_entries(ints, id_col, name, dims)
    for _ in range(rounds if books.shape[1] else 0):
        sums = _sums(ints, name, books)
        for p, e in zip(*np.nonzero(sums[:, :, -1]), strict=True):
            books[p, e] = [s // sums[p, e, -1] for s in sums[p, e, :-1]]
    return books


def encode(ints: DataFrame, name: str, books: np.ndarray) -> DataFrame:
    """``ints`` with ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts)."""
    parts, entries, width = books.shape

    @F.arrow_udf("struct<code:string,error:long>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nearest = [Nearest(b) for b in books]
        for batch in batches:
            codes, errors = np.zeros((len(batch), parts), np.uint8), np.zeros(len(batch), np.int64)
            for a, b, x in _blocks(batch, parts * width):
                for p, near in enumerate(nearest):
                    entry, square = near.find(x[:, p * width : (p + 1) * width])
                    codes[a:b, p] = entry
                    errors[a:b] += square
            text = codes.tobytes().hex()
            yield pa.StructArray.from_arrays([pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(errors)], ["code", "error"])

    (own,) = free(ints, "_coded")
    placed = ints.drop("code", "error").withColumn(own, place(F.col(name)))
    return placed.withColumn("code", F.col(f"{own}.code")).withColumn("error", F.col(f"{own}.error")).drop(own)


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The kept rows of ``vectors`` with ``code`` and ``error``, and the codebooks (parts x entries x components).

    The integer vectors are written once, without the original ones, and read in every round.
    """
    ship_package(vectors.sparkSession)
    (name,) = free(vectors, "_ints")
    ints = integer_vectors(vectors, vector_col, name).filter(F.col(name).isNotNull()).drop(vector_col)
    ints = save(ints, "vectors")
    dims = _dims(ints, name)
    ints = ints.filter(F.size(name) == dims)
    books = train_codebooks(ints, id_col, name, dims, rounds) if dims else np.zeros((PARTS, 0, 0), np.int64)
    if not books.shape[1]:  # no vectors, or none with an id
        empty = ints.filter(F.lit(False)).drop(name, "code", "error")
        return empty.withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")), books
    return encode(ints, name, books).drop(name), books


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def sum_over(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of equal ``key`` (nulls together); sums are added before they meet."""
    k, s = free(rows, "_key", "_sum")
    sums = save(rows.groupBy(F.col(key).alias(k)).agg(F.sum(value).alias(s)), "sums")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    out: Column = F.col(s).alias(name)
    return rows.join(sums, F.col(key).eqNullSafe(F.col(k))).select(*[F.col(c) for c in rows.columns if c != name], out)


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = sum_over(save(coded, "codes"), "label", "error", "label_error")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """One round: all distances, the least one of each part, floored means."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, p, min(dist * {ENTRIES} + e) AS best FROM (
  SELECT x.r, x.p, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i])))::HUGEINT AS dist FROM x JOIN b{k} AS b USING (p)) GROUP BY r, p),
m{k} AS (SELECT p, e, i, floor_sum AS v FROM (SELECT p, (best % {ENTRIES})::INT AS e, i, (sum(x.x[i]) - ((sum(x.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
  FROM a{k} JOIN x USING (r, p), unnest(range(1, len(x.x) + 1)) AS t(i) GROUP BY ALL)),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x FROM b{k} AS b LEFT JOIN (SELECT p, e, list(v::BIGINT ORDER BY i) AS x FROM m{k} GROUP BY p, e) AS n USING (p, e)),"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS w FROM (
  SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0) WHERE len(embedding) > 0),
x AS MATERIALIZED (SELECT r, p, w[p * (len(w) // {PARTS}) + 1:(p + 1) * (len(w) // {PARTS})] AS x FROM v, unnest(range({PARTS})) AS t(p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM x JOIN (SELECT arg_min(r, w) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v WHERE vec_id IS NOT NULL GROUP BY vec_id QUALIFY e < {ENTRIES}) USING (r)),
{"".join(_round_sql(k) for k in range(ROUNDS))}
f AS (SELECT r, p, min(dist * {ENTRIES} + e) AS best FROM (
  SELECT x.r, x.p, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i])))::HUGEINT AS dist FROM x JOIN b{ROUNDS} AS b USING (p)) GROUP BY r, p),
c AS MATERIALIZED (SELECT r, string_agg(printf('%02x', (best % {ENTRIES})::INT), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY p, e)) AS digest FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM c JOIN v USING (r), h
"""
