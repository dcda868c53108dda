"""The nearest neighbours of every vector: an exact self-join by cells around pivots.

Equal vectors are one class with its ``k + 1`` least ids, so copies make no pairs. Each class goes to the nearest of a
bounded number of pivots (a hashed choice of vectors; with the cells' inner and outer distance from them, they are all that
reaches the driver), and a cell is cut into blocks of bounded size. The best ``k + 1`` hits in a vector's own block give
a radius: on the unit sphere, a cell whose ring around its pivot is further away than that holds no better one, by the
triangle inequality. Blocks of near cells form parts of about equal size, of a fixed number until a part would pass a number
of bytes. A task has two parts, with the blocks that may give each other a hit, and multiplies each two of these blocks once
for both; the radii shrink as hits are found. So a block is sent at most once for each part, and of a vector ``k + 1`` hits
come back for each, however many blocks there are. The members of a class share its list, each without itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.vectors import valid_vectors
from lexmill.session import save, ship_package

#: Vectors of a block, and vectors for which there is a pivot, up to a number of pivots.
BLOCK_ROWS, CELL_ROWS, MOST_PIVOTS = 1024, 512, 4096
#: What rounding to six digits, and sums of doubles, may move a score and a distance.
SLACK, NEAR = 2e-6, 1e-7
#: Parts, and the bytes of a part's vectors beyond which there are more.
PARTS, PART_BYTES = 16, 16 << 20
#: Bytes of vectors whose scores are computed at once.
HIT_BYTES = 8 << 20


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    m = np.asarray(flat, np.float64).reshape(rows, -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _radius(score: np.ndarray) -> np.ndarray:
    """The distance on the unit sphere within which all scores of at least ``score`` lie."""
    return np.sqrt(np.maximum(2 - 2 * (score - SLACK), 0)) + NEAR


def _best(scores: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th greatest score, where a column counts as often as it has copies; -2 with fewer."""
    some = min(k, scores.shape[1])
    top = -np.sort(-np.take_along_axis(scores, at := np.argpartition(-scores, some - 1, axis=1)[:, :some], 1), axis=1)
    order = np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable")
    held = np.cumsum(copies[np.take_along_axis(at, order, 1)], axis=1) >= k
    return np.where(held.any(1), np.take_along_axis(top, held.argmax(1)[:, None], 1)[:, 0], -2.0)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, rep) of distinct vectors of (id, v): the ``k + 1`` least ids, of which the first represents them."""
    number = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("_number", number).filter(F.col("_number") <= k + 1)  # cut before the shuffle too
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])


@dataclass
class Cells:
    """Pivots with their cells' inner and outer distances, the number of parts, and the table of blocks."""

    pivots: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    parts: int
    blocks: DataFrame


def cells_of(classes: DataFrame, k: int) -> Cells:
    """``classes``, a written table, dealt to cells and packed in blocks with their part and each vector's score to reach."""
    spark = classes.sparkSession
    count = classes.count()
    pivots = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(MOST_PIVOTS, -(-count // CELL_ROWS))).select("v").toArrow()["v"].combine_chunks()
    pivots = _unit(pivots.flatten().to_numpy(zero_copy_only=False), len(pivots))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.num_rows)
                if m.shape[1] != pivots.shape[1]:
                    raise ValueError("vectors of different length")
                d = _distance(m, pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], ["rep", "ids", "v", "cell", "d"])

    dealt = save(classes.select("rep", "ids", "v").mapInArrow(near, "rep long, ids array<long>, v array<float>, cell int, d double"), "cells")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("inner"), F.max("d").alias("outer")).toArrow()
    inner, outer = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    at, n = sizes["cell"].to_numpy(), sizes["n"].to_numpy()
    inner[at], outer[at] = sizes["inner"].to_numpy(), sizes["outer"].to_numpy()
    cut = -(-n // BLOCK_ROWS)
    parts = min(max(PARTS, -(-count * pivots.shape[1] * 4 // PART_BYTES)), int(cut.sum()))
    anchor = _distance(pivots[at], pivots[:parts])
    order = np.lexsort((anchor.min(1), anchor.argmin(1)))
    start = np.empty(len(at))
    start[order] = np.cumsum(n[order]) - n[order]
    few = F.broadcast(spark.createDataFrame(list(zip(at.tolist(), cut.tolist(), (start * parts / count).tolist(), (n / cut * parts / count).tolist(), strict=True)), "cell int, cut long, start double, step double"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        flat, ids = rows["v"].combine_chunks().flatten(), rows["ids"].combine_chunks()
        m = _unit(flat.to_numpy(zero_copy_only=False), len(ids))
        reach = _best(np.round(m @ m.T, 6), np.diff(ids.offsets.to_numpy()), k + 1)
        one = [pa.array([x.as_py()], pa.int32()) for x in key]
        return pa.table([*one, *(pa.array([x.tolist()], t) for x, t in ((rows["rep"].to_numpy(), pa.list_(pa.int64())), (reach, pa.list_(pa.float64())))), pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([flat], pa.list_(pa.float32()))], ["cell", "block", "part", "reps", "reach", "ids", "m"])

    part = F.least(F.floor(F.col("start") + F.col("block") * F.col("step")), F.lit(parts - 1)).cast("int")
    blocks = dealt.join(few, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")).select("cell", "block", part.alias("part"), "rep", "ids", "v")
    packed = blocks.groupBy("cell", "block", "part").applyInArrow(pack, "cell int, block int, part int, reps array<long>, reach array<double>, ids array<array<long>>, m array<float>")
    return Cells(pivots, inner, outer, parts, save(packed, "blocks"))


def sent_vectors(cells: Cells, threshold: float) -> DataFrame:
    """(cell, from_cell, from_block, from_part): of each block, the cells in which some of its vectors may have a better hit."""
    pivots, inner, outer = cells.pivots, cells.inner, cells.outer

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, part, reach, m in zip(*batch.columns, strict=True):
                reach = np.maximum(reach.values.to_numpy(), threshold)
                d, r = _distance(_unit(m.values.to_numpy(), len(reach)), pivots), _radius(reach)[:, None]
                to = np.flatnonzero(((d - outer <= r) & (inner - d <= r)).any(0)).astype(np.int32)
                own = (np.full(len(to), x.as_py(), np.int32) for x in (cell, block, part))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (to, *own)], ["cell", "from_cell", "from_block", "from_part"])

    return cells.blocks.select("cell", "block", "part", "reach", "m").mapInArrow(send, "cell int, from_cell int, from_block int, from_part int")


def sent_blocks(cells: Cells, threshold: float) -> DataFrame:
    """(low, high, cell, block): the blocks that a task of two parts needs, those that look for hits and those that may hold them."""
    at = cells.blocks.select("cell", "block", "part")
    need = save(sent_vectors(cells, threshold), "needs")
    both = [f("from_part", "part").alias(n) for f, n in ((F.least, "low"), (F.greatest, "high"))]
    met = need.join(at.select("cell", "part").distinct(), "cell")
    looking = met.select(*both, F.col("from_cell").alias("cell"), F.col("from_block").alias("block"))
    holding = met.select(*both, "cell", "part").distinct().join(at, ["cell", "part"]).select("low", "high", "cell", "block")
    return looking.union(holding).distinct()


class _Block:
    """A block in a task, with the best hits so far of its vectors and the scores that further ones must reach."""

    def __init__(self, cell: int, block: int, reps: pa.Array, reach: pa.Array, ids: pa.Array, m: pa.Array, k: int, threshold: float) -> None:
        self.cell, self.block, self.reps, self.k = cell, block, reps.to_numpy(), k
        self.unit = _unit(m.to_numpy(), len(reps))
        self.rough = self.unit.astype(np.float32)
        self.first, self.ids = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
        self.bound = np.maximum(reach.to_numpy(), threshold)
        #: What a float32 product of unit vectors may be less than the rounded score, at most.
        self.slack = SLACK + (self.unit.shape[1] + 4) * 2.0**-23
        self.hits, self.held = [], 0

    def needs(self, pivot: np.ndarray, inner: float, outer: float) -> np.ndarray:
        """The vectors that may have a better hit in a cell."""
        d, r = _distance(self.unit, pivot[None])[:, 0], _radius(self.bound)
        return np.flatnonzero((d - outer <= r) & (inner - d <= r))

    def least(self, rows: np.ndarray) -> np.ndarray:
        return (self.bound[rows] - self.slack).astype(np.float32)

    def take(self, row: np.ndarray, at: np.ndarray, other: _Block) -> None:
        """Hits of vectors ``row`` at vectors ``at`` of the other block, as far as their exact scores reach."""
        step = max(1, HIT_BYTES // (8 * self.unit.shape[1]))
        for i in range(0, len(row), step):
            r, a = row[i : i + step], at[i : i + step]
            s = np.round(np.einsum("ij,ij->i", self.unit[r], other.unit[a]), 6)
            keep = s >= self.bound[r] - SLACK
            r, a, s = r[keep], a[keep], s[keep]
            copies = other.first[a + 1] - other.first[a]
            each = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(other.first[a], copies)
            self.hits.append((np.repeat(r, copies), np.repeat(s, copies), other.ids[each]))
            self.held += len(each)
            if self.held > 3 * (self.k + 1) * len(self.reps):
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of the best ``k + 1`` hits of each vector; only they are kept."""
        if not self.hits:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        row, score, hit = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        row, score, hit, place = _first(row, score, hit, self.k)
        last = place == self.k
        self.bound[row[last]] = np.maximum(self.bound[row[last]], score[last])
        self.hits, self.held = [(row, score, hit)], len(row)
        return row, score, hit


def _first(row: np.ndarray, score: np.ndarray, hit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's best ``k + 1`` hits in order, and their places from 0."""
    order = np.lexsort((hit, -score, row))
    row, score, hit = row[order], score[order], hit[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place <= k
    return row[keep], score[keep], hit[keep], place[keep]


def _reaching(s: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries that are at least as great as ``least``, which has the form of a row or a column."""
    return np.divmod(np.flatnonzero(s >= least), s.shape[1])


def _meet(a: _Block, b: _Block, cells: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Both blocks take their hits in the other one; the whole product is computed once unless fewer vectors look for hits."""
    to_b, to_a = (x.needs(*(c[y.cell] for c in cells)) for x, y in ((a, b), (b, a)))
    if a is not b and len(to_b) * len(b.reps) + len(to_a) * len(a.reps) >= len(a.reps) * len(b.reps):
        s = a.rough @ b.rough.T
        everyone = slice(None)
        row, at = _reaching(s, a.least(everyone)[:, None])
        back_at, back_row = _reaching(s, b.least(everyone)[None])
        a.take(row, at, b)
        b.take(back_row, back_at, a)
        return
    for x, y, rows in ((a, b, to_b),) if a is b else ((a, b, to_b), (b, a, to_a)):
        if len(rows):
            row, at = _reaching(x.rough[rows] @ y.rough.T, x.least(rows)[:, None])
            x.take(rows[row], at, y)


HITS = "cell int, block int, reps array<long>, ids array<long>, micros array<int>"


def _two_parts(k: int, threshold: float, cells: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """The hits between two parts' blocks, or within one part's, a row for each block; scores in whole millionths."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key)
        parts = {low: [], high: []}
        for cell, block, part, reps, reach, ids, m in zip(*(rows[c] for c in ("cell", "block", "part", "reps", "reach", "ids", "m")), strict=True):
            parts[part.as_py()].append(_Block(cell.as_py(), block.as_py(), reps.values, reach.values, ids.values, m.values, k, threshold))
        for i, a in enumerate(parts[low]):
            for b in parts[low][i:] if low == high else parts[high]:
                _meet(a, b, cells)
        out = []
        for x in (x for part in parts.values() for x in part):
            row, score, hit = x.best()
            keep = score >= threshold
            if keep.any():
                out.append((x.cell, x.block, x.reps[row[keep]], hit[keep], np.rint(score[keep] * 1e6).astype(np.int32)))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "block", "reps", "ids", "micros"])

    return run


def _merge(k: int):
    """The best ``k + 1`` hits of each vector of a block, of those that the tasks found."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rep, hit, micros = (rows[c].combine_chunks().flatten().to_numpy() for c in ("reps", "ids", "micros"))
        rep, score, hit, place = _first(rep, micros / 1e6, hit, k)
        at = np.flatnonzero(place == 0)
        hits = pa.StructArray.from_arrays([pa.array(hit), pa.array(score)], ["id", "score"])
        return pa.table([pa.array(rep[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(rep)), pa.int32()), hits)], ["rep", "hits"])

    return run


def all_neighbours(corpus: DataFrame, k: int = 10, threshold: float = 0.5, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, id, score, puesto): for every row of ``corpus`` its ``k`` best others by cosine of at least ``threshold``
    (over -1), ties in order of id. Rows whose vector is null, zero or not finite take no part; ids are distinct integers.
    """
    ship_package(corpus.sparkSession)
    good = F.size(vector) > 0
    rows = valid_vectors(corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).withColumn("u", F.col("v")).filter(good), "u").select("id", "v")
    classes = save(vector_classes(rows, k), "vector-classes")
    if classes.isEmpty():
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, score double, puesto int")
    cells = cells_of(classes, k)
    sent = cells.blocks.join(sent_blocks(cells, threshold), ["cell", "block"]).repartition(cells.parts * (cells.parts + 1) // 2, "low", "high")
    bounds = cells.pivots, cells.inner, cells.outer
    hits = sent.groupBy("low", "high").applyInArrow(_two_parts(k, threshold, bounds), HITS)
    lists = hits.groupBy("cell", "block").applyInArrow(_merge(k), "rep long, hits array<struct<id:long,score:double>>")
    members = rows.withColumnRenamed("id", "query_id").join(classes.select("rep", "v"), "v").select("query_id", "rep")
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return members.join(lists, "rep").select("query_id", F.posexplode(others).alias("at", "h")).select("query_id", "h.id", "h.score", (F.col("at") + 1).alias("puesto"))
