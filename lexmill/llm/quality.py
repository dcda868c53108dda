"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are those of two and three bytes, those of one and two words, and those of two to four words up to renaming
(which of them are equal), hashed to ``DIMENSIONS``; a document has each one or not. The ratios come from counts over all labelled rows that learning may see. With indicators scaled by them,
dual coordinate descent fits a hinge-loss linear model to a bounded sample of labelled rows: at most ``PER_CLASS`` of
each class, drawn by a hash of id and text, with their whole texts. The margin becomes a probability by a logistic fit
to margins of the other half's model, weighted to the true class shares. Scores read nothing but the text.

Cases: a null text scores as an empty one (its margin is the bias); rows with a null label teach nothing; with one
class only, all texts score that class's share; a document labelled more than once counts each time; repeated texts are
drawn one by one, within the bound; a column of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import NOT_SPACE, Powers, slices, span_hashes, word_bounds
from lexmill.llm.language_id import held_out
from lexmill.llm.samples import sample_rows
from lexmill.session import save, ship_package, table

BITS = 18
DIMENSIONS = 1 << BITS
PER_CLASS = 2500
ROUNDS = 12
#: Patterns go over this many neighbouring words at most.
PATTERN = 4
COST = 1.0
SMOOTHING = 1.0
#: Labels up to this many rows are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 250_000


def ngrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text number, n-gram number) of slices of texts, each n-gram once a text, in order of texts."""
    powers = Powers()
    for a, b, data, at in slices(texts):
        text = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(at))
        x = data.astype(np.uint64)
        two = x[:-1] << np.uint64(8) | x[1:] | np.uint64(1 << 24)
        three = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
        keys = []
        for n, codes in ((2, two), (3, three)):
            h = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            within = text[: len(codes)] == text[n - 1 :][: len(codes)]
            keys.append((text[: len(codes)] << np.uint64(BITS) | h)[within])
        keys.append(_words(data, at, powers))
        k = np.sort(np.concatenate(keys))
        k = k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k
        yield a, b, (k >> np.uint64(BITS)).astype(np.int32), (k & np.uint64(DIMENSIONS - 1)).astype(np.int32)


def _words(data: np.ndarray, at: np.ndarray, powers: Powers) -> np.ndarray:
    """Keys of the words, of the pairs of neighbouring words, and of the patterns of up to ``PATTERN`` neighbours: which are equal."""
    starts, ends, first = word_bounds(data, at, NOT_SPACE)
    words = span_hashes(data, starts, ends, powers, True)
    text = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(first)) << np.uint64(BITS)
    pairs = words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:] * np.uint64(0x9E3779B97F4A7C15)
    out = [text | words >> np.uint64(64 - BITS), (text[1:] | pairs >> np.uint64(64 - BITS))[text[1:] == text[:-1]]]
    equal = np.ones(len(words), np.uint64)
    for n in range(2, PATTERN + 1):
        m = max(0, len(words) - n + 1)
        equal = equal[:m].copy()
        for k in range(n - 1):
            equal = equal << np.uint64(1) | (words[k : k + m] == words[n - 1 : n - 1 + m]).astype(np.uint64)
        h = (equal + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
        out.append(np.unique((text[:m] | h)[text[:m] == text[n - 1 : n - 1 + m]]))
    return np.concatenate(out)


@dataclass
class Model:
    weights: np.ndarray
    squares: np.ndarray  # of the ratios: a text's indicators are scaled to length 1 at most
    bias: float
    slope: float
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, text, gram in ngrams(texts):
            size = np.sqrt(np.bincount(text, self.squares[gram], b - a))
            out[a:b] = np.bincount(text, self.weights[gram], b - a) / np.maximum(1.0, size)
        return 1 / (1 + np.exp(-(self.slope * (out + self.bias) + self.offset)))


def class_counts(labelled: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of label 0 and of label 1 have each n-gram; the last entry counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, DIMENSIONS + 1), np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            total[:, -1] += np.bincount(y, minlength=2)
            for a, _, text, gram in ngrams(batch.column(0)):
                total += np.pad(np.bincount(y[a + text] * DIMENSIONS + gram, minlength=2 * DIMENSIONS).reshape(2, -1), ((0, 0), (0, 1)))
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["gram", "n0", "n1"])

    rows = labelled.select(text_col, label_col).mapInArrow(count, "gram long, n0 long, n1 long")
    got = rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, DIMENSIONS + 1), np.int64)
    at = got["gram"].to_numpy()
    out[0, at], out[1, at] = got["n0"].to_numpy(), got["n1"].to_numpy()
    return out[0], out[1]


def descend(first: np.ndarray, grams: np.ndarray, ratio: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int = 3) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for the hinge loss: weights on the scaled indicators, the bias (a constant feature), and the dual."""
    rng = np.random.default_rng(seed)
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    size = np.array([float(np.sum(ratio[grams[first[i] : first[i + 1]]] ** 2)) for i in range(len(y))])
    scale = 1 / np.maximum(1.0, np.sqrt(size))
    norm = size * scale**2 + 1.0
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = grams[first[i] : first[i + 1]]
            v = ratio[g] * scale[i]
            slope = y[i] * (w[g] @ v + bias) - 1
            new = min(cost, max(0.0, dual[i] - slope / norm[i]))
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[g] += step * v
                bias += step
                dual[i] = new
    return w, bias, dual


def fit(texts: list[str], labels: list[int], n0: np.ndarray, n1: np.ndarray) -> Model:
    ratio = np.log((n1[:-1] + SMOOTHING) / (n1[-1] + 2 * SMOOTHING)) - np.log((n0[:-1] + SMOOTHING) / (n0[-1] + 2 * SMOOTHING))
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    rows, grams = [], []
    for a, _, text, gram in ngrams(pa.array(texts, pa.string())):
        rows.append(text + np.int32(a))
        grams.append(gram)
    row, gram = np.concatenate(rows), np.concatenate(grams)
    size = np.bincount(row, weights=ratio[gram] ** 2, minlength=len(y))

    def model(use: np.ndarray) -> tuple[np.ndarray, float]:
        pick = use[row]
        place = np.cumsum(use) - 1
        first = np.searchsorted(place[row[pick]], np.arange(use.sum() + 1))
        return descend(first, gram[pick], ratio, y[use], COST, ROUNDS)[:2]

    def margins(w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(row, w[gram] * ratio[gram], len(y)) / np.maximum(1.0, np.sqrt(size)) + bias

    half = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y < 0)) % 2 == 0  # of each class
    other = np.where(half, margins(*model(~half)), margins(*model(half)))
    share = np.where(y > 0, n1[-1] / max(1, (y > 0).sum()), n0[-1] / max(1, (y < 0).sum()))
    slope, offset = _logistic(other, y > 0, share)
    w, bias = model(np.ones(len(y), bool))
    return Model(w * ratio, ratio**2, bias, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ a))
        g = design.T @ (weight * (p - y)) + 1e-3 * a
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | float:
    """A model of label 1 against 0, or the share of label 1 where only one class is known (0.5 without labels)."""
    ship_package(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_y"))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    labelled = docs.select(id_col, text_col).join(F.broadcast(known) if few else known, id_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), "_y")
    labelled = labelled if few else save(labelled, "labelled")  # the texts are shuffled once, for counts and sample
    n0, n1 = class_counts(labelled, "text", "_y")
    if not n0[-1] or not n1[-1]:
        return float(n1[-1] / max(1, n0[-1] + n1[-1])) if n0[-1] + n1[-1] else 0.5
    got = sample_rows(labelled, "_y", ["id", "text"], PER_CLASS, 2 * PER_CLASS).select("text", "_y").collect()
    texts, y = [r["text"] for r in got], [r["_y"] for r in got]
    if len(set(y)) < 2:
        return float(n1[-1] / (n0[-1] + n1[-1]))
    return fit(texts, y, n0, n1)


def score_quality(docs: DataFrame, model: Model | float, text_col: str = "text", name: str = "score") -> DataFrame:
    ship_package(docs.sparkSession)
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.scores(batch))

    return docs.withColumn(name, score(F.col(text_col)))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every document; learns from labelled rows not held out."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
