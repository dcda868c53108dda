"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Every byte has a small embedding; filters of several widths slide over it, each filter's greatest response in a window
is kept, and a softmax layer gives the languages. A text is cut into windows of fixed length, all of it, and the
windows' log-probabilities are averaged. For prediction, embedding and filters are folded into one table per pair of
neighbouring bytes, so a convolution is a few table rows added up; that is the same network.

One more class stands for no language: it learns from the sample's windows with their characters shuffled and from
random letters, digits and signs, as keyboard noise, keys and dumps are. Its probability is part of the result, so a
caller can reject what has letters but no language; the predicted language is always a learned one.

Training reads a bounded sample of labelled rows: at most ``PER_LANGUAGE`` documents of each language and
``MOST_ROWS`` in all, drawn by a hash of id and text, and all windows of their whole texts. A text's windows together
weigh as the root of their number, and languages weigh alike. Cases: a null text and one without a letter give ``und``
and score 0; a text shorter than a window is padded with byte 0; without any labelled row, every text gives ``und``;
a language of null or empty texts alone is never predicted; repeated rows are drawn like others, within the bounds;
columns of a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import slices
from lexmill.llm.frames import free
from lexmill.llm.samples import sample_rows
from lexmill.session import ship_package, table

LENGTH = 128
WIDTHS = (2, 3, 4)
EMBEDDING = 8
FILTERS = 12
PER_LANGUAGE = 400
MOST_ROWS = 20_000
EPOCHS = 8
#: Small samples are gone over more often, for this many steps at least.
STEPS = 400
#: Windows of fewer bytes aren't shuffled into examples of no language, as little text can be anything.
LEAST_NOISE = 48
#: A caller that rejects may take this probability of no language as its bound: no held-out text with a language reached it.
NO_LANGUAGE = 0.9
RESULTS = ("lang_pred", "score", "no_language")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x e
    filters: list[np.ndarray]  # width x e x f each
    bias: np.ndarray
    out: np.ndarray  # a column for each language, and one for none
    out_bias: np.ndarray

    def folded(self) -> list[list[np.ndarray]]:
        """For each width, tables for the byte pairs (and a last single byte) that a filter covers."""
        tables = []
        for w in self.filters:
            each = [self.embedding @ w[k] for k in range(len(w))]
            parts = [(each[k][:, None, :] + each[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(w) - 1, 2)]
            tables.append(parts + ([each[-1]] if len(w) % 2 else []))
        return [[t.astype(np.float32) for t in ts] for ts in tables]


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the begin of every window of each text. The last one of a long text ends with it."""
    n = np.diff(at)
    each = np.maximum(1, -(-n // LENGTH))
    text = np.repeat(np.arange(len(n)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return text, np.minimum(number * LENGTH, np.maximum(n[text] - LENGTH, 0))


def windows_at(data: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The windows at some places as rows of bytes, 0 beyond a text's end."""
    if not len(data):
        return np.zeros((len(text), LENGTH), np.uint8)
    rows = data.take((at[text] + start)[:, None] + np.arange(LENGTH), mode="clip")
    left = np.diff(at)[text] - start
    short = np.flatnonzero(left < LENGTH)
    rows[short] *= np.arange(LENGTH) < left[short, None]
    return rows


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text as rows of bytes, and each window's text."""
    text, start = places(at)
    return windows_at(data, at, text, start), text


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


class Predictor:
    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.folded()

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        pooled = []
        for width, tables in zip(WIDTHS, self.tables, strict=True):
            m = LENGTH - width + 1
            total = tables[0][pairs[:, :m]]
            for k, t in enumerate(tables[1:], 1):
                total += t[pairs[:, 2 * k : 2 * k + m]] if len(t) > 256 else t[rows[:, 2 * k : 2 * k + m]]
            pooled.append(total.max(1))
        hidden = np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0)
        return log_softmax(hidden @ self.net.out + self.net.out_bias)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number, its probability, and that of no language, of each text."""
        best, score, none = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        for a, b, data, at in slices(texts, 1 << 18):
            text, start = places(at)
            sums = np.zeros((b - a, len(self.net.languages) + 1))
            for k in range(0, len(text), 2048):  # a long text's windows are never all there at once
                own = slice(k, k + 2048)
                np.add.at(sums, text[own], self.log_probabilities(windows_at(data, at, text[own], start[own])))
            p = np.exp(log_softmax(sums / np.bincount(text, minlength=b - a)[:, None]))
            best[a:b], score[a:b], none[a:b] = p[:, :-1].argmax(1), p[:, :-1].max(1), p[:, -1]
        return best, score, none


def noise(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` windows of no language: two in three are some of ``rows`` with their characters shuffled, the others random signs."""
    out = np.zeros((n, LENGTH), np.uint8)
    full = rows[(rows > 0).sum(1) >= LEAST_NOISE]
    signs = [np.frombuffer(x, np.uint8) for x in (b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz", bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"+/=_-")]
    for k in range(n):
        if k % 3 and len(full):
            text = list(full[rng.integers(len(full))].tobytes().decode(errors="ignore").rstrip("\0"))
            rng.shuffle(text)
            own = np.frombuffer("".join(text).encode(), np.uint8)
        else:
            own = rng.choice(signs[rng.integers(len(signs))], rng.integers(LEAST_NOISE, LENGTH + 1))
            own[rng.random(len(own)) < rng.choice([0.0, 0.05, 0.15])] = 0x20
        out[k, : len(own)] = own
    return out


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """Adam on cross-entropy; the gradient goes through each filter's greatest window place alone."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    number = {x: k for k, x in enumerate(languages)}
    rows, y, root = [], [], []
    for a, b, data, at in slices(pa.array(texts, pa.string())):
        r, text = windows_of(data, at)
        rows.append(r)
        y.append(np.array([number[x] for x in labels[a:b]])[text])
        root.append(np.bincount(text)[text] ** -0.5)
    x, y, root = np.concatenate(rows), np.concatenate(y), np.concatenate(root)
    false = noise(x, -(-len(x) // len(languages)), rng)
    x, y, root = np.concatenate([x, false]), np.append(y, np.full(len(false), len(languages))), np.append(root, np.ones(len(false)))
    weight = root * (len(y) / ((len(languages) + 1) * np.bincount(y, root, len(languages) + 1)))[y]
    total = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.5, (256, EMBEDDING))] + [rng.normal(0, 0.35, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(total), rng.normal(0, 0.2, (total, len(languages) + 1)), np.zeros(len(languages) + 1)]
    params = [p.astype(np.float32) for p in params]
    first_m, second_m, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(EPOCHS, -(-STEPS * 128 // len(x)))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 128):
            batch = order[k : k + 128]
            grads = _gradients(params, x[batch], y[batch], weight[batch])
            t += 1
            rate = 0.01 * 0.5 ** (3 * epoch // epochs)
            for p, g, m, v in zip(params, grads, first_m, second_m, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return Network(languages, params[0], params[1:-3], *params[-3:])


def _gradients(params: list[np.ndarray], rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    emb, convs, bias, out, out_bias = params[0], params[1:-3], *params[-3:]
    n = len(rows)
    e = emb[rows]
    pooled, best = [], []
    for w in convs:
        m = LENGTH - len(w) + 1
        total = sum(e[:, k : k + m] @ w[k] for k in range(len(w)))
        at = total.argmax(1)
        best.append(at)
        pooled.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
    raw = np.concatenate(pooled, 1) + bias
    hidden = np.maximum(raw, 0)
    d = np.exp(log_softmax(hidden @ out + out_bias))
    d[np.arange(n), y] -= 1
    d *= (weight / n)[:, None]
    g_hidden = (d @ out.T) * (raw > 0)
    g_emb, g_convs = np.zeros_like(emb), []
    for j, (w, at) in enumerate(zip(convs, best, strict=True)):
        g = g_hidden[:, j * FILTERS : (j + 1) * FILTERS]
        gw = np.zeros_like(w)
        for k in range(len(w)):
            place = at + k
            own = e[np.arange(n)[:, None], place]  # n x f x e
            gw[k] = np.einsum("nf,nfe->ef", g, own)
            np.add.at(g_emb, rows[np.arange(n)[:, None], place], g[:, :, None] * w[k].T[None])
        g_convs.append(gw)
    return [g_emb, *g_convs, g_hidden.sum(0), hidden.T @ d, d.sum(0)]


def sample_labelled(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> tuple[list[str], list[str]]:
    """Whole texts and languages of at most ``per_language`` rows of each language and ``most`` in all; empty texts teach nothing."""
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = sample_rows(rows, "lang", ["id", "text"], per_language, most).select("lang", "text").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def identify_language(docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang", prefix: str = "", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``no_language`` (a probability), named with ``prefix``, from a network fitted on ``training``."""
    spark = docs.sparkSession
    ship_package(spark)
    texts, labels = sample_labelled(training, text_col, lang_col, id_col)
    pred, score, none = (f"{prefix}{x}" for x in RESULTS)
    if not texts:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0), none: F.lit(1.0)})
    shared = spark.sparkContext.broadcast(train(texts, labels))

    @F.arrow_udf("struct<lang:string,score:double,none:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Predictor(shared.value)
        names = np.array(model.net.languages, object)
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch, r"\p{L}"), False)
            best, p, q = model.batch(batch)
            lang = pc.if_else(letters, pa.array(names[best], pa.string()), "und")
            yield pa.StructArray.from_arrays([lang, pc.if_else(letters, pa.array(p), 0.0), pc.if_else(letters, pa.array(q), 1.0)], ["lang", "score", "none"])

    (found,) = free(docs, "_found")
    return docs.withColumn(found, predict(F.col(text_col))).withColumns({pred: F.col(found).lang, score: F.col(found).score, none: F.col(found).none}).drop(found)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that no learning sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, no_language of every document; trained on the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs.select("doc_id", "text", held_out().alias("held_out")), docs.filter(~held_out())).select("doc_id", "held_out", "lang_pred", "score", "no_language")
