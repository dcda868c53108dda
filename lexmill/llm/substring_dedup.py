"""Substring dedup: remove sentences that a repeated run of sentences covers, except where the run stands first.

A text's sentences end at a word with a stop (``.``, ``!``, ``?`` and those of other scripts) last, or at a line break.
Words are what stands between white space; a character of three or four bytes in UTF-8 is a word of its own, so texts
without spaces have words too. A sentence of over ``LONGEST`` words is cut before the word of least hash of every
``SPAN`` consecutive ones, so it is cut alike wherever a passage begins in it. A run is at least ``SEVERAL`` consecutive
sentences with at least ``LEAST_WORDS`` words; of two short sentences the next are in it too, as fewer words repeat by
chance. Every shortest run is hashed from its lower-cased words, sliding by a sentence: on from each, and back from each.
The hashes are joined over all documents, with partial counts before the shuffle; a run is first in the document of least
id, at its first place there, and the sentences of every other one are removed. A repeated passage of over 50 words
holds a whole run, wherever it stands.

Cases: null and empty texts have no sentences and stay as they are, and a text of one sentence has no run; a text all of
whose sentences go becomes empty; rows with the same id count as one document, each with its own text; rows repeated
whole are all cut alike; a null id keeps its text whole; an empty table gives no rows. Columns of a result's name are
replaced.
Hot runs: the runs are written once and counted with partial counts; they are joined back from that table, so AQE splits
hot ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import NOT_SPACE, Powers, byte_class, slices, span_hashes, word_bounds
from lexmill.llm.frames import free
from lexmill.session import save, ship_package, table

SEVERAL = 2
LEAST_WORDS = 13
LONGEST = 16
SPAN = 12
#: Windows of a long sentence whose least words are looked for at once.
WINDOWS = 1 << 16
_STOP = byte_class([(0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)])
_WIDE = 0xE0
#: Stops of other scripts.
STOPS = "؟۔।॥…。｡．！？"
_STOPS = {n: np.array([int.from_bytes(c.encode(), "big") for c in STOPS if len(c.encode()) == n], np.uint32) for n in (2, 3)}


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's first word; characters of three and four bytes are words of their own."""
    starts, ends, first = word_bounds(data, at, NOT_SPACE)
    lead = np.flatnonzero(data >= _WIDE)
    if not len(lead):
        return starts, ends, first
    begin = np.zeros(len(data) + 1, bool)
    begin[starts] = begin[lead] = True
    after = lead + np.where(data[lead] >= 0xF0, 4, 3)
    after = after[after < len(data)]
    begin[after[NOT_SPACE[data[after]]]] = True
    own = np.flatnonzero(begin[:-1])
    ends = np.minimum(ends[np.searchsorted(starts, own, "right") - 1], np.append(own[1:], len(data)))
    return own, ends, np.searchsorted(own, at)


def _stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word ends with a stop."""
    out = _STOP[data[ends - 1]]
    high = np.flatnonzero((data[ends - 1] >= 0x80) & (ends - starts >= 2))
    for n, codes in _STOPS.items():
        at = ends[high][ends[high] - starts[high] >= n]
        code = np.zeros(len(at), np.uint32)
        for k in range(n, 0, -1):
            code = code << np.uint32(8) | data[at - k]
        out[high[ends[high] - starts[high] >= n]] |= np.isin(code, codes)
    return out


class Sentences:
    """The sentences of a slice of texts, numbered through: first word of each (and an end), and each text's first sentence."""

    def __init__(self, data: np.ndarray, at: np.ndarray, powers: Powers) -> None:
        self.starts, self.ends, self.word_first = words_of(data, at)
        n = len(self.starts)
        self.hashes = span_hashes(data, self.starts, self.ends, powers, True) if n else np.zeros(0, np.uint64)
        opens = np.zeros(n + 1, bool)
        opens[self.word_first] = True
        if n:
            lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
            opens[1:n] |= _stops(data, self.starts, self.ends)[:-1] | (lines[self.starts[1:]] > lines[self.ends[:-1]])
            begin = np.flatnonzero(opens[:n])
            size = np.diff(np.append(begin, n))
            begin, each = begin[size > LONGEST], size[size > LONGEST] - SPAN
            window = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin + 1, each)
            for k in range(0, len(window), WINDOWS):
                w = window[k : k + WINDOWS]
                opens[w + self.hashes[w[:, None] + np.arange(SPAN)].argmin(1)] = True
        self.word = np.append(np.flatnonzero(opens[:n]), n)
        self.first = np.searchsorted(self.word[:-1], self.word_first)


def run_rows(data: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(hash, text, first sentence in the text, end sentence, whether the text has that hash before) of all shortest runs."""
    s = Sentences(data, at, powers)
    begin, end, n = s.word[:-1], s.word[1:], len(s.word) - 1
    text, number = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first)), np.arange(n)
    to = np.maximum(np.searchsorted(end, begin + LEAST_WORDS), number + SEVERAL - 1)
    back = np.minimum(np.searchsorted(begin, end - LEAST_WORDS, "right") - 1, number - SEVERAL + 1)
    on, off = to < s.first[1:][text], back >= s.first[:-1][text]
    pairs = np.unique(np.concatenate([number[on] * (n + 1) + to[on] + 1, back[off] * (n + 1) + number[off] + 1]))
    i, j = pairs // (n + 1), pairs % (n + 1)
    if not len(i):
        return np.zeros(0, np.uint64), i, i, j, np.zeros(0, bool)
    up, down = powers.upto(len(s.hashes))
    sums = np.zeros(len(s.hashes) + 1, np.uint64)
    np.cumsum(s.hashes * up[: len(s.hashes)], out=sums[1:])
    a, b, text = s.word[i], s.word[j], text[i]
    h = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    order = np.lexsort((i, h, text))
    again = np.zeros(len(h), bool)
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    again[order[1:][same]] = True
    base = s.first[:-1][text]
    return h, text, i - base, j - base, again


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for a, b, data, at in slices(batch.column(2)):
            h, text, i, j, again = run_rows(data, at, powers)
            doc, version = (batch.column(k).slice(a, b - a).take(pa.array(text)) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), doc, version, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(again)], ["h", "doc", "version", "i", "j", "again"])


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    powers = Powers()
    for texts, marks in batches:
        out, total, gone, spans = [], [], [], []
        for a, b, data, at in slices(texts):
            s = Sentences(data, at, powers)
            for k in range(a, b):
                lo, hi = int(s.first[k - a]), int(s.first[k - a + 1])
                total.append(hi - lo)
                own = marks[k].values
                if own is None or not len(own):
                    gone.append(0)
                    out.append(None)
                    spans.append([])
                    continue
                i, j = (own.field(x).to_numpy() for x in range(2))
                cover = np.bincount(i, minlength=hi - lo + 1) - np.bincount(j, minlength=hi - lo + 1)
                drop = np.cumsum(cover[:-1]) > 0
                gone.append(int(drop.sum()))
                # a sentence reaches to the next one's first word, and the first one from the text's begin
                edges = np.concatenate([s.starts[s.word[lo:hi]], [at[k - a + 1]]])
                edges[0] = at[k - a]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                cuts = [(int(edges[x]), int(edges[y])) for x, y in turn.reshape(-1, 2)]
                kept, last = [], int(at[k - a])
                for x, y in cuts:
                    kept.append(data[last:x].tobytes())
                    last = y
                kept.append(data[last : at[k - a + 1]].tobytes())
                out.append(b"".join(kept).decode())
                spans.append([{"first_byte": x - int(at[k - a]), "end_byte": y - int(at[k - a])} for x, y in cuts])
        yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, _SPANS)], ["text", "n_sentences", "n_removed", "removed"])


_SPANS = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())]))
_RESULT = "struct<text:string,n_sentences:bigint,n_removed:bigint,removed:array<struct<first_byte:bigint,end_byte:bigint>>>"


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, i, j): runs that don't stand first; i and j number the sentences, j left out; version is the text's hash."""
    ship_package(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    runs = save(rows.mapInArrow(_runs, "h long, doc long, version long, i int, j int, again boolean"), "runs", compression="zstd")
    counted = runs.filter("not again").groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = save(counted.filter("first <> last").select("h", "first"), "repeated")
    later = runs.filter("not again").join(repeated, "h").filter("doc <> first").select("doc", "version", "i", "j")
    return later.unionByName(runs.filter("again").select("doc", "version", "i", "j"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the text cut, and n_sentences, n_removed and the removed byte spans of the old text (named with ``prefix``)."""
    key, version, cut, held = free(docs, "_doc", "_version", "_cut", "_marks")
    marks = repeated_runs(docs, id_col, text_col).groupBy(F.col("doc").alias(key), F.col("version").alias(version)).agg(F.collect_set(F.struct("i", "j")).alias(held))
    joined = docs.join(marks, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(version)), "left").drop(key, version)
    done = joined.withColumn(cut, F.arrow_udf(_cut, _RESULT)(F.col(text_col), F.col(held)))
    done = done.withColumn(text_col, F.coalesce(f"{cut}.text", text_col))
    return done.withColumns({f"{prefix}{x}": F.col(f"{cut}.{x}") for x in ("n_sentences", "n_removed", "removed")}).drop(cut, held)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, the text without repeated sentences, n_sentences, n_removed, and the removed byte spans."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
