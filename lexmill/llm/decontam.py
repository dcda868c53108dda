"""Benchmark decontamination: an FM-index per training shard, searched backward with benchmark windows.

A shard is a run of whole texts with about a million symbols. Words that no benchmark window has become one separator
symbol, so the index spells only stretches where windows can be; nothing that could match is left out. The index comes
from the suffix order (prefix doubling) and holds the transform in a wavelet matrix with ranked bit words, and every
eighth text position and every stretch's first as a sample. Windows are searched all at once, a symbol a step; their rows are located
by walking back to a sample, and the spans found are merged per document.

Words: A-Z in lower case, then runs of letters, digits and non-ASCII bytes. A window is 13 consecutive words of an
item, or the whole of a shorter one. Cases: null and empty texts have no words and are never contaminated; an empty
benchmark hits nothing; equal windows of several items count for each; rows of one id are one item, and so are those
without an id, which count as an item but have no name to list; a null item text has no window. Texts of any length are
read whole: a stretch of over ``PIECE`` words is indexed in pieces that overlap by a window less one word. Words are told
apart by 64-bit hashes. Rows of documents are told apart by their place, so repeated ids and rows are no matter.

The benchmark's distinct rows reach tasks in parts of about ``PART_BYTES`` of text (of one item, if that is larger), dealt
by a hash of id and text, so rows of one id fill no part. Beyond one part, documents are written once with the first
part's hits and read again for each other part, which writes row numbers and hits; a row's spans are then joined by the
words they cover. A column of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import ALNUM, Powers, slices, span_hashes, word_bounds
from lexmill.llm.frames import free
from lexmill.session import save, ship_package, table

WINDOW = 13
PART_BYTES = 8 << 20
SHARD_SYMBOLS = 1 << 20
PIECE = 1 << 19
SAMPLE = 8
#: A table of word numbers has at most this many bits of places; words that find none are searched for.
TABLE_BITS = 21


class Windows:
    """The distinct windows of some items, over a vocabulary numbered from 1."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW) -> None:
        number: dict[str | None, int] = {}
        same = [number.setdefault(i if i is None else str(i), len(number)) for i, _ in items]  # rows of one id are one item
        self.names = list(number)
        powers, hashes, owner = Powers(), [], []
        for a, _, data, at in slices(pa.array([t for _, t in items], pa.string())) if items else []:
            starts, ends, first = word_bounds(data, at, ALNUM)
            h = span_hashes(data, starts, ends, powers, True)
            for k in range(len(first) - 1):
                own = h[first[k] : first[k + 1]]
                if len(own):
                    hashes.append(own)
                    owner.append(same[a + k])
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        found: dict[bytes, set[int]] = {}
        for own, k in zip(hashes, owner, strict=True):
            ids = (np.searchsorted(self.vocabulary, own) + 1).astype(np.int32)
            for i in range(max(1, len(ids) - width + 1)):
                found.setdefault(ids[i : i + width].tobytes(), set()).add(k)
        self.lengths = np.array([len(w) // 4 for w in found], np.int64)
        self.symbols = np.zeros((len(found), width), np.int32)
        for i, w in enumerate(found):
            self.symbols[i, : len(w) // 4] = np.frombuffer(w, np.int32)
        self.least = int(self.lengths.min()) if found else 0
        self.item_first = np.concatenate([[0], np.cumsum([len(v) for v in found.values()])]).astype(np.int64)
        self.items = np.array([k for v in found.values() for k in sorted(v)], np.int64)
        self._table()

    def _table(self) -> None:
        """Two tables probed by different bits of a hash; the words that have no place in either stay in ``rest``."""
        bits = min(TABLE_BITS, max(8, int(len(self.vocabulary) * 8).bit_length()))
        while True:
            self.shifts = np.uint64(64 - bits), np.uint64(max(0, 64 - 2 * bits))
            self.mask = np.uint64((1 << bits) - 1)
            self.slots = np.zeros((2, 1 << bits), np.uint64)
            self.ids = np.zeros((2, 1 << bits), np.int32)
            left = np.arange(len(self.vocabulary))
            for k in range(2):
                at = ((self.vocabulary[left] >> self.shifts[k]) & self.mask).astype(np.int64)
                _, one = np.unique(at, return_index=True)
                self.slots[k, at[one]], self.ids[k, at[one]] = self.vocabulary[left[one]], left[one] + 1
                left = np.delete(left, one)
            if not len(left) or bits >= TABLE_BITS:
                self.rest, self.rest_ids = self.vocabulary[left], (left + 1).astype(np.int32)
                return
            bits += 1

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word hash; 0 if it has none."""
        out = np.zeros(len(hashes), np.int32)
        for k in range(2):
            at = ((hashes >> self.shifts[k]) & self.mask).astype(np.int64)
            out += np.where(self.slots[k][at] == hashes, self.ids[k][at], np.int32(0))
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes), len(self.rest) - 1)
            out += np.where(self.rest[at] == hashes, self.rest_ids[at], np.int32(0))
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes. Each 0 ends its suffix, and equal ones stand as in the text."""
    n = len(text)
    bits, place = max(1, int(text.max()).bit_length()), int(n).bit_length()
    if 3 * place + 1 > 64:
        raise ValueError("a shard has too many symbols")
    positions, low = np.arange(n, dtype=np.uint64), np.uint64((1 << place) - 1)
    zeros = np.flatnonzero(text == 0)
    left = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)  # symbols before the next 0
    known = max(1, (63 - place) // bits)
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key <<= np.uint64(bits)
        if k < n:
            key[: n - k] |= np.where(left[: n - k] >= k, text[k:], 0).astype(np.uint64)
    while True:
        order = np.sort((key << np.uint64(place)) | positions)
        at, head = (order & low).astype(np.int64), order >> np.uint64(place)
        rank = np.zeros(n, np.uint64)
        ranks = np.cumsum(np.concatenate([[True], (head[1:] != head[:-1]) | (left[at[1:]] < known)]))
        if ranks[-1] == n:
            return at
        rank[at] = ranks.astype(np.uint64)
        key = rank << np.uint64(place)
        key[: max(0, n - known)] |= rank[known:] - np.uint64(1)
        known *= 2


class WaveletMatrix:
    """Ranks and symbols of a sequence, a bit level at a time, from bit words with running counts."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.n, self.levels = bits, len(values), []
        for b in range(bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.frombuffer(np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).tobytes(), np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, counts, int(self.n - bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i, plus where the last level has the symbol's first."""
        for k, (words, counts, zeros) in enumerate(self.levels):
            ones = self._ones(words, counts, i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its place at the last level."""
        symbol = np.zeros(len(i), np.int64)
        for words, counts, zeros in self.levels:
            bit = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(words, counts, i)
            symbol = (symbol << 1) | bit.astype(np.int64)
            i = np.where(bit.astype(bool), zeros + ones, i - ones)
        return symbol, i


class FmIndex:
    """Backward search and location over one shard's symbols."""

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_order(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        origin = np.arange(int(text.max()) + 1)
        self.origin = self.wavelet.rank(origin, np.zeros(len(origin), np.int64))
        sampled = (order % SAMPLE == 0) | (text[order - 1] == 0)  # no walk goes past a separator
        self.sampled, self.samples = sampled, order[sampled]
        self.sample_rank = np.cumsum(sampled) - 1

    def _before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, i) - self.origin[symbol]

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, end row) of the windows that occur."""
        alive = np.arange(len(windows.lengths))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for k in range(int(windows.lengths.max())):
            on = windows.lengths[alive] > k
            at = np.flatnonzero(on)
            symbol = windows.symbols[alive[at], windows.lengths[alive[at]] - 1 - k].astype(np.int64)
            there = symbol < len(self.before) - 1
            symbol = np.where(there, symbol, 0)
            low[at], high[at] = np.where(there, self._before(symbol, low[at]), 0), np.where(there, self._before(symbol, high[at]), 0)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, position) of all rows in the ranges."""
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
        position, steps, left = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(left):
            done = self.sampled[row[left]]
            at = left[done]
            position[at] = self.samples[self.sample_rank[row[at]]] + steps
            left = left[~done]
            if len(left):
                symbol, at_end = self.wavelet.step(row[left])
                row[left] = self.before[symbol] + at_end - self.origin[symbol]
            steps += 1
        return which, position


class Scanner:
    """Finds the windows of a benchmark part in batches of texts."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.powers = windows, Powers()

    def batch(self, texts: pa.Array) -> dict[str, list]:
        out = {k: [] for k in ("n_words", "n_hit", "items", "spans")}
        held: list[tuple] = []
        size = 0
        for a, b, data, at in slices(texts):
            starts, ends, first = word_bounds(data, at, ALNUM)
            ids = self.windows.number(span_hashes(data, starts, ends, self.powers, True)) if len(starts) else np.zeros(0, np.int32)
            held.append((b - a, ids, starts, ends, first, at))
            size += len(ids)
            if size >= SHARD_SYMBOLS:
                self._shard(held, out)
                held, size = [], 0
        if held:
            self._shard(held, out)
        return out

    def _shard(self, held: list[tuple], out: dict[str, list]) -> None:
        ids = np.concatenate([h[1] for h in held])
        shift = np.cumsum([0] + [len(h[1]) for h in held])
        first = np.concatenate([h[4][:-1] + s for h, s in zip(held, shift, strict=False)] + [[shift[-1]]]).astype(np.int64)
        docs, begin = len(first) - 1, first[:-1]
        window, word = self._find(ids, first)
        length = self.windows.lengths[window]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + length, -1)
        hit = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        doc = np.searchsorted(first, word, "right") - 1
        n_items = self.windows.item_first[window + 1] - self.windows.item_first[window]
        each = np.repeat(np.arange(len(window)), n_items)
        item = self.windows.items[np.arange(len(each)) - np.repeat(np.cumsum(n_items) - n_items, n_items) + self.windows.item_first[window[each]]]
        pairs = np.unique(doc[each] * (len(self.windows.names) + 1) + item)
        items: list[list[str]] = [[] for _ in range(docs)]
        for p in pairs.tolist():
            items[p // (len(self.windows.names) + 1)].append(self.windows.names[p % (len(self.windows.names) + 1)])
        # merged spans as byte offsets within each text
        starts = np.concatenate([h[2] for h in held]).astype(np.int64)
        ends = np.concatenate([h[3] for h in held]).astype(np.int64)
        text_at = np.concatenate([h[5][:-1] for h in held])
        border = np.zeros(len(ids) + 1, bool)
        border[begin] = True
        opens = np.flatnonzero(hit & (border[:-1] | ~np.concatenate([[False], hit[:-1]]))) if len(ids) else np.zeros(0, np.int64)
        closes = np.flatnonzero(hit & (border[1:] | ~np.concatenate([hit[1:], [False]]))) if len(ids) else np.zeros(0, np.int64)
        spans: list[list[dict]] = [[] for _ in range(docs)]
        for o, c in zip(opens.tolist(), closes.tolist(), strict=True):
            d = int(np.searchsorted(first, o, "right")) - 1
            spans[d].append({"first_byte": int(starts[o] - text_at[d]), "end_byte": int(ends[c] - text_at[d]), "n_words": c - o + 1, "first_word": o - int(first[d])})
        out["n_words"] += np.diff(first).tolist()
        out["n_hit"] += (total[first[1:]] - total[first[:-1]]).tolist()
        out["items"] += items
        out["spans"] += spans

    def _find(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word number) of every occurrence. Only stretches of vocabulary words long enough are indexed."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(ids) or not len(self.windows.lengths):
            return none
        inside, border = ids > 0, np.zeros(len(ids) + 1, bool)
        border[first] = True
        opens = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
        closes = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        use = closes - opens >= self.windows.least
        opens, n = opens[use], (closes - opens)[use]
        if not len(opens):
            return none
        over = self.windows.symbols.shape[1] - 1  # any window lies whole in some piece
        pieces = np.maximum(1, -(-(n - over) // PIECE))
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        opens, n = np.repeat(opens, pieces) + k * PIECE, np.minimum(np.repeat(n, pieces) - k * PIECE, PIECE + over)
        found = []
        groups = np.cumsum(n + 1) // SHARD_SYMBOLS  # a piece stays whole
        for g in np.unique(groups):
            o, m = opens[groups == g], n[groups == g]
            put = np.cumsum(m + 1) - (m + 1)
            word = np.repeat(o - put, m) + (np.arange(m.sum()) + np.repeat(np.arange(len(m)), m))
            text = np.zeros(int((m + 1).sum()) + 1, np.int32)
            at = np.arange(m.sum()) + np.repeat(np.arange(len(m)), m)
            text[at] = ids[word]
            index = FmIndex(text)
            window, low, high = index.search(self.windows)
            which, position = index.locate(low, high)
            k = np.searchsorted(put, position, "right") - 1
            found.append((window[which], o[k] + position - put[k]))
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])


SPANS = "array<struct<first_byte:bigint,end_byte:bigint,n_words:bigint,first_word:bigint>>"
RESULT = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:{SPANS}>"
_SPAN = pa.struct([(k, pa.int64()) for k in ("first_byte", "end_byte", "n_words", "first_word")])
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(_SPAN)),
    ]
)


def _scan(docs: DataFrame, text_col: str, windows: Windows):
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(shared.value)
        for batch in batches:
            found = scanner.batch(batch)
            yield pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in _ARROW], fields=list(_ARROW))

    return scan(F.col(text_col))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", name: str = "hits") -> DataFrame:
    """``docs`` with a struct of n_words, n_hit, the items whose windows occur, and the merged spans to remove."""
    ship_package(docs.sparkSession)
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def scan(rows: DataFrame, k: int):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        return _scan(rows, text_col, Windows([(r.i, r.t) for r in part.collect()]))

    if parts == 1:
        return docs.withColumn(name, scan(docs, 0))
    docs = docs.drop(name)
    row, first, other, joined = free(docs, "_row", "_first", "_other", "_joined")
    docs = save(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(first, scan(docs, 0)), "decontam")
    found = docs.select(F.col(row).alias(other), F.col(first).alias("h"))
    for k in range(1, parts):
        found = found.unionByName(save(docs.select(F.col(row).alias(other), scan(docs, k).alias("h")), "decontam-hits"))
    merged = save(_merged(found.filter(F.size("h.items") > 0).groupBy(other).agg(F.collect_list("h").alias("hs")), other, joined), "decontam-hits")
    docs = docs.join(merged, F.col(row) == F.col(other), "left")
    return docs.withColumn(name, F.coalesce(joined, first)).drop(row, first, other, joined)


def _union(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's spans joined where they overlap or touch by words."""
    for batch in batches:
        n = pc.fill_null(pc.list_value_length(batch), 0).to_numpy().astype(np.int64)
        flat = batch.flatten()
        first_byte, end_byte, n_words, first_word = (flat.field(k).to_numpy() for k in range(4))
        text, end_word = np.repeat(np.arange(len(n)), n), first_word + n_words
        order = np.lexsort((first_word, text))
        width = int(end_word.max(initial=0)) + 1
        reach = np.maximum.accumulate(text * width + end_word[order]) if len(order) else order
        opens = np.flatnonzero(np.concatenate([[True], text[1:] * width + first_word[order][1:] > reach[:-1]])) if len(order) else order
        joined = [first_byte[order][opens], np.maximum.reduceat(end_byte[order], opens) if len(opens) else opens]
        joined += [np.maximum.reduceat(end_word[order], opens) - first_word[order][opens] if len(opens) else opens, first_word[order][opens]]
        at = np.searchsorted(text[opens], np.arange(len(n) + 1)).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in joined], fields=list(_SPAN)))


def _merged(hits: DataFrame, key: str, name: str) -> DataFrame:
    """The union of what the parts of a benchmark have hit in each row (``hs``); words are counted from the joined spans."""
    rows = hits.withColumn("spans", F.arrow_udf(_union, SPANS)(F.flatten(F.transform("hs", lambda h: h["spans"]))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["n_words"])
    items = F.array_distinct(F.flatten(F.transform("hs", lambda h: h["items"])))
    return rows.select(key, F.struct(F.col("hs")[0]["n_words"].alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), "spans").alias(name))


def contaminated(hits):
    return (hits.n_hit > 0) & (20 * hits.n_hit >= hits.n_words)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; 13-word windows of the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = F.col("hits")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        hits.n_words.alias("n_words"),
        hits.n_hit.alias("n_hit"),
        F.size(hits.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hits.items), ","), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
x AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM v) AS l, unnest(range(1, len(w) - n + 2)) AS t(k)),
h AS (SELECT doc_id, k, x.n, item FROM x JOIN v USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) AS t(p) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
