"""Token counts of whole texts under a sentencepiece BPE model, by rank-synchronous array merging.

Pre-tokens (a run of spaces and what follows up to the next space; a line break alone) are held as ragged numpy
arrays, cut where two characters stand together in no piece, as no merge reaches over such a place. In each round every
sequence merges its pair of lowest rank, all sequences at once: from the left, every occurrence up to the first one
whose merging makes a pair of as low a rank, which is what one merge at a time comes to. Sequences without a pair leave,
and their surviving symbols are counted. Characters that the model doesn't know count one token a byte. Pre-tokens seen
before are looked up by a 64-bit hash of their bytes.

Cases: null and empty texts have no tokens; texts and pre-tokens of any length are counted whole (a round costs what is
left of the sequences, and a long one takes at most a round for each rank and each such stop); repeated rows count alike;
an empty table gives no rows; a column of the count's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import Powers, slices, span_hashes
from lexmill.session import ship_package, table

NEVER = np.int64(1) << 40
CACHE_BITS = 19


class BpeArrays:
    """Symbols and merges of a model: code point to symbol, and pair of symbols to rank and merged symbol."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on past a space: texts can't be split there")
        order = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        # what takes part in a merge needn't be a piece itself, so symbols are all strings that pieces can be cut into, chars first
        symbol = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p}))}
        for p in pieces:
            symbol.setdefault(p, len(symbol))
        self.n = len(symbol)
        self.known = np.zeros(self.n, bool)
        self.size = np.array([len(s.encode()) for s in symbol], np.int64)
        for p in pieces:
            self.known[symbol[p]] = True
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        pairs = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (order[score], symbol[p])
        keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[int(k)][0] for k in keys] + [NEVER], np.int64)
        self.merged = np.array([pairs[int(k)][1] for k in keys] + [0], np.int32)
        self._hash(keys)
        together = {(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1)}
        self.together = np.array(sorted(symbol[a] * self.n + symbol[b] for a, b in together), np.int64)

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing with linear steps; ``steps`` is the longest probe."""
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.where = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(keys), np.int32)
        at, left, self.steps = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.steps += 1
            free = left[self.slots[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]], self.where[at[put]] = keys[put], put
            left = left[self.slots[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair is in ``rank`` and ``merged``; the last place means no such pair."""
        keys = a.astype(np.int64) * self.n + b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        got = np.full(len(keys), len(self.rank) - 1, np.int32)
        left = np.arange(len(keys))
        for _ in range(self.steps):
            there = self.slots[at[left]]
            hit = there == keys[left]
            got[left[hit]] = self.where[at[left[hit]]]
            left = left[~hit & (there >= 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
        return got

    def tokens(self, symbols: np.ndarray, unknown_bytes: np.ndarray) -> np.ndarray:
        """Tokens that each surviving symbol gives: one, or its bytes if it's no piece."""
        s = np.maximum(symbols, 0)
        return np.where(symbols < 0, unknown_bytes, np.where(self.known[s], 1, self.size[s]))

    def count(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each ragged row of code points; ``first`` has one entry more than there are rows."""
        total = np.zeros(len(first) - 1, np.int64)
        if not len(points):
            return total
        owner = np.repeat(np.arange(len(total)), np.diff(first))
        symbols = self.of_char[points]
        cost = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        key = symbols[:-1].astype(np.int64) * self.n + symbols[1:]
        near = self.together[np.minimum(np.searchsorted(self.together, key), len(self.together) - 1)] == key if len(self.together) else np.zeros(len(key), bool)
        near &= (owner[1:] == owner[:-1]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        row = np.cumsum(np.concatenate([[True], ~near])) - 1
        np.add.at(total, owner[np.flatnonzero(np.concatenate([[True], ~near]))], self._merge(row, symbols, cost))
        return total

    def _merge(self, row: np.ndarray, symbols: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Tokens of each row of symbols; rows are numbered from 0 and none is empty."""
        none = len(self.rank) - 1
        total = np.zeros(row[-1] + 1, np.int64)
        pair = np.full(len(row), none, np.int32)
        same = np.flatnonzero(row[1:] == row[:-1])
        pair[same] = self.lookup(symbols[same], symbols[same + 1])
        while len(row):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(row)]]))
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                out = np.repeat(over, sizes)
                np.add.at(total, row[out], self.tokens(symbols[out], cost[out]))
                row, symbols, cost, pair, rank = row[~out], symbols[~out], cost[~out], pair[~out], rank[~out]
                if not len(row):
                    break
                least, sizes = least[~over], sizes[~over]
            at = self._at_once(np.flatnonzero(rank == np.repeat(least, sizes)), row, symbols, pair, rank)
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            row, symbols, cost, pair = row[keep], symbols[keep], cost[keep], pair[keep]
            at = place[at]
            # the merged symbol has a new pair on its right, and its left neighbour too
            ends = np.concatenate([row[1:] != row[:-1], [True]])
            right = at[~ends[at]]
            pair[at[ends[at]]] = none
            pair[right] = self.lookup(symbols[right], symbols[right + 1])
            left = at[at > 0] - 1
            left = left[~ends[left]]
            pair[left] = self.lookup(symbols[left], symbols[left + 1])
        return total

    def _at_once(self, at: np.ndarray, row: np.ndarray, symbols: np.ndarray, pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which of the lowest pairs ``at`` merge in one round: from the left of each row, none that overlaps the last,
        up to the first whose merging makes a pair of as low a rank."""
        opens = np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])])
        run = np.flatnonzero(opens)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        head = np.concatenate([[True], row[at[1:]] != row[at[:-1]]])
        if head.all():
            return at
        merged, lowest = self.merged[pair[at]], rank[at]
        stop = np.zeros(len(at), bool)
        has = np.flatnonzero((at > 0) & (row[np.maximum(at - 1, 0)] == row[at]))
        before = symbols[at[has] - 1]
        after_last = np.flatnonzero(~head[has] & (at[has] - 2 == at[has - 1]))  # the last merged symbol stands before
        before[after_last] = merged[has[after_last] - 1]
        stop[has] = self.rank[self.lookup(before, merged[has])] <= lowest[has]
        has = np.flatnonzero((at + 2 < len(row)) & (row[np.minimum(at + 2, len(row) - 1)] == row[at]))
        stop[has] |= self.rank[self.lookup(merged[has], symbols[at[has] + 2])] <= lowest[has]
        stops = np.cumsum(stop) - stop  # stops before each
        first = np.flatnonzero(head)
        return at[stops == np.repeat(stops[first], np.diff(np.append(first, len(at))))]


class Counter:
    """Counts batches of texts; keeps the counts of pre-tokens in a direct-mapped table of fixed size."""

    def __init__(self, model: BpeArrays) -> None:
        self.model, self.powers = model, Powers()
        self.keys, self.counts = np.zeros(1 << CACHE_BITS, np.uint64), np.zeros(1 << CACHE_BITS, np.int64)

    def batch(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        if pc.any(pc.match_substring(texts, "▁")).as_py():
            texts = pc.replace_substring(texts, "▁", " ")
        empty = pc.equal(pc.binary_length(texts), 0)
        texts = pc.if_else(empty, texts, pc.binary_join_element_wise(" ", texts, ""))
        out = np.zeros(len(texts), np.int64)
        for a, b, data, at in slices(texts):
            if len(data):
                out[a:b] = self._slice(data, at)
        return out

    def _slice(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        space, line = data == 0x20, data == 0x0A
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[at[:-1][np.diff(at) > 0]] = True
        new |= line
        new[1:] |= line[:-1]
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(data)]])
        hashes = span_hashes(data, starts, ends, self.powers, False)
        slot = (hashes >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        counts = self.counts[slot]
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            _, one, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            mine = miss[one]
            fresh = self._encode(data, starts[mine], ends[mine])
            counts[miss] = fresh[back]
            self.keys[slot[mine]], self.counts[slot[mine]] = hashes[mine], fresh
        sums = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(starts, at)
        return sums[first[1:]] - sums[first[:-1]]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        first = np.concatenate([[0], np.cumsum(n)])
        own = data[np.arange(first[-1]) + np.repeat(starts - first[:-1], n)]
        points = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 0x20] = 0x2581
        chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        return self.model.count(points, chars[first])


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, text_col: str = "text", model_file: str | None = None, name: str = "n_tokens"):
    """``docs`` with a long column of token counts; ``model_file`` must be readable on every executor."""
    ship_package(docs.sparkSession)
    where = model_file

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(BpeArrays(where or model_path()))
        for batch in batches:
            yield pa.array(counter.batch(batch), pa.int64())

    return docs.withColumn(name, tokens(F.col(text_col)))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (over 4096 tokens) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )
