"""Periodic runs of words: maximal stretches that repeat with a smallest period, at least four times over.

Each text's words are numbered, and suffixes are ordered by doubling, where only suffixes that still have an equal go on.
Longest common prefixes come from those that can't be derived from the word before (compared directly) and from the rest
(one less than the word before). Then neighbours in suffix order are united from the greatest common prefix down, with
union-find over ordered sets of positions, the smaller set into the larger. Two positions that become neighbours in their
set at distance d, when the common prefix is l >= d, begin a stretch of length d + l with smallest period d: with a smaller
period, the place one such period on would stand between them. It is the run itself if the words before the two positions
differ, so each run is found once. Prefixes that no long enough run has are left out of the order at the start.

Cases: a null text has no words and no run; texts of any length are handled whole, with memory in proportion to the words
of one text or of a slice of short ones; runs may overlap; repeated rows have equal runs; an empty table gives no rows; a
column of the result's name is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import let
from lexmill.session import ship_package, table

#: A run has at least this many words and periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SLICE_WORDS = 1 << 18
COMPARE = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"
RESULT = f"struct<n_words:long,runs:{RUNS},collapsed:string>"


def number_words(words: list[bytes], first: int) -> np.ndarray:
    """Each word as the place of its first occurrence in the text, counted from ``first``."""
    return np.fromiter(map({}.setdefault, words, range(first, first + len(words))), np.int64, len(words))


def suffix_order(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of all suffixes; a suffix ends at its text's ``end``, and ``ids`` of different texts differ.

    Suffixes of equal first words form a class, whose rank is its place in the order; classes of several are refined.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    size = np.bincount(rank)
    rank = (np.cumsum(size) - size)[rank]
    many = np.bincount(rank, minlength=n)[rank] > 1
    order = np.zeros(n, np.int64)
    order[rank[~many]] = np.flatnonzero(~many)
    left, step = np.flatnonzero(many), 1
    while len(left):
        ahead = left + step
        key = np.where(ahead < end[left], rank[np.minimum(ahead, n - 1)], -1)
        at = np.lexsort((key, rank[left]))
        left, key = left[at], key[at]
        base = rank[left]
        old = np.concatenate([[True], base[1:] != base[:-1]])
        head = np.flatnonzero(old | np.concatenate([[True], key[1:] != key[:-1]]))
        start = np.flatnonzero(old)
        within = np.arange(len(left)) - np.repeat(start, np.diff(np.append(start, len(left))))
        sizes = np.diff(np.append(head, len(left)))
        rank[left] = base + np.repeat(within[head], sizes)
        many = np.repeat(sizes > 1, sizes)
        order[rank[left[~many]]] = left[~many]
        left = left[many]
        step *= 2
    return order


def common_prefixes(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal words from ``a`` and ``b`` on; texts don't share ids, and the second of a pair may run out."""
    out, n = np.zeros(len(a), np.int64), len(ids)
    left, width = np.arange(len(a)), 4
    while len(left):
        going = []
        for k in range(0, len(left), max(1, COMPARE // width)):
            own = left[k : k + max(1, COMPARE // width)]
            x, y = (p[own] + out[own] for p in (a, b))
            steps = np.arange(width)
            i, j = x[:, None] + steps, y[:, None] + steps
            same = (ids[np.minimum(i, n - 1)] == ids[np.minimum(j, n - 1)]) & (i < n) & (j < n)
            short = ~same.all(1)
            out[own] += np.where(short, same.argmin(1), width)
            going.append(own[~short])
        left = np.concatenate(going)
        width *= 2
    return out


def neighbour_prefixes(ids: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix in the order with the one before; 0 for the first."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.arange(n)
    last, other = np.maximum(own - 1, 0), np.maximum(before - 1, 0)
    derived = (own > 0) & (before > 0) & (ids[last] == ids[other]) & (end[last] == end[own]) & (end[other] == end[before])
    direct = np.flatnonzero(~derived & (before >= 0))
    value = np.zeros(n, np.int64)
    value[direct] = common_prefixes(ids, direct, before[direct])
    source = np.maximum.accumulate(np.where(derived, 0, own))
    value = np.where(derived, value[source] - (own - source), value)
    return value[order]


def seed_runs(ids: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by uniting neighbours of the order from the greatest common prefix down."""
    least = max(LEAST_PERIODS + 1, LEAST_WORDS - 1)  # the least common prefix of a run's first two periods
    edges = np.flatnonzero(prefix >= least)
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    sets: dict[int, list[int]] = {}
    parent: dict[int, int] = {}
    found = []
    times = LEAST_PERIODS - 1
    word = ids.tolist() if len(edges) else []

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y, common in zip(order[edges - 1].tolist(), order[edges].tolist(), prefix[edges].tolist(), strict=True):
        for v in (x, y):
            if v not in parent:
                parent[v], sets[v] = v, [v]
        x, y = root(x), root(y)
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small = sets[x], sets.pop(y)
        parent[y] = x
        before = -1
        for v, after in zip(small, [*small[1:], len(ids)], strict=True):
            k = bisect_left(large, v)
            if k and before < large[k - 1] and times * (v - large[k - 1]) <= common:
                found.append((large[k - 1], v - large[k - 1], common))
            if k < len(large) and large[k] < after and times * (large[k] - v) <= common:
                found.append((v, large[k] - v, common))
            before = v
        if len(small) < 8:
            for v in small:
                insort(large, v)
        else:
            large += small
            large.sort()  # two ordered runs
    return [(i, common + d, d) for i, d, common in found if common + d >= LEAST_WORDS and (i == 0 or word[i - 1] != word[i + d - 1])]


def runs_of(texts: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of the texts' words, by text, start and period."""
    first = np.cumsum([0, *map(len, texts)])
    ids = np.concatenate([np.zeros(0, np.int64), *(number_words(t, int(a)) for t, a in zip(texts, first, strict=False))])
    if not len(ids):
        return []
    end = np.repeat(first[1:], np.diff(first))
    # texts without a repeated stretch of the least length have no run
    least = max(LEAST_PERIODS + 1, LEAST_WORDS - 1)
    stretch = ids.copy()
    for k in range(1, least):
        stretch[:-k] = stretch[:-k] * np.int64(0x5851F42D4C957F2D) + ids[k:]
    whole = np.flatnonzero(np.arange(len(ids)) + least <= end)
    keys, count = np.unique(stretch[whole], return_counts=True)
    repeated = whole[count[np.searchsorted(keys, stretch[whole])] > 1]
    has = np.unique(np.searchsorted(first, repeated, "right") - 1)
    if not len(has):
        return []
    sizes = np.diff(first)[has]
    own = np.concatenate([ids[first[t] : first[t + 1]] for t in has])
    bound = np.concatenate([[0], np.cumsum(sizes)])
    end = np.repeat(bound[1:], sizes)
    order = suffix_order(own, end)
    found = np.array(seed_runs(own, order, neighbour_prefixes(own, end, order)), np.int64).reshape(-1, 3)
    text = np.searchsorted(bound, found[:, 0], "right") - 1
    rows = np.stack([has[text], found[:, 0] - bound[text], found[:, 1], found[:, 2]], 1)
    return [tuple(r) for r in rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].tolist()]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _sliced(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for t in pc.fill_null(texts, "").cast(pa.large_binary()):
        words = t.as_py().split()  # at the bytes of SPACE
        if part and size + len(words) > SLICE_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def find_runs(docs: DataFrame, text_col: str = "text", name: str = "periodic") -> DataFrame:
    """``docs`` with a struct: n_words, runs (start, length, period by start and period), collapsed (the text without the
    words that a run repeats after its first period, joined by one space)."""
    ship_package(docs.sparkSession)
    rest = docs.drop(name)
    names, at, keep = [*rest.columns, name], docs.columns.index(text_col), [k for k, c in enumerate(docs.columns) if c in rest.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, collapsed = [], [], []
            for texts in _sliced(batch.column(at)):
                own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for t, *r in runs_of(texts):
                    own[t].append(tuple(r))
                n_words += map(len, texts)
                runs += own
                collapsed += [b" ".join(kept_words(w, r)).decode() for w, r in zip(texts, own, strict=True)]
            flat = np.array(list(chain.from_iterable(runs)), np.int64).reshape(-1, 3)
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in flat.T], ["start", "length", "period"]))
            found = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), listed, pa.array(collapsed, pa.string())], ["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], names)

    return docs.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.StructType.fromDDL(RESULT.removeprefix("struct<")[:-1]))]))


def plant_periods(id_col: Column, text: Column) -> Column:
    """The text; of an id whose crc32 is divisible by ten, its words, which repeat from some place on.

    With g the rest of crc32 over ten: from word a = g % n on, the next 1 + (n - a) / (3 + g % 8) words repeat.
    """
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    place = lambda w: g % F.size(w)
    length = lambda w, a: 1 + F.floor((F.size(w) - a) / (3 + g % 8))
    repeated = lambda w, a, p: F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
    planted = let(words, lambda w: let(place(w), lambda a: let(length(w, a), lambda p: F.array_join(repeated(w, a, p), " "))))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), planted).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document, after ``plant_periods``: n_runs, the longest run (start, length, period, exponent_milli), digests of
    all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", plant_periods(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("periodic.runs")
    best = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 0)
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return find_runs(docs).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )


def _level_sql(k: int) -> str:
    """Stretches of 2^(k + 1) words that occur twice in their text, from those of half the length."""
    return f"""
l{k + 1} AS MATERIALIZED (SELECT r, i, c FROM (SELECT a.r, a.i, dense_rank() OVER (ORDER BY a.c, b.c) AS c, count(*) OVER (PARTITION BY a.c, b.c) AS m
  FROM l{k} AS a JOIN l{k} AS b ON a.r = b.r AND b.i = a.i + {1 << k}) WHERE m > 1),"""


#: Another way: stretches of 2^k words and their next occurrence; a run of period q has that at q at each place, where 2^k is
#: the next power from q on. 15 powers are enough for texts of 65,536 words.
_POWERS = 15
OP11_SQL = rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))::BIGINT[]),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) AS h FROM documents),
g AS (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM g),
d AS MATERIALIZED (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
x AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM d),
l0 AS MATERIALIZED (SELECT r, i, dense_rank() OVER (ORDER BY r, word) AS c FROM x),{"".join(_level_sql(k) for k in range(_POWERS - 1))}
n AS ({" UNION ALL ".join(f"SELECT r, i, {1 << k} AS g, lead(i) OVER (PARTITION BY c ORDER BY i) - i AS d FROM l{k}" for k in range(_POWERS))}),
s AS (SELECT *, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS island FROM n WHERE d <= g AND 2 * d > g),
u AS MATERIALIZED (SELECT r, min(i) AS start, max(i) - min(i) + d + g AS length, d AS period FROM s GROUP BY r, d, g, island HAVING max(i) - min(i) + d + g >= greatest(6, 4 * d)),
b AS (SELECT r, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u) AS o USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""
