"""Periodic runs, vector codes and licence scans against brute force and SQL."""

import glob
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from lexmill.llm.license_scan import OP13_SQL, TEMPLATES, Index, Template, op13_license_scan, scan_licenses, word_counts
from lexmill.llm.periodic_runs import OP11_SQL, common_prefixes, find_runs, kept_words, neighbour_prefixes, op11_periodic_runs, runs_of, suffix_order
from lexmill.llm.vector_codes import OP12_SQL, Nearest, compress_vectors, op12_vector_codes, sum_over


@pytest.mark.parametrize("query,sql", [(op11_periodic_runs, OP11_SQL), (op12_vector_codes, OP12_SQL), (op13_license_scan, OP13_SQL)])
def test_same_rows_as_sql(spark, small, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, rel = query(spark, small), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(repr, ([r[c] for c in rel.columns] for r in df.collect()))) == sorted(map(repr, map(list, rel.fetchall())))


# periodic runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(i, i + length - p)))
            if length >= max(6, 4 * q) and smallest == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n = rng.choice([0, 1, 5, 6, 7, 30, 120])
    w = [rng.choice("ab" if rng.random() < 0.6 else "abcdefgh") for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2, 3])):
        p = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        at = rng.randint(0, len(w))
        w[at:at] = (p * 9)[: rng.randint(4 * len(p) - 2, 9 * len(p))]
    return [x.encode() for x in w]


def test_runs_against_brute_force():
    rng = random.Random(11)
    texts = [some_words(rng) for _ in range(600)] + [[b"x"] * n for n in range(9)] + [[b"x", b"y"] * 40, [b"x"] * 500 + [b"y"] + [b"x"] * 500]
    for part in (texts, texts[:1], texts[50:51], []):
        got = [[] for _ in part]
        for t, *r in runs_of(part):
            got[t].append(tuple(r))
        assert got == [brute_runs(w) for w in part]
    assert sum(map(len, got)) == 0 and sum(len(brute_runs(w)) for w in texts) > 500


def test_suffixes_and_prefixes():
    rng = random.Random(2)
    texts = [some_words(rng) for _ in range(60)]
    first = np.cumsum([0, *map(len, texts)])
    ids = np.concatenate([[int(a) + t.index(x) for x in t] for a, t in zip(first, texts, strict=False)]).astype(np.int64)
    end = np.repeat(first[1:], np.diff(first))
    order = suffix_order(ids, end)
    rows = [tuple(ids[k : end[k]]) for k in range(len(ids))]
    assert [rows[k] for k in order] == sorted(rows)
    shared = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    expected = [0] + [shared(rows[a], rows[b]) for a, b in zip(order, order[1:], strict=False)]
    assert neighbour_prefixes(ids, end, order).tolist() == expected
    assert common_prefixes(ids, order[:-1], order[1:]).tolist() == expected[1:]


def test_long_and_odd_texts(spark):
    long = ("word " * 60_000).strip()
    mixed = " ".join(f"w{k % 3000}" for k in range(30_000))
    rows = [(1, None, "p"), (2, "", "p"), (3, " \t\n ", "p"), (4, long, "p"), (5, mixed, None), (6, "a b c a", "p"), (4, long, "p"), (None, "x\ty " * 5, "p")]
    df = spark.createDataFrame(rows, "id long, text string, periodic string")
    got = find_runs(df).collect()
    assert [r.periodic.n_words for r in got] == [0, 0, 0, 60_000, 30_000, 3, 60_000, 10]
    assert [[tuple(x) for x in r.periodic.runs] for r in got] == [[], [], [], [(0, 60_000, 1)], [(0, 30_000, 3000)], [], [(0, 60_000, 1)], [(0, 10, 2)]]
    assert got[4].periodic.collapsed == " ".join(f"w{k}" for k in range(3000)) and got[7].periodic.collapsed == "x y" and got[0].periodic.collapsed == ""
    assert find_runs(df.limit(0)).count() == 0
    assert kept_words([b"a"] * 6 + [b"z"], [(0, 6, 1)]) == [b"a", b"z"]


# vector codes


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    for spread, n in ((3, 16), (40, 64), (1 << 27, 16), (1, 1)):
        entries, x = rng.integers(-spread, spread + 1, (n, 8)), rng.integers(-spread, spread + 1, (500, 8))
        x[:n] = entries[: len(x)]
        square = ((x[:, None] - entries) ** 2).sum(2)
        near = Nearest(entries)
        entry, least = near.find(x)
        assert (entry == square.argmin(1)).all() and (least == square.min(1)).all()
        assert len(near.find(x[:0])[0]) == 0
    centres = rng.integers(-10_000, 10_000, (64, 8))
    near = Nearest(centres)
    held = [bin(int(m)).count("1") for m in near.candidates(np.repeat(centres, 5, 0) + rng.integers(-20, 20, (320, 8)))]
    assert min(held) >= 1 and np.mean(held) < 3  # vectors near an entry: most others are outside of some dimension's range


def brute_codes(rows):
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // 8
    part = lambda v, p: v[p * size : (p + 1) * size]
    least = {}
    for i, v in kept:
        least[i] = min(v, least.get(i, v))
    books = [[part(least[i], p) for i in sorted(least)[:16]] for p in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((distance(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        own = [[near(v, p)[1] for p in range(8)] for _, v in kept]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [part(v, p) for (_, v), o in zip(kept, own, strict=True) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(8)), sum(near(v, p)[0] for p in range(8))) for i, v in kept]
    return sorted(coded), books


@pytest.mark.parametrize("n", [3, 70])
def test_codes_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(16)]) for i in range(n)]
    rows += [rows[0], rows[1], rows[1], (1, [0.5] * 16), (900, None), (901, [1.0] * 15 + [None]), (902, [math.nan] * 16), (903, [math.inf] * 16), (904, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string")
    got, books = compress_vectors(df)
    expected, own = brute_codes(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == expected
    assert books.tolist() == own


def test_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, "a"), (2, [2.0] * 8, None), (3, [3.0] * 16, None), (None, [1e30] * 8, "a")], "vec_id long, embedding array<double>, label string")
    got, books = compress_vectors(df)
    rows = {r.vec_id: r for r in sum_over(got, "label", "error", "label_error").collect()}
    assert set(rows) == {1, 2, None} and books.shape == (8, 2, 1) and all(r.error >= 0 for r in rows.values())
    assert rows[1].label_error == rows[1].error + rows[None].error and rows[2].label_error == rows[2].error
    for empty in (df.limit(0), df.filter("vec_id is null")):
        out, books = compress_vectors(empty)
        assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error"] and not books.shape[1]


# licence scans


def brute_licences(text, templates):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    w = [x.decode() for x in w]
    out = []
    for k, t in enumerate(templates):
        for at in range(len(w) - len(t.words) + 1):
            same = [a == b for a, b in zip(w[at:], t.words, strict=False)]
            if sum(same) >= t.need and all(s for s, m in zip(same, t.must, strict=True) if m):
                out.append((k, at, sum(same)))
    return len(w), sorted(out)


def licence_texts():
    rng = random.Random(13)
    out = [None, "", "-- ", "mit", "MIT license", "cc-by CC BY-NC cc by", "Apache License, Version 2.0; apache license"]
    names = [w for t in TEMPLATES for w in t.words]
    for _ in range(150):
        t = rng.choice(TEMPLATES)
        words = [rng.choice([*names, "x", "été"]) for _ in range(rng.randint(0, 30))] + [w.upper() if rng.random() < 0.1 else w for w in t.words]
        for _ in range(rng.randint(0, len(t.words) // 3)):
            words[-rng.randint(1, len(t.words))] = rng.choice(["x", "license", "the"])
        out.append(rng.choice([" ", ", ", "\n# "]).join(words + [rng.choice(names) for _ in range(rng.randint(0, 30))]))
    return out


def test_licences_against_brute_force(spark):
    texts = licence_texts()
    expected = [brute_licences(t, TEMPLATES) for t in texts]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r.doc_id: r.licenses for r in scan_licenses(df).collect()}
    assert [(got[k].n_words, sorted((m.template, m.first_word, m.matched) for m in got[k].matches)) for k in range(len(texts))] == expected
    assert sum(len(m) for _, m in expected) > 100
    for k, t in enumerate(texts):
        for m in got[k].matches:
            cut = t.encode()[m.begin : m.end].decode().lower()
            assert cut.startswith(TEMPLATES[m.template].words[0]) or m.matched < m.n_words
    assert scan_licenses(df.limit(0)).count() == 0
    counts = word_counts(df)
    assert counts["mit"] == sum("mit" in re.findall(r"[a-z0-9é]+", (t or "").lower()) for t in texts)


def test_anchors_are_the_rarest_words():
    index = Index([Template("l", "the rare word of the license", base=True)], {"the": 900, "of": 800, "word": 30, "license": 40, "rare": 2})
    anchors = [index.words.names[k] for k in range(len(index.words.names)) if index.start[k + 1] > index.start[k]]
    assert sorted(anchors) == ["rare", "word"]
    numbers = index.words.of(np.zeros(3, np.uint64))
    assert (numbers == -1).all() and not len(index.find(numbers, np.array([0, 3]))[0])


def test_long_text_and_repeats(spark):
    text = "filler " * 50_000 + "Released under the MIT License. " * 3
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    for r in scan_licenses(df).collect():
        assert [m.first_word for m in r.licenses.matches] == [50_003, 50_008, 50_013] and r.licenses.n_words == 50_015
