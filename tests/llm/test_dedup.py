"""Near-dedup and substring dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm.arrays import Powers, span_hashes
from lexmill.llm.components import components
from lexmill.llm.near_dedup import near_duplicates, op5_near_dedup
from lexmill.llm.sketches import minhash
from lexmill.llm.substring_dedup import op1_substring_dedup, remove_repeats

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near(df):
    return {r.doc: (r.n_shingles, r.component) for r in near_duplicates(df).collect()}


def test_near_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_near_dedup(spark, small).collect()}
    assert got == brute_components(rows)


def test_near_hot_group(spark, docs, monkeypatch):
    """Many edited copies of one text: links are hub-like, and blocks must find what best pairs leave."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(i, rows[i % 260][1]) for i in range(300, 400)]
    want = brute_components(rows)
    assert near(docs(rows)) == want
    import lexmill.llm.near_dedup as d

    monkeypatch.setattr(d, "REGION", 16)
    monkeypatch.setattr(d, "BLOCK", 8)
    monkeypatch.setattr(d, "BROADCAST_IDS", 0)
    assert near(docs(rows)) == want


def test_near_crowded_region(spark, docs, monkeypatch):
    """Thousands of texts share a passage of 60 %, below the similarity; pairs planted among them are linked."""
    import lexmill.llm.near_dedup as d

    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}x{k}" for k in range(40)])) for i in range(4000)]
    for i in range(100):
        own = rows[20 * i][1].split()
        at = 62 + rng.randrange(20)
        rows.append((10_000 + i, " ".join(own[:at] + [f"e{i}x{k}" for k in range(8)] + own[at + 8 :])))
    for i in range(100):
        a, b = shingles(rows[20 * i][1]), shingles(rows[4000 + i][1])
        assert 0.75 <= len(a & b) / len(a | b) < 0.8
    monkeypatch.setattr(d, "REGION", 1000)
    got = near(docs(rows))
    linked = [i for i in range(100) if got[10_000 + i][1] == got[20 * i][1]]
    assert len(linked) >= 95 and all(got[i][1] == i for i in range(4000))


def test_near_templates_form_no_pairs(spark, docs, monkeypatch):
    """Texts of one template at similarity 0.70 agree by their sketches; exact pairs among them stay in proportion to the texts."""
    import lexmill.llm.near_dedup as d

    template = [f"p{k}" for k in range(415)]
    make = lambda n: docs([(i, " ".join([f"u{i}x{k}" for k in range(42)] + template + [f"v{i}x{k}" for k in range(42)])) for i in range(n)])
    a, b = (shingles(r.text) for r in make(2).collect())
    assert 0.69 < len(a & b) / len(a | b) < 0.71
    whole, formed = d.posting_pairs, []

    def counted(posted):
        with_pairs = d._with_pairs(posted).count()
        formed.append((with_pairs, posted.count() / (1500 * 495)))
        return whole(posted)

    monkeypatch.setattr(d, "posting_pairs", counted)
    got = near(make(1500))
    assert all(c == i for i, (_, c) in got.items())
    assert len(formed) == 1 and formed[0][0] == 0 and formed[0][1] < 1


def test_near_crowd_links_what_places_leave_out(spark, docs, monkeypatch):
    """Without any place for neighbours, the crowd alone finds the links between classes of crowded regions."""
    import lexmill.llm.near_dedup as d

    rng = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}x{k}" for k in range(40)])) for i in range(300)]
    for i in range(60):
        own = rows[5 * i][1].split()
        at = 62 + rng.randrange(20)
        rows.append((1000 + i, " ".join(own[:at] + [f"e{i}x{k}" for k in range(8)] + own[at + 8 :])))
    want = brute_components(rows)
    for share, block in ((0.25, 1024), (2.0, 3)):  # hubs first; or blocks at once
        monkeypatch.setattr(d, "HUB_SHARE", share)
        monkeypatch.setattr(d, "BLOCK", block)
        classes = []
        candidates = d.candidates
        with monkeypatch.context() as m:
            m.setattr(d, "candidates", lambda c, f=candidates: classes.append(c) or (f(c)[0].limit(0), c.select("rep")))
            assert near(docs(rows)) == want


def test_near_id_with_several_texts(spark, docs):
    """An id's texts are links, whatever the order of rows."""
    x, y = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, x), (1, y), (2, x + " z"), (3, y + " z"), (4, " ".join(f"c{k}" for k in range(50)))]
    for order in (rows, rows[::-1]):
        assert {k: c for k, (_, c) in near(docs(order)).items()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_long_text(spark, docs):
    text = " ".join(f"w{k % 9973}x{k // 7}" for k in range(200_000))
    got = near(docs([(1, text), (2, text + " more"), (3, text[: len(text) // 2]), (4, "short")]))
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_candidates_of_equal_keys_in_a_crowded_region(spark):
    """All classes of a region of 4,000 agree on the first half of every key; pairs that agree on the second meet."""
    import lexmill.llm.near_dedup as d

    rng = random.Random(4)
    marks = [bytearray(rng.randbytes(192)) for _ in range(2000)]
    rows = [(k, 50, marks[k // 2], [t for t in range(24)], [k // 2 * 31 + t for t in range(24)]) for k in range(4000)]
    classes = spark.createDataFrame(rows, "rep long, n long, marks binary, high array<long>, low array<long>")
    got = {(r.a, r.b) for r in d.candidates(classes)[0].collect()}
    assert got == {(k, k + 1) for k in range(0, 4000, 2)}


def test_neighbours_across_borders(spark):
    """In however many ranges the order is cut, the candidates are the same."""
    import lexmill.llm.near_dedup as d

    rows = [(k, 1, k // 700, k % 50, k % 7) for k in range(2000)]
    rows = sorted(rows, key=lambda r: (*r[1:], r[0]))
    want = {(x[0], y[0]) for n in (1, 2) for x, y in zip(rows[n:], rows, strict=False) if x[1:3] == y[1:3]}

    def pairs(cuts):
        out, edge = [], []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a:b], strict=True)], d._EDGES)] if b > a else []
            for batch in d._neighbours(iter(part)):
                for r in batch.to_pylist():
                    (edge if r["p"] is None else out).append(r)
        edge = sorted(edge, key=lambda r: (r["tree"], r["high"], r["low"], r["tie"], r["rep"]))
        assert len({r["rep"] for r in edge}) == len(edge)
        across = {(x["rep"], y["rep"]) for n in (1, 2) for x, y in zip(edge[n:], edge, strict=False) if x["high"] == y["high"]}
        return {(r["rep"], r["p"]) for r in out} | across

    for cuts in ([], [1000], [1, 2, 3, 500, 500, 503, 1999], list(range(0, 2000, 10))):
        assert pairs(cuts) >= want


def test_near_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "A b"), (5, "a  B"), (6, "one two three four five"), (7, "ONE two three four five"), (8, "x " * 40_000), (9, "x " * 50_000)]
    got = near(docs(rows))
    assert got == brute_components(rows)
    assert got[1] == (0, 1) and got[5] == (1, 4) and got[9] == (1, 8)
    assert near(docs([])) == {}


def test_near_repeated_rows_and_null_ids(spark, docs):
    text = " ".join(map(str, range(50)))
    got = [tuple(r) for r in near_duplicates(docs([(5, text), (5, text), (None, text), (9, text)])).collect()]
    assert sorted(got, key=str) == sorted([(5, 46, 5), (5, 46, 5), (None, 46, None), (9, 46, 5)], key=str)


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(400)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.v: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(401)} | {1000: 1000, 1001: 1000}


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = minhash(x[:3500]), minhash(x[500:])
    assert abs((a == b).mean() - 3000 / 4000) < 0.1


POWERS = Powers()
STOPS = [c.encode() for c in ".!?؟۔।॥…。｡．！？"]


def pieces(text):
    """Words as byte places, their lower case, and the sentences as lists of word numbers, by plain loops."""
    text = text or ""
    words, at, open_ = [], 0, False
    for c in text:
        n = len(c.encode())
        if c in " \t\n\v\f\r":
            open_ = False
        elif n >= 3 or not open_:
            words.append([at, at + n])
            open_ = n < 3
        else:
            words[-1][1] = at + n
        at += n
    b = text.encode()
    low = [b[x:y].translate(LOWER) for x, y in words]
    whole, now = [], []
    for k, (x, y) in enumerate(words):
        now.append(k)
        line = k + 1 < len(words) and b"\n" in b[y : words[k + 1][0]]
        if any(b[x:y].endswith(c) for c in STOPS) or line or k == len(words) - 1:
            whole.append(now)
            now = []
    out = []
    for sentence in whole:
        cuts = set()
        if len(sentence) > 16:
            ends = np.array([len(low[k]) for k in sentence]).cumsum()
            h = span_hashes(np.frombuffer(b"".join(low[k] for k in sentence), np.uint8), ends - [len(low[k]) for k in sentence], ends, POWERS, True).tolist()
            cuts = {min(range(k, k + 12), key=lambda i: (h[i], i)) for k in range(1, len(h) - 11)}
        edges = [0, *sorted(cuts), len(sentence)]
        out += [sentence[x:y] for x, y in zip(edges, edges[1:], strict=False)]
    return b, words, low, out


def brute_repeats(rows):
    held, runs, first = {}, {}, {}
    for d, t in rows:
        b, words, low, ps = pieces(t)
        held[d] = b, words, ps
        found = set()
        for i in range(len(ps)):
            end = next((j for j in range(i + 2, len(ps) + 1) if ps[j - 1][-1] - ps[i][0] + 1 >= 13), None)
            begin = next((k for k in range(i - 1, -1, -1) if ps[i][-1] - ps[k][0] + 1 >= 13), None)
            found |= {(i, end)} if end is not None else set()
            found |= {(begin, i + 1)} if begin is not None else set()
        runs[d] = [(tuple(low[ps[i][0] : ps[j - 1][-1] + 1]), i, j) for i, j in sorted(found)]
    for d in sorted(runs):
        for h, i, _ in runs[d]:
            first.setdefault(h, (d, i))
    out = {}
    for d in runs:
        b, words, ps = held[d]
        gone = {k for h, i, j in runs[d] if first[h] != (d, i) for k in range(i, j)}
        edges = [0] + [words[p[0]][0] for p in ps[1:]] + [len(b)]
        text = b"".join(b[edges[k] : edges[k + 1]] for k in range(len(ps)) if k not in gone) if ps else b
        out[d] = (text.decode(), len(ps), len(gone))
    return out


def test_repeats_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in op1_substring_dedup(spark, small).collect()}
    assert got == brute_repeats(rows)


def test_repeats_edge_cases(spark, docs):
    passage = "One two three four five six seven eight. Nine ten eleven twelve thirteen.\nFourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one. And more of it."
    rows = [(1, f"First here. {passage} End one."), (2, f"Second there. {passage.upper()} End two."), (3, None), (4, ""), (5, "ñandú " * 60_000), (6, passage + " " + passage)]
    rows += [(7, "A single sentence stays."), (8, "A single sentence stays."), (9, "Nine words are in this sentence, as you see. And nine words are in this one as well."), (10, "NINE words are in this sentence, as you see. and nine words are in this one as well."), (11, " \n "), (12, "…。"), (13, "😀 😀"), (14, "مرحبا بك؟ نعم۔ " * 5), (15, "مرحبا بك؟ نعم۔ " * 5), (16, "Yes. No."), (17, "Yes. No.")]
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in remove_repeats(docs(rows)).collect()}
    want = brute_repeats(rows)
    want[3] = (None, 0, 0)
    assert got == want
    assert got[8] == ("A single sentence stays.", 1, 0) and got[10] == ("", 2, 2) and got[17] == ("Yes. No.", 2, 0) and got[15] == ("", 10, 10)
    assert got[2][0].startswith("Second there.") and got[2][0].endswith("End two.") and got[1][2] == 0
    assert remove_repeats(docs([])).count() == 0
    assert {"_hash", "doc", "n"} <= set(remove_repeats(docs(rows)).columns)


def test_passages_of_over_fifty_words_are_found(spark, docs):
    """With stops or without, at any place of a sentence, and in scripts without spaces."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], []
    for k in range(300):
        passage = [word() for _ in range(51)]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            passage[rng.randrange(51)] += rng.choice([".", "!", "?"])
        if k % 10 == 0:
            passage = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(51))]
        glue = "" if k % 10 == 0 else " "
        for d in range(2):
            before, after = ([word() for _ in range(rng.randrange(40))] for _ in range(2))
            rows.append((2 * k + d, " ".join(before) + glue + " ".join(passage) + glue + " ".join(after)))
        want.append(2 * k + 1)
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in remove_repeats(docs(rows)).collect()}
    assert got == brute_repeats(rows)
    assert {k for k, (_, _, n) in got.items() if n} == set(want)


def test_repeated_rows_give_each_mark_once(spark, docs):
    """Copies of one (id, text) row share their marks; these don't grow with the copies."""
    from lexmill.llm.substring_dedup import repeated_runs

    text = " ".join(f"Word{k} more text here now." for k in range(8))
    rows = docs([(1, text)] + [(2, text)] * 30)
    assert repeated_runs(rows).distinct().count() == 6
    assert sorted(r.n_removed for r in remove_repeats(rows).collect()) == [0] + [8] * 30
    assert repeated_runs(docs([])).count() == 0


def test_repeats_spans_and_ids(spark, docs):
    passage = " ".join(f"Word{k} more text here now." for k in range(8))
    rows = [(1, passage), (1, passage), (2, "Own begin. " + passage), (None, passage)]
    got = [(r.doc_id, r.n_removed, r.text, [(s.first_byte, s.end_byte) for s in r.removed]) for r in remove_repeats(docs(rows)).collect()]
    assert sorted(g[:2] for g in got if g[0]) == [(1, 0), (1, 0), (2, 8)]
    two = next(g for g in got if g[0] == 2)
    assert two[2] == "Own begin. " and two[3] == [(11, 11 + len(passage))]
    assert next(g for g in got if g[0] is None)[2] == passage


@pytest.mark.parametrize("chunk", [1, 3])
def test_sketches_do_not_depend_on_batches(chunk):
    from lexmill.llm.sketches import sketch_batch

    texts = ["a b c d e f g", None, "x", "h i j k l m n o p", "Ñ é", ""]
    whole = sketch_batch(pa.array(texts), Powers()).to_pylist()
    parts = [row for k in range(0, len(texts), chunk) for row in sketch_batch(pa.array(texts[k : k + chunk], pa.string()), Powers()).to_pylist()]
    assert whole == parts
