"""Language ID and quality on held-out rows; mixing, sharding and token counts against other implementations."""

import math
import zlib
from collections import Counter
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm.language_id import LENGTH, Predictor, identify_language, log_softmax, op7_language_id, train, windows_of
from lexmill.llm.poisson_mix import mix_sources, op10_poisson_mix, poisson_count
from lexmill.llm.quality import op2_quality, score_quality, train_quality
from lexmill.llm.sharding import jump, op4_sharding, shard
from lexmill.llm.token_count import BpeArrays, count_tokens, model_path, op9_token_counts
from lexmill.llm.token_count import Counter as Tokens


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_held_out(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op7_language_id(spark, small).collect()
    assert len(got) == len(truth) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_no_language(spark, small, docs):
    """Keys, dumps and shuffled letters are rejected at the pipeline's bound; held-out documents with a language aren't."""
    import base64
    import random

    from lexmill.llm.language_id import NO_LANGUAGE

    rng = random.Random(9)
    table = spark.read.parquet(f"{small}/documents.parquet")
    real = [r.text for r in table.filter("lang is not null").limit(40).collect() if len(r.text) > 200]
    junk = [base64.b64encode(rng.randbytes(900)).decode() for _ in range(20)] + [rng.randbytes(400).hex() for _ in range(20)]
    junk += ["".join(rng.sample(t, len(t))) for t in real[:20]] + ["".join(rng.choice("asdfghjklqwertyuiop ") for _ in range(500)) for _ in range(20)]
    got = identify_language(docs(list(enumerate(junk))), table.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    assert got.filter(F.col("no_language") >= NO_LANGUAGE).count() >= 0.9 * len(junk)
    held = op7_language_id(spark, small).filter("held_out").join(table.filter("lang is not null"), "doc_id")
    assert held.filter(F.col("no_language") >= NO_LANGUAGE).count() <= 0.01 * held.count()


def test_language_edge_cases(spark, docs):
    training = docs([(k, "the and of them " * 5) for k in range(30)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    training = training.withColumn("text", F.when(F.col("lang") == "fr", "que le la été ").otherwise(F.col("text")))
    rows = docs([(1, None), (2, ""), (3, "123 -- 4"), (4, "the them of and " * 20_000), (5, "été que la")]).withColumn("_found", F.lit(7))
    got = {r.doc_id: r for r in identify_language(rows, training).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert (got[4].lang_pred, got[5].lang_pred, got[5]["_found"]) == ("en", "fr", 7)
    assert {r.lang_pred for r in identify_language(rows, training.limit(0)).collect()} == {"und"}
    assert identify_language(rows.limit(0), training).count() == 0


def test_folded_network_is_the_same():
    net = train(["the them " * 40, "que la été " * 40], ["en", "fr"])
    rows, _ = windows_of(np.frombuffer(("the été " * 64).encode(), np.uint8)[: 3 * LENGTH], np.array([0, LENGTH, 3 * LENGTH]))
    pooled = []
    e = net.embedding[rows]
    for w in net.filters:
        m = LENGTH - len(w) + 1
        pooled.append(sum(e[:, k : k + m] @ w[k] for k in range(len(w))).max(1))
    plain = log_softmax(np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(Predictor(net).log_probabilities(rows), plain, atol=1e-3)


def test_gradients():
    """Of the weighted cross-entropy, by differences, for every parameter array."""
    from lexmill.llm import language_id as m

    rng = np.random.default_rng(3)
    total = m.FILTERS * len(m.WIDTHS)
    params = [rng.normal(0, 0.5, (256, m.EMBEDDING))] + [rng.normal(0, 0.4, (w, m.EMBEDDING, m.FILTERS)) for w in m.WIDTHS]
    params += [rng.normal(0, 0.1, total), rng.normal(0, 0.3, (total, 3)), rng.normal(0, 0.1, 3)]
    rows, y, weight = rng.integers(0, 40, (6, LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1]), rng.random(6) + 0.5

    def loss():
        e, pooled = params[0][rows], []
        for w in params[1:-3]:
            n = LENGTH - len(w) + 1
            pooled.append(sum(e[:, k : k + n] @ w[k] for k in range(len(w))).max(1))
        hidden = np.maximum(np.concatenate(pooled, 1) + params[-3], 0)
        return -(weight * log_softmax(hidden @ params[-2] + params[-1])[np.arange(6), y]).sum() / 6

    for p, g in zip(params, m._gradients(params, rows, y, weight), strict=True):
        assert p.shape == g.shape
        places = np.argsort(-np.abs(g).ravel())[:6].tolist() + rng.integers(0, g.size, 6).tolist()
        for k in places:
            at, step = np.unravel_index(k, p.shape), 1e-6
            old = p[at]
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_samples_are_bounded(spark, docs):
    """One text in half of the rows, and one row many times: no class gives more rows than asked for, and whole texts come."""
    from lexmill.llm.language_id import sample_labelled
    from lexmill.llm.samples import sample_rows

    long = "end " * 5000
    rows = docs([(k, "same" if k % 2 else f"{k} {long}") for k in range(3000)] + [(7, "again")] * 500)
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    texts, langs = sample_labelled(rows, per_language=50)
    assert set(langs) == {"a", "b"} and 30 <= langs.count("a") <= 50 and 30 <= langs.count("b") <= 50
    assert sum(t != "same" and t != "again" for t in texts) > 20 and all(t.endswith(long) for t in texts if len(t) > 5)
    assert len(sample_labelled(rows, per_language=50, most=60)[0]) <= 60
    many = docs([(k, "t") for k in range(300)]).withColumn("lang", F.col("doc_id").cast("string"))
    assert sample_rows(many, "lang", ["doc_id", "text"], 5, 40).count() == 40
    long = spark.createDataFrame([(i, "xy"[i % 2], "a" * 100) for i in range(20)], "doc_id long, lang string, text string")
    assert [r["rank"] for r in sample_rows(long, "lang", ["doc_id", "text"], 5, 40, most_bytes=650).collect()] == [1, 1, 2, 2, 3, 3]
    assert sample_rows(long, "lang", ["doc_id", "text"], 5, 40, most_bytes=150).count() == 0
    assert sample_rows(long.limit(0), "lang", ["doc_id", "text"], 5, 40).count() == 0
    assert sample_labelled(rows.limit(0)) == ([], [])


def test_windows_cover_every_byte():
    data = np.arange(300) % 251 + 1
    rows, text = windows_of(data.astype(np.uint8), np.array([0, 0, 10, 300]))
    assert text.tolist() == [0, 1, 2, 2, 2]
    assert rows[1].tolist()[:11] == [*range(1, 11), 0] and not rows[0].any()
    assert set(data[10:].tolist()) <= set(rows[2:].ravel().tolist())


def test_quality_held_out(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op2_quality(spark, small).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == out(r.doc_id) for r in got.values())
    held = [(got[i], y) for i, y in labels.items() if out(i)]
    assert np.mean([r.predicted == y for r, y in held]) > 0.9


def grams(text):
    """Every n-gram of a text, by plain loops; numbers come from the module's own hash of one n-gram alone."""
    import itertools

    b = (text or "").encode()
    w = b.decode().lower().split()
    found = {b[k : k + n] for n in (2, 3) for k in range(len(b) - n + 1)} | {tuple(w[k : k + n]) for n in (1, 2) for k in range(len(w) - n + 1)}
    for n in (2, 3, 4):
        found |= {("=", *[w[k + i] == w[k + j] for i, j in itertools.combinations(range(n), 2)]) for k in range(len(w) - n + 1)}
    return found


def test_ngrams_and_ratios_against_brute_force(spark, docs):
    from lexmill.llm.quality import DIMENSIONS, class_counts, ngrams

    texts = ["a b a b", "xx xx xx xx", "", None, "the cat sat on the mat", "cat cat dog dog", "Ñandú"]
    rows = {}
    for a, _, text, gram in ngrams(pa.array(texts)):
        for t, g in zip(text.tolist(), gram.tolist(), strict=True):
            rows.setdefault(a + t, set()).add(g)
    for k, t in enumerate(texts):
        assert len(rows.get(k, ())) == len(grams(t))
    for i in range(len(texts)):
        for j in range(i):
            assert len(rows.get(i, set()) & rows.get(j, set())) == len(grams(texts[i]) & grams(texts[j]))
    labels = [k % 2 for k in range(len(texts))]
    table = spark.createDataFrame([(t or "", y) for t, y in zip(texts, labels, strict=True)] * 3, "text string, y int")
    n0, n1 = class_counts(table, "text", "y")
    for y, n in ((0, n0), (1, n1)):
        assert n[-1] == 3 * labels.count(y)
        want = Counter(g for k in rows if labels[k] == y for g in rows[k])
        assert {g: c for g, c in enumerate(n[:-1].tolist()) if c} == {g: 3 * c for g, c in want.items()} and len(n) == DIMENSIONS + 1


def test_dual_coordinate_descent_is_optimal():
    """The primal value comes down to the dual one, as it does at the optimum alone."""
    from lexmill.llm.quality import descend

    rng = np.random.default_rng(5)
    n, cost = 60, 0.7
    rows = [np.sort(rng.choice(30, rng.integers(2, 9), replace=False)) for _ in range(n)]
    first, ratio, y = np.cumsum([0] + [len(r) for r in rows]), rng.normal(0, 1, 30), np.where(rng.random(n) < 0.5, 1.0, -1.0)
    w, bias, dual = descend(first, np.concatenate(rows), ratio, y, cost, 3000)
    x = np.zeros((n, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / max(1.0, np.sqrt((ratio[r] ** 2).sum()))
        x[i, 30] = 1
    full = np.append(w, bias)
    assert np.allclose(full, x.T @ (dual * y)) and dual.min() >= 0 and dual.max() <= cost
    primal = 0.5 * full @ full + cost * np.maximum(0, 1 - y * (x @ full)).sum()
    assert -1e-9 < primal - (dual.sum() - 0.5 * full @ full) < 1e-4 * primal


def test_quality_edge_cases(spark, docs):
    rows = [(k, "good words in a clean line") for k in range(0, 40, 2)] + [(k, "### bad %%% bad !!!") for k in range(1, 40, 2)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)] + [(3, None), (999, 1)], "doc_id long, quality int")
    model = train_quality(docs(rows), labels)
    got = {r.doc_id: r.score for r in score_quality(docs([(1, None), (2, ""), (3, "good clean words"), (4, "### %%% bad " * 20_000)]), model).collect()}
    assert got[1] == got[2] and 0 <= got[1] <= 1 and got[3] > 0.5 > got[4]
    assert train_quality(docs(rows), labels.filter("quality = 1")) == 1.0
    assert train_quality(docs(rows), labels.limit(0)) == 0.5
    assert score_quality(docs([]), model).count() == 0


def test_quality_by_shuffle_is_the_same(spark, docs, monkeypatch):
    import lexmill.llm.quality as q

    rows = docs([(k, f"good words {k}") for k in range(0, 40, 2)] + [(k, f"### {k} %%%") for k in range(1, 40, 2)])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    a = train_quality(rows, labels)
    monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
    b = train_quality(rows, labels)
    assert np.allclose(a.weights, b.weights) and (a.bias, a.slope) == (b.bias, b.slope)


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 40, 41, 1000):
        own, grown = jump(keys, n)
        assert own.tolist() == [plain_jump(int(k), n) for k in keys]
        assert grown.tolist() == [plain_jump(int(k), n + 1) for k in keys]
    own, grown = jump(keys, 40)
    assert set(grown[own != grown]) == {40} and 0.01 < (own != grown).mean() < 0.05


def test_sharding(spark, small):
    got = op4_sharding(spark, small).collect()
    slots = Counter((r.shard, r.slot) for r in got)
    sizes = Counter(r.shard for r in got)
    assert max(slots.values()) == 1 and all((s, k) in slots for s in sizes for k in range(sizes[s]))
    assert all(r.grown_shard in (r.shard, 40) for r in got)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)


def test_sharding_edge_cases(spark, docs):
    rows = docs([(1, None), (1, None), (None, "a"), (None, "b"), (2, "")]).withColumn("shard", F.lit("old"))
    got = shard(rows, 3).collect()
    assert len(got) == 5 and {r["_hash"] for r in got} == {"x"}
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 == len({r.shard for r in got if r.doc_id is None})
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shard(docs([]), 3).count() == 0
    with pytest.raises(ValueError):
        shard(rows, 0)


def test_sharding_slots_of_a_hot_key(spark, docs, monkeypatch):
    """A third of the rows has one key: they fill many ranges, and slots don't depend on the layout."""
    import lexmill.llm.sharding as m

    monkeypatch.setattr(m, "RANGE_ROWS", 10)
    rows = docs([(5, f"t{k}") for k in range(200)] + [(k, "x") for k in range(1000, 1400)] + [(None, f"n{k}") for k in range(50)])
    a = shard(rows, 4)
    got = sorted(((r.doc_id, r.text, r.shard, r.slot, r.grown_shard) for r in a.collect()), key=str)
    for other in (rows.repartition(7), rows.orderBy("text").coalesce(1)):
        assert sorted(((r.doc_id, r.text, r.shard, r.slot, r.grown_shard) for r in shard(other, 4).collect()), key=str) == got
    for s in range(4):
        assert sorted(x[3] for x in got if x[2] == s) == list(range(sum(x[2] == s for x in got)))
    hot = [x[3] for x in got if x[0] == 5]
    assert len({x[2] for x in got if x[0] == 5}) == 1 and max(hot) - min(hot) > 205


def test_sharding_of_many_copies(spark, docs, monkeypatch):
    """Rows equal in all columns fill a range: slots stay gapless, and the same whatever the layout."""
    import lexmill.llm.sharding as m

    monkeypatch.setattr(m, "RANGE_ROWS", 10)
    rows = docs([(5, "t")] * 333 + [(None, None)] * 95 + [(k, "x") for k in range(100)] + [(7, "u")] * 3)
    got = sorted(((r.doc_id, r.text, r.shard, r.slot, r.grown_shard) for r in shard(rows, 4).collect()), key=str)
    assert sorted(((r.doc_id, r.text, r.shard, r.slot, r.grown_shard) for r in shard(rows.repartition(5), 4).collect()), key=str) == got
    for s in range(4):
        assert sorted(x[3] for x in got if x[2] == s) == list(range(sum(x[2] == s for x in got)))
    assert sum(x[0] == 5 for x in got) == 334 and sum(x[0] is None for x in got) == 95
    mapped = shard(rows.withColumn("m", F.create_map(F.lit("k"), "doc_id")), 4)
    assert mapped.count() == len(got) and mapped.select("shard", "slot").distinct().count() == len(got)


def poisson(u, rate):
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_mix_counts(spark, docs):
    import hashlib

    rows = docs([(k, "t") for k in range(900)] + [(None, None)]).withColumn("source", F.when(F.col("doc_id") < 600, "a").when(F.col("doc_id") < 800, "b")).withColumn("_n", F.lit(1))
    got = Counter(r.doc_id for r in mix_sources(rows, temperature=0.0).collect())
    n = {"a": 600, "b": 200, None: 101}
    for k in range(900):
        s = "a" if k < 600 else "b" if k < 800 else None
        u = int(hashlib.md5(f"mix|{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert got[k] == poisson(u, 901 / 3 / n[s])
    totals = [sum(v for k, v in got.items() if k is not None and lo <= k < hi) for lo, hi in ((0, 600), (600, 800))]
    assert all(abs(t - 300) < 80 for t in totals)


def exact_poisson(u, rate):
    with localcontext() as c:
        c.prec = 60
        k, term, rate = 0, (-Decimal(rate)).exp(), Decimal(rate)
        total = term
        while total <= Decimal(u):
            k += 1
            term *= rate / k
            total += term
        return k


def test_poisson_large_rates(spark):
    ends = [1 / (1 << 52), 1e-12, 1e-5, 0.5, 1 - 1e-9]
    us = ends + [k / 37 for k in range(1, 37)]
    rates = [0.5, 30.0, 499.5, 500.5, 700.0, 708.5, 745.0, 800.0, 5000.0]
    rows = spark.createDataFrame([(u, r) for u in us for r in rates], "u double, rate double")
    for r in rows.withColumn("n", poisson_count(F.col("u"), F.col("rate"))).collect():
        assert r.n == exact_poisson(r.u, r.rate), r


def test_mix_one_document_source(spark, docs):
    import hashlib

    rows = docs([(k, "t") for k in range(1600)]).withColumn("source", F.when(F.col("doc_id") == 7, "rare").otherwise("large"))
    got = Counter(r.doc_id for r in mix_sources(rows, temperature=0.0).collect())
    u = {k: int(hashlib.md5(f"mix|{k}".encode()).hexdigest()[:13], 16) / (1 << 52) for k in range(1600)}
    assert got[7] == exact_poisson(u[7], 800.0)
    assert all(got[k] == poisson(u[k], 800 / 1599) for k in u if k != 7)


def test_mix_sql_at_large_rates(spark, docs, tmp_path):
    """A source of one document beside one of 60,000 has rate 245: counts beyond 200, in Spark as in SQL."""
    import duckdb

    from lexmill.llm.poisson_mix import OP10_SQL

    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 7, "rare").otherwise("large").alias("source"), F.lit(1).alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, copy, order_key FROM ({OP10_SQL})").fetchall())
    got = [(r.doc_id, r.copy, r.order_key) for r in op10_poisson_mix(spark, str(tmp_path)).select("doc_id", "copy", "order_key").collect()]
    assert sorted(got) == want and sum(d == 7 for d, _, _ in want) > 200
    assert [k for _, _, k in got] == sorted(k for _, _, k in got)


def test_mix_edge_cases(spark, docs):
    rows = docs([(1, None), (1, None), (2, "x")])
    a = [tuple(r) for r in mix_sources(rows).collect()]
    b = [tuple(r) for r in mix_sources(rows.repartition(3)).collect()]
    assert sorted(a, key=str) == sorted(b, key=str)
    assert mix_sources(docs([])).count() == 0
    assert mix_sources(rows, weights={"other": 1.0}).count() == 0
    assert mix_sources(rows, weights={}).count() == 0
    many = docs([(k, "x") for k in range(2)]).withColumn("source", F.col("doc_id").cast("string"))
    assert mix_sources(many, weights={"0": 1.0, "1": 0.0}).select("doc_id").distinct().count() <= 1


def test_mix_order_is_global(spark, small):
    keys = [r.order_key for r in op10_poisson_mix(spark, small).select("order_key").collect()]
    assert keys == sorted(keys)


def test_tokens_whole_table(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op9_token_counts(spark, small).collect():
        assert r.n_tokens == len(sp.encode(text[r.doc_id] or "")) and r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096)


ODD = [None, "", " ", "   ", "\n", "a  b", "<s> </s> <unk>", "▁ ▁a", "ﬁ①​", "a\0b", "x" * 3000, "ab" * 2000, " " * 700, "日本語 テキスト " * 300, "é́\r\nx", "😀😀 執벨"]


def test_tokens_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert Tokens(BpeArrays(model_path())).batch(pa.array(ODD, pa.string())).tolist() == [len(sp.encode(x or "")) for x in ODD]


def test_tokens_long_pre_tokens():
    """Long texts without a space: few letters, pieces of the model strung together, base64, and a long run of one letter."""
    import base64
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(3)
    pieces = [sp.id_to_piece(i).replace("▁", "") for i in range(300, 12_000)]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aeinst", "etaoinshrdlucmfwypvbgk", "01", "-=") for n in (2, 7, 50, 600, 5000)]
    texts += ["".join(rng.choice(pieces) for _ in range(n)) for n in (3, 20, 400, 3000)] * 3
    texts += [base64.b64encode(rng.randbytes(30_000)).decode(), "a" * 50_000, "ha" * 20_000, "".join(rng.choice("的一是不了人") for _ in range(3000))]
    assert Tokens(BpeArrays(model_path())).batch(pa.array(texts, pa.string())).tolist() == [len(sp.encode(x)) for x in texts]


def test_tokens_keep_other_columns(spark, docs):
    got = count_tokens(docs([(1, None), (1, None), (2, "a b")]), name="n").collect()
    assert sorted(r.n for r in got) == [0, 0, 2] and got[0].doc == "y"
    assert count_tokens(docs([])).count() == 0
