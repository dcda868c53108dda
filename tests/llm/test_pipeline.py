"""The pipeline's stages on a small corpus with planted cases, and over whole tables against the operators."""

import base64
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, shard string, _hits string, _lid_lang_pred string, _lid_score string, _copy string, _order_key string"
CLASH = ("h", "p", "q", "c", "o")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"word{k}" for k in range(30))
    clean = [(k, " ".join(f"the{k}x{j} of and to" for j in range(20)), "en", "a" if k % 3 else "b", 1, "e", "s") for k in range(40)]
    rows = clean + [
        (100, clean[5][1] + " one more", "en", "a", 1, "e", "s"),
        (101, clean[5][1].upper(), "en", "a", 1, "e", "s"),
        (102, f"hello there {passage} good bye", "en", "b", 1, "e", "s"),
        (103, None, "en", "a", 1, None, None),
        (104, "123 456", None, "a", 1, None, None),
        (105, "", "en", None, 1, None, None),
    ]
    rng = random.Random(2)
    rows += [(110, base64.b64encode(rng.randbytes(700)).decode(), None, "a", 1, "e", "s"), (111, rng.randbytes(500).hex(), None, "b", 1, "e", "s")]
    rows += [(None, "of and to the one without an id", "en", "a", 1, "e", "s")]
    rows = [(*r, *CLASH) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, planted)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {tuple(r[c] for c in ("_hits", "_lid_lang_pred", "_lid_score", "_copy", "_order_key")) for r in docs.collect()} == {CLASH}
    clean = set(range(40)) | {None}
    for k, v in {"language_id": clean | {100, 101, 102}, "near_dedup": clean | {102}, "decontaminate": clean}.items():
        assert kept[k] ^ v == set()
    assert kept == {"language_id": clean | {100, 101, 102}, "near_dedup": clean | {102}, "decontaminate": clean}
    mixed = pipeline.mix(spark, docs, planted)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= clean
    assert {tuple(r[c] for c in ("_hits", "_copy", "_order_key")) for r in mixed.collect()} == {("h", "c", "o")}
    placed = pipeline.shards(spark, mixed, planted)
    assert placed.count() == mixed.count()
    assert placed.filter(~F.col("grown_shard").isin(pipeline.SHARDS) & (F.col("grown_shard") != F.col("shard"))).count() == 0


def test_run_is_the_stages_and_repeats_itself(spark, planted):
    a = sorted(map(tuple, pipeline.run(spark, planted).collect()), key=str)
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, planted)
    assert a == sorted(map(tuple, docs.collect()), key=str) and a


def test_empty_tables(spark, planted, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
