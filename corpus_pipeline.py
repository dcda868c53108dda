"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding, each written and read again.

A stage takes (spark, docs, folder of tables) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.decontam import contaminated, find_contamination
from lexmill.llm.frames import free, free_prefix, small_batches
from lexmill.llm.language_id import NO_LANGUAGE, RESULTS, held_out, identify_language
from lexmill.llm.near_dedup import near_duplicates
from lexmill.llm.poisson_mix import mix_sources
from lexmill.llm.sharding import shard
from lexmill.session import save, table

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without a text or a letter go, and those to which the network gives none.

    Each row is judged by its text alone, so repeated rows stay or go together; nulls in other columns don't matter.
    """
    own = free_prefix(docs, "_lid_", *RESULTS)
    known = identify_language(docs, table(spark, sf_dir, "documents").filter(~held_out()), prefix=own)
    return known.filter((F.col(f"{own}lang_pred") != "und") & (F.col(f"{own}no_language") < NO_LANGUAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates. Rows of one id stay or go together; rows without an id
    and texts without words stay."""
    with small_batches(spark):  # its jobs with texts end in here; executors hold less of them beside what other stages left
        groups = near_duplicates(docs)
    gone = groups.filter("doc is not null and doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows cover less than a twentieth; a null text has none and stays."""
    (name,) = free(docs, "_hits")
    return find_contamination(docs, table(spark, sf_dir, "benchmark"), name=name).filter(~contaminated(F.col(name))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in global random order; a null source is one of its own."""
    return mix_sources(docs, prefix=free_prefix(docs, "_", "copy", "order_key")).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard, slot and grown_shard, which replace columns of these names."""
    return shard(docs, SHARDS)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shards),
]

#: SQL can't express the first stage, in which a trained network rejects documents, nor what the others make of its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
