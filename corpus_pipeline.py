"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last keep the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm import decontaminate, exact_dedup, langid, minhash, packing
from assaybook.llm.shared import stored
from assaybook.session import tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language go: no letters, noise, or a best guess that is hardly better than chance.

    The model learns from the rows that have a language (a bounded sample, see langid), and from their scrambled texts what is none.
    """
    return langid.identify(docs, langid.fit(docs, noise=True))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of all whose texts are equal after lowering A-Z stays: that with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (runs of five words, similarity 0.8): the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are benchmark for more than half of their words go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = decontaminate.remove_contamination(docs, benchmark)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in sequences of at most 2048, one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("pack", pack)]

#: Trained models, signatures and tokenizers have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one stored before the next reads it."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
