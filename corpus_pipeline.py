"""The corpus pipeline: toxicity, language, near-duplicates, packing, each over all rows that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm import langid, minhash, packing, toxicity
from orecart.llm.common import Scratch


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough n-grams of a language; junk, languages that were not learned and texts without letters go."""
    model = langid.fit(docs)
    return langid.accepted(docs, model, langid.floors(docs, model))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group of near-duplicates (five words, 80 %), and rows without a group.

    Repeated rows of an id and text count as one; an id with several texts is a row for each; rows without an id stay.
    """
    return minhash.one_of_each(docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [("toxicity", harmless), ("language", in_a_language), ("near_duplicates", one_of_each), ("packing", packed)]

#: Trained models and sketches are not expressible in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
