"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame; run() writes each result as Parquet to the shared folder and gives it to the next. All but
the last return the columns of `documents`. The last returns one row per piece of a document in a training sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import jaccard_join, langid, mixing, packing, suffix_dedup
from granary.llm.common import documents, word_count
from granary.llm.registry import query
from granary.sources.tables import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learned language, go."""
    identifier = langid.train(docs)
    found = langid.predict(docs, identifier)
    return found.where("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a likeness of 0.8 or more over five-word runs, one stays."""
    return jaccard_join.keep_one(docs, words=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur more than once go; the rest of the document stays."""
    return suffix_dedup.clean(docs, length=200)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions 5, 2, 1; labelled quality doubles or halves a document's chance."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
    # Words are counted below the join: the keys then travel without the texts, which are shuffled once, for the result.
    graded = docs.withColumn("__words", word_count("text")).join(labels, F.col("doc_id") == F.col("__id"), "left")
    quality = F.when(F.col("__q") == 1, 2.0).when(F.col("__q") == 0, 0.5).otherwise(1.0)
    return mixing.draw(graded, quality, words=F.col("__words")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, capacity=2048, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", pack),
]

# Language models, a tokenizer and components of a likeness graph cannot be told in SQL; tests/llm compares the run with plain Python.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
