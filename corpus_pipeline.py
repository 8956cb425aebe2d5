"""A corpus in five stages: language, near duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes and reads
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import jaccard, language_id, packing, pii, source_mix
from tonearm.llm._common import cleared, free_name, new_path, read, remove_path, tokenizer_path

#: The stages learn and sample, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects."""
    return language_id.keep_accepted(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts alike in 0.8 of their five-word shingles.

    SimHash links are candidates, beside those of shingle minima; see ``tonearm.llm.jaccard``.
    """
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks of its kind; n_chars, if there is one, follows the text."""
    name = free_name("pii_spans", docs.columns)
    text = pii.redacted(F.col("text"), F.col(name))
    found = pii.add_spans(docs, name=name).withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return found.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document of two epochs comes twice."""
    return source_mix.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mix", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself goes when its result is written,
    and its input when the next stage has read it."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
