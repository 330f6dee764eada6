"""The document pipeline: each stage works on all that the one before it kept.

An executor's Python workers live through all stages, so each stage bounds the bytes of the Arrow batches that they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontam, neardup, pack, quality, rules
from tidewell.llm.bpe import vocabulary_path
from tidewell.session import bound_batches, delete, scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from all labelled documents.

    Null and empty texts are scored as texts of no words. Repeated rows are judged alike, rows without an id
    by their text. An empty table gives an empty one. Without a positive document to learn from all stay.
    """
    bound_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, model)


def passing_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the calibrated cutoffs of their language.

    Null, empty and short texts (fewer than ten words) fail the base rule. Repeated rows are judged alike. Null
    and rare languages have no cutoffs. An empty table gives an empty one.
    """
    bound_batches(spark)
    return rules.keep_passing(docs, rules.calibrate(docs, table(spark, sf_dir, "labels")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id, one without an id only if none has one.

    Of repeated rows one stays; unlike texts with one id, and unlike texts without ids, all stay. Null and empty
    texts are one class. An empty table gives an empty one.
    """
    bound_batches(spark)
    return neardup.dedup(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than a twentieth of the words are benchmark passages; judged row by row.

    Null and empty texts are clean. An empty table gives an empty one, an empty benchmark all documents.
    """
    bound_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids. A null or empty text is its end id alone; repeated rows
    are packed one by one. An empty table gives no rows."""
    bound_batches(spark)
    return pack.pack(docs, tokenizer=vocabulary_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", passing_rules),
    ("near duplicates", one_of_each_class),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: No SQL expresses the classifier, the samples or the packing; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again.

    A stage's rows go when the next one's are written, or on a failure; those of the last one with the application.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        before, path = path, scratch(spark, "pipeline")
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        finally:
            if before:
                delete(spark, before)
        docs = spark.read.parquet(path)
    return docs
