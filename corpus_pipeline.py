"""From raw documents to packed training sequences, stage by stage.

Every stage is one operator of ``paperloom.llm``. A stage takes what its
predecessor kept and returns the columns of ``documents``; the last one returns
the places of the pieces. Stages are written as Parquet between one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, langid, mixing, ngram_join, packing
from paperloom.llm.common import stored
from paperloom.llm.registry import byte_bpe
from paperloom.operators.shared import with_computed

# the mix follows a hash order that SQL shares, but languages, components of
# near copies and packing are no SQL: tests/llm compares the stages instead
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is in no language, and name the language of what has no label.

    Null texts and texts without a letter go. The verdict becomes ``lang`` where
    that is null; a table without labels has no language to predict, and there
    ``lang`` stays null and all other texts stay.
    """
    predict = langid.language_struct(langid.learn_from(docs), spark)
    told = with_computed(docs, "__verdict", predict(F.col("text"))).where("__verdict.lettered")
    named = F.coalesce("lang", F.nullif(F.col("__verdict.lang_pred"), F.lit(langid.UNKNOWN)))
    return told.withColumn("lang", named).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies: five words, similarity 0.8."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return packing.pack_pieces(packing.tokenised_pieces(docs, byte_bpe()))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
