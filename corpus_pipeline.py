"""A corpus pipeline of five stages over ``documents``, each calling one operator of the subpackage llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All stages but the last return
the columns of documents.  Null texts count as empty throughout; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.exact_dedup import drop_exact_duplicates
from tessera.llm.mixing import mixed_documents
from tessera.llm.ngram_join import drop_near_duplicates
from tessera.llm.quality_knn import held_out, score_quality
from tessera.llm.queries import MODEL_FILE
from tessera.llm.sentencepiece_codec import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    free = [n for n in (f"_quality_{k}" for k in range(len(docs.columns) + 2)) if n not in docs.columns]
    scored = score_quality(docs, labels, ~held_out(F.col("doc_id")), score_col=free[0], predicted_col=free[1])
    return scored.where(F.col(free[1]) == 1).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest doc_id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with proof that they decode to the text."""
    return encode_documents(docs, MODEL_FILE)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: Latent vectors, pivotal rounding and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
