"""From raw documents to token ids: five stages, each one corpus operator.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame, which run() writes as Parquet and rereads as the next
stage's docs.  All but the last return the columns of documents.  Tables without
rows give results without rows; nulls and repeated rows are treated as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, langid, minhash, mixing, quality
from factloom.llm.queries import bpe_path
from factloom.llm.shared import Scratch, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of too little confidence in it, go."""
    prepare(spark)
    return langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of quality 0 than 1 go."""
    prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    prepare(spark)
    return minhash.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.emit(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number and digests; the text itself goes."""
    prepare(spark)
    return bpe.encode(docs, bpe_path())[0]


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the classifiers nor the encoder; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
