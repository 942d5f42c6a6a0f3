"""One query per corpus operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, bpe, editcount, embeddings, langid, merkle, minhash, mixing, packing, quality
from .oracles import SQL
from .shared import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each, by its source's target."""
    return mixing.op5(_table(spark, sf_dir, "documents"))


def bpe_path() -> str:
    """The byte-level BPE file of the public tokenizers; never copied here."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def ranks_path() -> str:
    """The same vocabulary as ranks of byte strings."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: each document's set size, component and whether it stays."""
    return minhash.op1(_table(spark, sf_dir, "documents"))


def op2_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after three edits of every document, from kept trees."""
    return editcount.op2(_table(spark, sf_dir, "documents"), bpe_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text and its calibrated confidence."""
    return langid.op3(_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: number of ids and digests of both."""
    return bpe.op4(_table(spark, sf_dir, "documents"), bpe_path())


def op6_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every twentieth document."""
    return bm25.op6(_table(spark, sf_dir, "documents"))


def op7_packed_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as packed rows of ids, with their segments and digests."""
    return packing.op7(_table(spark, sf_dir, "documents"), ranks_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's probability of being of good quality."""
    return quality.op8(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record and how a damaged replica holds it."""
    return merkle.op9(_table(spark, sf_dir, "pages"))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors: each one's number of links, component and whether it stays."""
    return embeddings.op10(_table(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_minhash_near_duplicates,
    op2_edit_aware_token_counts,
    op3_language_id,
    op4_bpe_round_trip,
    op5_source_mixing,
    op6_bm25_top_k,
    op7_packed_token_matrices,
    op8_quality_classifier,
    op9_warc_fixity_audit,
    op10_embedding_near_duplicates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
