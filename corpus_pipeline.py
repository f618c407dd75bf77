"""A corpus pipeline of five operators: each stage works on all documents that the one before it kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table (which gives none) and
columns of any other name; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, mixing, queries, secrets, simhash
from gridloom.llm.common import packed, written

#: A document whose calibrated probability is below this is rejected with those that have no letter.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence.

    Texts that are null, empty or without a letter go; repeated rows are judged alike; a null id or label is no obstacle.
    If no document has a label, nothing can be learned and no language told: all documents stay.
    """
    model = langid.train(docs)
    if not model.labels:
        return docs
    rows = packed(docs, text=F.col("text"))
    named = langid.predicted(rows, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return named.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Of repeated rows one stays. Null, empty and blank texts are copies of each other. A document without an id stays only
    if none of its group has one, and then one for each text.
    """
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what is a secret masked in the text, and n_chars, where there is one, that of the masked text.

    A null text stays null, and so does its n_chars; repeated rows stay.
    """
    masked = secrets.masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words are taken no times; a null source is a source; each of several repeated rows is taken by itself.
    """
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of tokens for each document that the mix took: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; a null id stays null; repeated rows each get their row.
    """
    return bpe.encode_digests(docs, queries.vocabulary(queries.WORDS))


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: A classifier, hashes, a draw and a vocabulary: no stage is one that SQL can express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
