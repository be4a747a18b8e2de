"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

A stage's result is written as Parquet and read again as the next stage's documents. All but the last return the
columns of the documents; the last returns the mix, one row per document that it takes. For every stage an empty table
gives an empty result, texts of any length are read whole, and columns beside those it names pass through unread,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.decontaminate import drop_contaminated
from stowage.llm.langid import keep_identified
from stowage.llm.mixing import mix_manifest
from stowage.llm.pii import redact
from stowage.llm.simhash import drop_near_duplicates
from stowage.session import read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts, texts without a letter, and those with a low score.

    A score of exactly the limit is kept; repeated rows are judged each by itself; without any labelled row to learn
    from nothing can be told and all documents go.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: the smallest id, null first, then the smallest row hash.

    Null texts are empty, and all texts without words are one class; of rows alike in all columns one is kept.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none, and repeated rows go or stay together."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars, where there is one, follows the text.

    Spans that overlap are replaced together by the first one's kind; null texts stay null; no row is dropped.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words it takes and from which slot on.

    Null texts have no words and are not taken; a null source is a source of its own; repeated rows are documents of
    their own.
    """
    return mix_manifest(docs).where("taken > 0")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: The trained models and the low-discrepancy schedule are no SQL; the tests compare the stages and run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
