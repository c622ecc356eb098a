"""From raw documents to packed training sequences: language ID, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import exact_dedup, language_id, minhash, mixing, packing
from stepweave.llm.common import read
from stepweave.session import materialize


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or not one letter) go.

    If no training row has a language (none labelled, or all of them held out), there is no model; every document with a letter stays.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.where(language_id.has_letter(F.col("text")))
    return language_id.guessed(docs, model).where(F.col("lang") != language_id.UNDETERMINED).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest original, then the smallest id.  Nulls count as empty."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of common five-word runs the one with the smallest id stays; texts without words are linked with nothing."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources come near their target share of words; a null source is one of its own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of permitted lengths, with their text and the ids of the documents in them.

    Documents without words, or null, are rows without a bin.
    """
    return packing.sequences(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
