"""A training corpus from ``documents``: language identification, near-duplicate removal,
removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
in the shared folder and read again as the next stage's docs. All stages but the last return
the columns of ``documents``; the last returns the packed pieces.

Every stage takes an empty table (and returns one), and rows with nulls in any column. Repeated rows are rows of their
own until ``near_duplicates`` keeps one of them. Extra columns pass through all stages but the last unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm import langid, packing, simhash, suffix_dedup
from agora.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null and empty texts, texts without a letter, and texts far
    from every language. A null lang or doc_id speaks against no document; ties go to the first language in order."""
    return langid.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one of the smallest doc_id, null ids last, then the first
    stored. Texts without a word, null ones too, are one group (fingerprint zero)."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again, in any document, are cut out of the texts; every place of a passage is cut, so a text
    may become empty. A null text stays null, its row stays; very long texts are read whole."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of full length: a row for each piece. A null or empty text is one piece, the end token; a text
    longer than a sequence is cut into several; of its columns only doc_id is kept."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("packed", packed)]

#: SQL can express neither the fingerprints' components nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
