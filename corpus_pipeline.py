"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, all
columns of ``docs`` with them, whatever further ones there are; the last returns
the selection, one row per document and epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import leaks, mixing, pii, quality, simhash
from sieveline.llm.common import Saved, free_names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The verdict is computed beside the row, so nothing is joined.

    The row number keeps the optimizer from moving the filter below the projection, which would repeat its expressions.

    Defined cases: null and empty texts have no words and go; long texts are
    judged whole; ties and repeated rows are judged alike, each on its own; null
    doc_id, source or language don't matter; an empty table gives an empty
    table; further columns, clashing names included, are carried along.
    """
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "text")
    judged = quality.beside(row, "row").select("row", "kept", F.monotonically_increasing_id().alias("n"))
    return judged.filter("kept and n >= 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id, null being the largest, and of these that with the lowest hash of its text.

    Defined cases: null and empty texts are copies of each other, and one stays;
    long texts are compared whole; of repeated rows (equal in doc_id and text)
    one stays, whichever; rows that share a doc_id but no text are documents of
    their own, so a row never goes for another's sake; null doc_ids are told
    apart by their texts; an empty table gives an empty table; further columns,
    clashing names included, are carried along.
    """
    return simhash.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Defined cases: null and empty texts contain none and stay, as does everything
    if there are no items; items that are null or empty match nothing; long texts
    are searched whole; repeated rows and ties are judged alike, each on its
    own; an empty table gives an empty table; further columns are carried along.
    """
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars``, where there is such a column, follows.

    Defined cases: null texts stay null, empty ones empty; long texts are read
    whole; repeated rows are redacted alike; no row goes; an empty table gives
    an empty table; further columns are carried along.
    """
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selection by source weights: the documents with epoch, domain and tokens.

    Defined cases: null or empty texts have no tokens and are never taken; null
    source or language are leaves of their own; long texts are taken whole or not
    at all; repeated rows are taken apart, each for itself; ties in the seeded
    order go by doc_id and tokens; an empty table gives an empty selection; further
    columns are carried along, and where one is named epoch, domain or n_tokens
    the selection's own gets an underscore behind its name.
    """
    names = free_names(docs, "epoch", "domain", "n_tokens")
    return mixing.select(docs).select("doc.*", *[F.col(c).alias(n) for c, n in zip(("epoch", "domain", "n_tokens"), names)])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]

ORACLE_SQL = None  # SimHash, retrieval and boosted trees are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = Saved(docs, f"stage{k}").df
    return docs
