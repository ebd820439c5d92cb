"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns the encoded documents. Nulls, empty and very long
texts, ties, repeated rows, empty tables and extra columns are treated as the operators' own
docstrings say; a stage passes extra columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import bpe, exact_dedup, langid, minhash, mix
from ledgerframe.llm.common import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects; a null lang takes the predicted one."""
    found = langid.annotated(docs, langid.fit(docs), "__").filter("not __rejected")
    return found.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.unique_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, repeated or left out as the sources' targets ask."""
    return mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of what the ids decode to) of every row."""
    return bpe.tokenised(docs)


STAGES = [
    ("language", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the near-duplicate search can't be stated in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
