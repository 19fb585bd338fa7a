"""A training corpus from raw documents: clean, distinct, uncontaminated, mixed, and written as token ids.

Each stage gets what the one before kept, as Parquet read again, and returns documents in the columns they
came in; the last returns what the token store holds of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeaxis.llm import decontaminate, mixing, near_dedup, queries, toxicity
from tradeaxis.session import staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled model scores below its threshold."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return near_dedup.distinct(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, written and read back: key, place, number of ids, checksum."""
    return queries.stored_ids(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: Learning, hashing into bands and tokenizing are not for SQL; the tests run the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
