"""The corpus pipeline: toxicity, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir), where docs is a Parquet scan of what the stage before kept, and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm.common import documents, small_batches, written
from pagelattice.llm.packing import pack_documents
from pagelattice.llm.runs_dedup import cleaned
from pagelattice.llm.simhash import one_of_each_group
from pagelattice.llm.toxicity import kept_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null and empty texts stay, repeated rows go or stay together, an empty table gives an empty one; without toxic
    training rows all stay. Texts of any length are scored whole.
    """
    small_batches(spark)
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    All pairs of the similarity are linked, so one fingerprint of ``op1_simhash`` is enough: it only joins most of them early.
    Null texts count as empty; texts without words are one group. Of repeated rows one stays, rows with a null id go
    before others. An empty table gives an empty one. Texts of any length are compared whole.
    """
    small_batches(spark)
    return one_of_each_group(docs, lanes=1, complete=True)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at several places of what is left are cut out of the texts.

    No row goes: null texts stay null, a text that repeats whole stays empty. An empty table gives an empty one.
    """
    small_batches(spark)
    return cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048.

    Null and empty texts are their end id alone, repeated rows are packed each, an empty table gives no rows.
    """
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("repeats", repeats), ("packing", packing)]

#: Classifier and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage before it gives is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
