"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm.bpe import encode_documents
from pagelattice.llm.common import documents, small_batches
from pagelattice.llm.embed_dedup import link_vectors
from pagelattice.llm.html_text import extract_pages
from pagelattice.llm.licenses import scan_documents
from pagelattice.llm.lm_score import score_documents as lm_scores
from pagelattice.llm.oracles import OP11, OP12
from pagelattice.llm.packing import pack_documents
from pagelattice.llm.pii import find_personal_data
from pagelattice.llm.resample import resampled
from pagelattice.llm.runs_dedup import digests
from pagelattice.llm.simhash import near_duplicates
from pagelattice.llm.toxicity import score_documents as toxicity_scores
from pagelattice.llm.valid_time import enriched_sales
from pagelattice.llm.webp import media_documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_sales(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_valid_time": op11_valid_time,
    "op12_resampling": op12_resampling,
    "op13_personal_data": op13_personal_data,
}

OP5_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS least FROM reached GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN many ON many.a = vec_id
"""

#: The other operators have no SQL form: they hash, tokenise or encode bytes, or learn; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_embedding_dedup": OP5_SQL, "op11_valid_time": OP11, "op12_resampling": OP12}
