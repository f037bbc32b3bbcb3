"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, lexical, licenses
from .ann import nearest
from .chunks import deduplicated_text
from .common import table
from .decontam import leaks
from .lexical import ranked
from .licenses import license_scan
from .lines import line_report
from .mixing import mixture
from .parity import similar_sets
from .quality import quality_scores
from .simhash import near_duplicates
from .suffix import without_repeats
from .tokens import token_digests


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated chunks of runs under LEAST_RUN bytes stay, as short runs are chance more often than copies; the exact way, which
    takes them all out, is deduplicated_text(docs, least_run=0)."""
    return deduplicated_text(table(spark, sf_dir, "documents")).drop("text")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digests_only=True)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("source")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_leaks": op1_benchmark_leaks,
    "op2_fuzzy_line_dedup": op2_fuzzy_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_token_output": op8_token_output,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_license_scan": op10_license_scan,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_source_divergence": op12_source_divergence,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op10_license_scan": licenses.oracle_sql(), "op12_source_divergence": divergence.oracle_sql(), "op13_ranked_search": lexical.oracle_sql()}
