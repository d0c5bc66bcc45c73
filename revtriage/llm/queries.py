"""Registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .alignment import align_documents
from .common import table
from .dac import token_files
from .exact_dedup import exact_dedup
from .language_id import identify_languages
from .ngram_join import jaccard_components
from .packing import best_fit_packing
from .periodic_runs import periodic_runs, run_digest, with_planted_runs
from .pii import replace_pii
from .quality import judge_quality
from .sentencepiece_encode import encode_with_spans, span_digest
from .sharding import hilbert_shards
from .token_counts import token_counts
from .warc_zip import warc_round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("class_size")


def op2_addressable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


def op4_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(encode_with_spans(table(spark, sf_dir, "documents")))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op7_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op9_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).withColumn("p_good", F.round("p_good", 6))


def op3_zip_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op10_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.when(text == "", "").otherwise(F.sha2(text.cast("binary"), 256))
    rows, _ = align_documents(table(spark, sf_dir, "documents"), groups=digest)
    return rows.withColumnRenamed("groups", "groups_sha256").drop("n_overlaps")


def op13_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ngram_jaccard_join,
        op2_addressable_token_files,
        op3_zip_packaged_warc,
        op4_block_naming_dedup,
        op5_sentencepiece_spans,
        op6_hilbert_sharding,
        op7_rank_synchronous_counts,
        op8_best_fit_packing,
        op9_weak_supervision_quality,
        op10_surrogate_pii,
        op11_periodic_runs,
        op12_cross_tokenizer_alignment,
        op13_language_filters,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": sql.OP1, "op3_zip_packaged_warc": sql.OP3, "op4_block_naming_dedup": sql.OP4, "op9_weak_supervision_quality": sql.quality_sql()}
