"""The queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, edits, jaccard, maxent, mixing, neighbours, quality, quotes, repeats, sharding, sql


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _mix_targets(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.count("*").alias("n"))


def _unigram_base(docs: DataFrame) -> DataFrame:
    return maxent.score(docs, held_out=F.col("doc_id") % 7 == 2, rounds=1).drop("score").withColumn("base_score", F.round("base_score", 5))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": _over("documents", jaccard.op1_ngram_jaccard),
        "op2_suffix_dedup": _over("documents", repeats.op2_suffix_dedup),
        "op3_vector_packing": _over("documents", sharding.op3_vector_packing),
        "op4_maxent_scoring": _over("documents", maxent.op4_maxent_scoring),
        "op5_edit_counts": _over("documents", edits.op5_edit_counts),
        "op6_quotation_links": _over("conversations", quotes.op6_quotation_links),
        "op7_hash_prefix_forest": _over("embeddings", neighbours.op7_hash_prefix_forest),
        "op8_byte_bpe": _over("documents", bpe.op8_byte_bpe),
        "op9_mixing": _over("documents", mixing.op9_mixing),
        "op10_quality_rules": _over("documents", quality.op10_quality_rules),
        # columns of operators that SQL can say only in part
        "shard_sizes": _over("documents", lambda docs: sharding.shard(docs).select("doc_id", "size", "law")),
        "mix_targets": _over("documents", _mix_targets),
        "unigram_base": _over("documents", _unigram_base),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": sql.JACCARD,
        "op2_suffix_dedup": sql.REPEATS,
        "op10_quality_rules": sql.QUALITY,
        "shard_sizes": sql.SHARD_SIZES,
        "mix_targets": sql.MIX_TARGETS,
        "unigram_base": sql.UNIGRAM_BASE,
    }
