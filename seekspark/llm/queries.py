"""The registered queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ego_join, imatch, importance, lang_id, line_dedup, lm, mixing, near_dedup, quality, sample_pieces, suffix_dedup, variants
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(_table(spark, sf_dir, "conversations"), Scratch(spark, "op1"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir), Scratch(spark, "op2"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    trees = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.quality(docs, trees).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "op4"))
    return out.select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(_table(spark, sf_dir), Scratch(spark, "op5"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op6_ego_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op6"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir), Scratch(spark, "op7"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces.encode_checked(_table(spark, sf_dir))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.held_out_score(_table(spark, sf_dir), Scratch(spark, "op9"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # sums of logarithms, whatever their order


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.held_out_languages(_table(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir), Scratch(spark, "op11"))


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.match(_table(spark, sf_dir), Scratch(spark, "op12"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"), Scratch(spark, "op13"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_mix_sources,
        op3_quality_trees,
        op4_line_dedup,
        op5_minhash_near_dedup,
        op6_ego_near_vectors,
        op7_suffix_dedup,
        op8_sampled_pieces,
        op9_kneser_ney,
        op10_language_id,
        op11_spelling_variants,
        op12_imatch,
        op13_importance_resampling,
    )
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_minhash_near_dedup": near_dedup.ORACLE,
    "op6_ego_near_vectors": ego_join.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op9_kneser_ney": lm.ORACLE,
    "op11_spelling_variants": variants.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
