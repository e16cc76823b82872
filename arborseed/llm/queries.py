"""The operators' queries over whole tables and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mix, exact_dedup, html_blocks, importance, induced_dedup, jaccard_join, kn_quality, line_spread, lsi_decontam, packing, secret_ledger, spelling_variants, target_resampling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_lsi_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsi_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secret_spans(table(spark, sf_dir, "documents"))


def op9_induced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induced_dedup.dedup_repeats(table(spark, sf_dir, "documents"))


def op10_context_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mix.mixing_scores(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_blocks": op1_html_blocks,
    "op2_line_spread": op2_line_spread,
    "op3_kn_quality": op3_kn_quality,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_lsi_decontam": op6_lsi_decontam,
    "op7_importance": op7_importance,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_induced_dedup": op9_induced_dedup,
    "op10_context_mix": op10_context_mix,
    "op11_target_resampling": op11_target_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op2_line_spread": line_spread.oracle(),
    "op5_jaccard_join": jaccard_join.oracle(),
    "op8_secret_ledger": secret_ledger.oracle(),
    "op11_target_resampling": target_resampling.oracle(),
    "op12_exact_dedup": exact_dedup.oracle(),
    "op13_spelling_variants": spelling_variants.oracle(),
}
