"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from shipwatch.llm import bagminhash, decontaminate, extraction, language, maxscore, packing, prefix_trie, privacy, quality, runs, substring, token_counts, warc
from shipwatch.llm.store import new_folder, read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = token_counts.TokenLedger(spark, new_folder(spark, "token-ledger"))
    return token_counts.maintained(read(spark, sf_dir, "documents"), ledger)


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.verdicts(decontaminate.contamination(docs, items))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_report(read(spark, sf_dir, "documents"))


def op7_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_report(read(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(read(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.looped(read(spark, sf_dir, "documents")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_maxscore, op3_warc, op4_near_duplicates, op5_decontaminate, op6_substring_dedup, op7_privacy, op8_main_text, op9_language, op10_packing,
        op11_word_runs, op12_quality, op13_prefix_trie,
        pipeline)
}
