"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reposift.llm import bpe, chat, decontam, embeddings, lines, lm, periodic, secretscan, simhash, spelling, suffix, toxicity, urls
from reposift.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that cuts texts into pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), *vocabulary())


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_control(load(spark, sf_dir, "conversations")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(load(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(load(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(load(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(load(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(load(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digests(load(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_chat_format": op2_chat_format,
        "op3_line_dedup": op3_line_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_links": op5_embedding_links,
        "op6_simhash": op6_simhash,
        "op7_lm_score": op7_lm_score,
        "op8_url_filter": op8_url_filter,
        "op9_decontamination": op9_decontamination,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_secret_scan": op11_secret_scan,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.oracle(),
        "op3_line_dedup": lines.oracle(),
        "op5_embedding_links": embeddings.oracle(),
        "op8_url_filter": urls.oracle(),
        "op9_decontamination": decontam.oracle(),
        "op11_secret_scan": secretscan.oracle(),
        "op12_spelling_variants": spelling.oracle(),
        "op13_periodic_runs": periodic.oracle(),
    }
