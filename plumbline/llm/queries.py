"""Queries of the training-data problems on texts, by name; each takes (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, neardup, normalise, pairs, pii, tokenise, toxicity
from plumbline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids whose question or answer looks the same but is stored as different characters."""
    return normalise.same_looking(table(spark, sf_dir, "knowledge_yuanqi_import"))


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with both fields in canonical form."""
    return normalise.normalise_fields(table(spark, sf_dir, "knowledge_yuanqi_import"), ["question", "answer"]).select("id", "question", "answer")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids with a similarity of 0.6 or more."""
    return neardup.pairs(table(spark, sf_dir, "knowledge_yuanqi_import"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with its group of near-duplicates and its number of links."""
    return neardup.groups(table(spark, sf_dir, "knowledge_yuanqi_import"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose answer doesn't serve the question, with the defect."""
    return pairs.defective(table(spark, sf_dir, "knowledge_yuanqi_import"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information in each text of the log."""
    return pii.kinds_found(table(spark, sf_dir, "usage_log_entry"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of each row of the log with typed placeholders."""
    return pii.redacted(table(spark, sf_dir, "usage_log_entry")).select("log_id", "user_query", "response_snippet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenise.token_ids(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture, with the number of times each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of such documents by source."""
    return toxicity.rates(_scored(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_normalised, p2_found, p2_groups, p3_found, p5_found, p5_redacted, p7_ids, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}


def oracle_sql() -> dict[str, str]:
    return {}
