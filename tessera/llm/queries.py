"""The queries of the text problems p5 to p8, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import leakage, sample, spam, tokens
from tessera.session import table

PROFILE = ["artifact_id", "root_key"]
#: Size of the sample in production, and of one that is smaller than any of the tables.
SAMPLE_SIZE, SMALL_SAMPLE_SIZE, SEED = 500, 50, 20250711


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of the distinct profiles."""
    return sample.fixed_size_sample(table(spark, sf_dir, "artifact_schema_roots"), PROFILE, SAMPLE_SIZE, SEED)


def p5_small_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a sample much smaller than the table."""
    return sample.fixed_size_sample(table(spark, sf_dir, "artifact_schema_roots"), PROFILE, SMALL_SAMPLE_SIZE, SEED)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain passages of held-out items."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword piles, link lists and tag lists."""
    return spam.spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p5_sample, p5_small_sample, p6_ids, p7_found, p8_found)}

_P5 = """
select artifact_id, root_key from (select distinct artifact_id, root_key from artifact_schema_roots)
order by md5('{seed}' || '|' || coalesce('1' || artifact_id, '0') || '|' || coalesce('1' || root_key, '0')), artifact_id, root_key limit {k}
"""

ORACLE = {
    "p5_sample": _P5.format(seed=SEED, k=SAMPLE_SIZE),
    "p5_small_sample": _P5.format(seed=SEED, k=SMALL_SAMPLE_SIZE),
}
