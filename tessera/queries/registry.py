"""How a module of queries registers them with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.variants import once
from tessera.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        assert name not in self.queries, name
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.add(name, f, sql)
            return f

        return put


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_id, root_path, idx, v) of the records that are valid JSON."""
    rows = spread(table(spark, sf_dir, "artifact_records").select("artifact_id", "root_path", "idx", "record"))
    rows = rows.select("artifact_id", "root_path", "idx", once(F.try_parse_json("record")).alias("v"))
    return rows.where("v is not null")


#: The same in SQL, with the value as ``j``.
RECORDS = "with r as (select artifact_id, root_path, idx, record::json j from artifact_records where json_valid(record)) "


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_hash_full, v, envelope) of the envelopes that are valid JSON objects, one per hash: the first delivered."""
    rows = table(spark, sf_dir, "payload_blobs").select("payload_hash_full", "ingested_at", "envelope", F.try_parse_json("envelope").alias("v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT") & F.try_variant_get("v", "$.content", "array<variant>").isNotNull())
    first = rows.groupBy("payload_hash_full").agg(F.min_by("envelope", F.struct("ingested_at", "envelope")).alias("envelope"))
    return first.select("payload_hash_full", "envelope", once(F.parse_json("envelope")).alias("v"))


ENVELOPES = """with e as (select payload_hash_full, arg_min(envelope, (ingested_at, envelope))::json j from payload_blobs
  where json_valid(envelope) and json_type(envelope, '$.content') = 'ARRAY' group by 1) """
