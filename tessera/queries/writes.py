"""Queries that write: what a store in the shared folder holds after a series of deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.queries.registry import Registry
from tessera.session import shared_folder, table
from tessera.sources.store import Table, prepared, verified

R = Registry()
V = "with a as (select * exclude (n) from (select *, row_number() over (partition by artifact_id order by generation desc, ingested_at desc) n from artifacts) where n = 1) "
_CUT = "2025-05-01"


def _store(spark: SparkSession, name: str) -> Table:
    return Table(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}/{name}")


@R("snk2_insert_absent", f"with f as (select payload_hash_full, min(ingested_at) f from payload_blobs group by 1) select payload_hash_full, case when f < timestamp '{_CUT}' then 0 else 1 end::int delivery from f")
def snk2_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of two deliveries, each appended twice: a hash stays with the delivery that brought it first (SNK1)."""
    store, rows = _store(spark, "payloads"), table(spark, sf, "payload_blobs").select("payload_hash_full", "ingested_at")
    late = F.col("ingested_at") >= F.lit(_CUT).cast("timestamp_ntz")
    for delivery, part in enumerate((rows.where(~late), rows.where(late))):
        for _ in range(2):
            store.append_absent(part.select("payload_hash_full", F.lit(delivery).alias("delivery")), ["payload_hash_full"])
    return store.read("payload_hash_full string, delivery int")


@R("snk3_session_upsert", "select session_id, min(created_at) first_seen, max(last_referenced_at) last_seen, count(distinct artifact_id)::bigint artifacts from artifacts group by 1")
def snk3_session_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as they are after all of their artifacts: written once, then brought up to date."""
    rows, store = table(spark, sf, "artifacts"), _store(spark, "sessions")
    old = rows.where("generation = 1").groupBy("session_id").agg(F.min("created_at").alias("first_seen"), F.max("last_referenced_at").alias("last_seen"))
    store.append_absent(old, ["session_id"])
    new = rows.groupBy("session_id").agg(F.min("created_at").alias("first_seen"), F.max("last_referenced_at").alias("last_seen"), F.countDistinct("artifact_id").alias("artifacts"))
    seen = store.read(old.schema).unionByName(new.drop("artifacts")).groupBy("session_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return seen.join(new.select(F.col("session_id").alias("s"), "artifacts"), F.col("session_id").eqNullSafe(F.col("s"))).drop("s")


@R("snk6_conditional_update", V + "select artifact_id, case when map_status = 'pending' and generation = 1 then 'stale' else map_status end map_status from a")
def snk6_conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    """A stored catalog after an update of the rows that meet a condition."""
    store = _store(spark, "artifacts")
    commit = store.append_absent(catalog.valid_rows(table(spark, sf, "artifacts")).select("artifact_id", "generation", "map_status"), ["artifact_id"])
    store.update((F.col("map_status") == "pending") & (F.col("generation") == 1), {"map_status": F.lit("stale")}, expected=commit + 1)
    return store.read("artifact_id string, generation int, map_status string").select("artifact_id", "map_status")


@R("snk8_prepared_payloads", "select count(distinct source)::bigint n, true intact from documents where source is not null")
def snk8_prepared_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads written in two ways, stored by the hash of their canonical form: one each, intact when read back."""
    store, rows = _store(spark, "payloads"), table(spark, sf, "documents").where("source is not null")
    texts = rows.select(F.explode(F.array(F.concat(F.lit('{"b":1.0,"a":"'), F.col("source"), F.lit('"}')), F.concat(F.lit('{ "a" : "'), F.col("source"), F.lit('", "b" : 1 }')))).alias("t"))
    store.append_absent(prepared(texts, "t").select("payload_hash_full", "stored", "payload_json_bytes"), ["payload_hash_full"])
    return verified(store.read("payload_hash_full string, stored binary, payload_json_bytes int")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and("intact"), F.lit(True)).alias("intact"))


QUERIES, ORACLE = R.queries, R.sql
