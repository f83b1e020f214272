"""Retention: expiry, soft and hard deletion, quota, reconciliation with storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def expired(artifacts: DataFrame, now: Column, batch: int | None = None) -> DataFrame:
    """Visible artifacts whose time is over, the longest expired first."""
    rows = artifacts.where(F.col("deleted_at").isNull() & (F.col("expires_at") <= now)).select("artifact_id", "expires_at")
    return rows.orderBy("expires_at", "artifact_id").limit(batch) if batch else rows


def unreferenced(artifacts: DataFrame, before: Column) -> DataFrame:
    """Visible artifacts that nobody has looked at since ``before`` and no artifact has as parent."""
    parents = artifacts.where("parent_artifact_id is not null").select(F.col("parent_artifact_id").alias("artifact_id")).distinct()
    return artifacts.where(F.col("deleted_at").isNull() & (F.col("last_referenced_at") < before)).join(parents, "artifact_id", "left_anti").select("artifact_id")


def hard_delete(artifacts: DataFrame, payloads: DataFrame, refs: DataFrame, blobs: DataFrame, before: Column) -> dict[str, DataFrame]:
    """What goes when artifacts deleted before a time go: they, payloads no other artifact has, blobs no other payload has."""
    gone = artifacts.where(F.col("deleted_at") < before).select("artifact_id", "payload_hash_full")
    kept = artifacts.join(gone.select("artifact_id"), "artifact_id", "left_anti")
    dead_payloads = payloads.select("payload_hash_full").distinct().join(kept.select("payload_hash_full").distinct(), "payload_hash_full", "left_anti")
    live_refs = refs.join(dead_payloads, "payload_hash_full", "left_anti")
    dead_blobs = blobs.select("binary_hash").distinct().join(live_refs.select("binary_hash").distinct(), "binary_hash", "left_anti")
    return {"artifacts": gone.select("artifact_id"), "payloads": dead_payloads, "blobs": dead_blobs}


def storage_usage(payloads: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: bytes of payload JSON, of binaries, and both."""
    p = payloads.agg(F.coalesce(F.sum("payload_json_bytes"), F.lit(0)).cast("bigint").alias("payload_bytes"))
    b = blobs.agg(F.coalesce(F.sum("byte_count"), F.lit(0)).cast("bigint").alias("binary_bytes"))
    return p.crossJoin(b).withColumn("total_bytes", F.col("payload_bytes") + F.col("binary_bytes"))  # one row each


def running_total(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """A running sum along an order without one task for all rows.

    Rows are dealt out by ranges of the order; sums run within a part, and the parts' totals (one row a
    part) give each its start.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut_lineage(ranged.withColumn("_in", within))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_t"))
    starts = totals.select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(out, F.col("_in") + F.col("_start")).drop("_part", "_in", "_start")


def quota_victims(artifacts: DataFrame, excess: int) -> DataFrame:
    """The least recently used artifacts whose payloads free ``excess`` bytes.

    A payload is freed with the last artifact that has it, so its bytes count at that artifact's place.
    """
    live = artifacts.where("deleted_at is null and payload_hash_full is not null").select("artifact_id", "payload_hash_full", "payload_total_bytes", F.struct("last_referenced_at", "artifact_id").alias("rank"))
    freed = live.groupBy("payload_hash_full").agg(F.max("rank").alias("rank"), F.max("payload_total_bytes").alias("freed"))
    rows = live.join(freed.select("rank", "freed"), "rank", "left").select("rank.last_referenced_at", "artifact_id", F.coalesce("freed", F.lit(0)).alias("freed"))
    total = running_total(rows, ["last_referenced_at", "artifact_id"], "freed", "running")
    return total.where(F.col("running") - F.col("freed") < excess).select("artifact_id", "freed", F.col("running").cast("bigint").alias("running"))


def reconcile(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, fault): ``orphan`` on disk only, ``missing`` in the catalog only."""
    e, p = expected.select(key).distinct(), present.select(key).distinct()
    return p.join(e, key, "left_anti").withColumn("fault", F.lit("orphan")).unionByName(e.join(p, key, "left_anti").withColumn("fault", F.lit("missing")))
