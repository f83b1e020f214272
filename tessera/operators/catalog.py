"""Tables of the catalog as relations: valid rows, chains, roots, blobs, and what refers to what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import hierarchy
from tessera.operators.series import numbered, with_previous


def valid_rows(artifacts: DataFrame) -> DataFrame:
    """One row per artifact_id: the highest generation, then the latest delivery."""
    return latest(artifacts, ["artifact_id"], F.struct("generation", "ingested_at"))


def latest(rows: DataFrame, keys: list[str], rank: Column, last: bool = True) -> DataFrame:
    """The row of each key with the highest (or lowest) rank: one aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    return latest(blobs, ["binary_hash"], F.struct("ingested_at", "mime"), last=False)


def artifact_blobs(artifacts: DataFrame, refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """(artifact_id, binary_hash, mime, byte_count): the blobs of each artifact's payload."""
    bridge = refs.select("payload_hash_full", "binary_hash").distinct()
    return artifacts.select("artifact_id", "payload_hash_full").join(bridge, "payload_hash_full").join(distinct_blobs(blobs).select("binary_hash", "mime", "byte_count"), "binary_hash")


def blob_list(links: DataFrame) -> DataFrame:
    """One row per blob: number of artifacts, the first of them, and its size."""
    return links.groupBy("binary_hash").agg(F.countDistinct("artifact_id").alias("artifacts"), F.min("artifact_id").alias("first_artifact"), F.max("byte_count").alias("byte_count"))


def previous_capture(artifacts: DataFrame, value: str, out: str) -> DataFrame:
    """``artifacts`` with the value of the capture before, of the same session and tool, however many these have."""
    rows = artifacts.withColumn("_own", F.struct("artifact_id", F.col(value).alias("value")))
    return with_previous(rows, ["session_id", "source_tool"], "created_seq", "_own", "_before").withColumn(out, F.col("_before.value")).drop("_own", "_before")


def chains(artifacts: DataFrame, valid_by: tuple[str, ...] = ("generation", "ingested_at")) -> DataFrame:
    """(artifact_id, chain_id): the artifacts tied together by parent links in any direction.

    Going up from anywhere in a chain ends at one place, its root or its cycle, which names the chain.
    """
    found = hierarchy(artifacts, "artifact_id", "parent_artifact_id", valid_by)
    return found.select(F.col("id").alias("artifact_id"), F.col("root_id").alias("chain_id"))


def chain_places(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, chain_id, place): the order of a chain's valid rows, by chain_seq (nulls first), created_seq and id."""
    rows = valid_rows(artifacts).select("artifact_id", "chain_seq", "created_seq").join(chains(artifacts), "artifact_id")
    return numbered(rows, ["chain_id"], [F.col("chain_seq").asc_nulls_first(), F.col("created_seq").asc_nulls_first(), F.col("artifact_id")], "place").select("artifact_id", "chain_id", "place")


def root_signature() -> Column:
    return F.concat_ws("|", F.lower(F.trim("mode")), F.lower(F.trim("completeness")), "schema_hash")


def root_catalog(roots: DataFrame) -> DataFrame:
    """Per root_path: artifacts, records, different signatures, and whether one signature fits all."""
    out = roots.groupBy("root_path").agg(F.countDistinct("artifact_id").alias("artifacts"), F.sum("observed_records").alias("records"), F.countDistinct(root_signature()).alias("signatures"))
    return out.withColumn("compatible", F.col("signatures") <= 1)


def related_set_hash(members: DataFrame, group: str) -> DataFrame:
    """Per group a hash of its sorted ``artifact_id:generation`` members; a group is one chain, of bounded length."""
    parts = F.array_sort(F.collect_set(F.concat("artifact_id", F.lit(":"), F.col("generation").cast("string"))))
    return members.groupBy(group).agg(F.sha2(F.concat(F.lit('["'), F.array_join(parts, '","'), F.lit('"]')), 256).alias("related_set_hash"))


def described(artifacts: DataFrame, roots: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per visible artifact: its status, roots, their shapes, fields and records, and the size of its session.

    A root's shape is ``array`` if its profile has elements as rows (``[*]`` paths or a path below ``$``), else ``object``.
    """
    root = roots.groupBy("artifact_id", "root_key").agg(F.max("root_path").alias("root_path"), F.max("observed_records").alias("records"))
    field = fields.groupBy("artifact_id", "root_key").agg(F.countDistinct("field_path").alias("fields"))
    shape = F.when((F.col("root_path") != "$") | (F.col("records") > 1), "array").otherwise("object")
    per_root = root.join(field, ["artifact_id", "root_key"], "left").select("artifact_id", F.struct("root_path", shape.alias("shape"), F.coalesce("fields", F.lit(0)).alias("fields"), "records").alias("root"))
    listed = per_root.groupBy("artifact_id").agg(F.array_sort(F.collect_list("root")).alias("roots"))
    seen = artifacts.where("deleted_at is null").select("artifact_id", "session_id", "map_kind", "map_status")
    sizes = seen.groupBy(F.struct("session_id").alias("s")).agg(F.count(F.lit(1)).alias("session_artifacts"), F.count(F.when(F.col("map_status") == "ready", 1)).alias("session_ready"))
    return seen.withColumn("s", F.struct("session_id")).join(listed, "artifact_id", "left").join(sizes, "s").drop("s", "session_id")


def schema_groups(artifacts: DataFrame, roots: DataFrame) -> DataFrame:
    """(session_id, root_path, schema_hash, artifacts, first, last): the artifacts of each schema where a session has a root with several."""
    own = roots.select("artifact_id", "root_path", "schema_hash").distinct().join(artifacts.where("deleted_at is null").select("artifact_id", "session_id"), "artifact_id")
    groups = own.groupBy("session_id", "root_path", "schema_hash").agg(F.countDistinct("artifact_id").alias("artifacts"), F.min("artifact_id").alias("first"), F.max("artifact_id").alias("last"))
    several = groups.groupBy(F.struct("session_id", "root_path").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.withColumn("k", F.struct("session_id", "root_path")).join(several, "k", "left_semi").drop("k")


def resolved_root(artifacts: DataFrame, roots: DataFrame, asked: str | None) -> DataFrame:
    """(artifact_id, status, root_path, suggestions): the root a query of each artifact is about.

    Without ``asked`` it is the only root, or none if there are several (``ambiguous``); an asked root that
    is not there is ``missing``. What there is instead is suggested, a schema wide at most.
    """
    there = roots.groupBy("artifact_id").agg(F.array_sort(F.collect_set("root_path")).alias("there"))
    rows = artifacts.select("artifact_id").join(there, "artifact_id", "left")
    paths = F.coalesce("there", F.array().cast("array<string>"))
    if asked is None:
        status = F.when(F.size(paths) == 0, "missing").when(F.size(paths) == 1, "ok").otherwise("ambiguous")
        root = F.when(F.size(paths) == 1, F.element_at(paths, 1))
    else:
        status = F.when(F.array_contains(paths, asked), "ok").otherwise("missing")
        root = F.when(F.array_contains(paths, asked), asked)
    return rows.select("artifact_id", status.alias("status"), root.alias("root_path"), F.when(status != "ok", F.array_join(paths, ",")).alias("suggestions"))


def blobs_in_scope(links: DataFrame, scope: list[str], limit: int) -> DataFrame:
    """(scope, binary_hash, byte_count, place, truncated): the ``limit`` largest blobs of each scope, and whether there are more."""
    own = links.groupBy(*scope, "binary_hash").agg(F.max("byte_count").alias("byte_count"))
    placed = numbered(own, scope, [F.col("byte_count").desc_nulls_last(), F.col("binary_hash")], "place")
    sizes = own.groupBy(F.struct(*scope).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return placed.where(F.col("place") <= limit).withColumn("k", F.struct(*scope)).join(sizes, "k").select(*scope, "binary_hash", "byte_count", "place", (F.col("n") > limit).alias("truncated"))
