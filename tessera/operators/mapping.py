"""Mapping of captures: which way a payload is mapped, schemas of samples, schema payloads, guarded results.

Defined results: a payload of unknown size fails; results for artifacts the catalog does not know are
``unknown``; a result of any other generation than the present one, null or not, is stale; a root without fields has an empty field list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TYPE_ORDER
from tessera.operators.partial import Budget, map_payloads

#: Bytes up to which a payload is mapped as a whole, and bytes a worker may hold of one.
FULL_BYTES, MEMORY_BYTES = 10_000_000, 200_000_000


def route(size: Column, binary: Column, full: int = FULL_BYTES, memory: int = MEMORY_BYTES) -> Column:
    """``full``, ``partial`` (too large to be mapped as a whole, or stored as a binary) or ``failed`` (too large to be held)."""
    return F.when(size.isNull() | (size > memory), "failed").when(F.coalesce(binary, F.lit(False)) | (size > full), "partial").otherwise("full")


def mapped(payloads: DataFrame, key: str, text: str, size: Column, binary: Column, full: int = FULL_BYTES, memory: int = MEMORY_BYTES, budget: Budget = Budget()) -> DataFrame:
    """(key, map_kind, root_path, elements, closed, stop_reason, paths): every payload mapped the way it is routed to, those that fail without a root."""
    routed = payloads.withColumn("_kind", route(size, binary, full, memory))
    whole = Budget(characters=memory, elements=memory, root_depth=budget.root_depth, record_bytes=budget.record_bytes)
    columns = [key, "map_kind", "root_path", "elements", "closed", "stop_reason", "paths"]
    ways = [map_payloads(routed.where(F.col("_kind") == kind), key, text, b).withColumn("map_kind", F.lit(kind)).select(*columns) for kind, b in (("full", whole), ("partial", budget))]
    failed = routed.where("_kind = 'failed'").select(F.col(key).cast("string").alias(key), F.lit("failed").alias("map_kind"))
    return ways[0].unionByName(ways[1]).unionByName(failed, allowMissingColumns=True)


def sampled_schema(stream: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, types, observed, nullable, required, example, distinct_values): what the whole stream showed, with the sample's values.

    Both sides are profiles. Types are those of either; counts, and whether a path is required, are
    those of all records seen, not only of the sampled ones.
    """
    drawn = sample.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("path").alias("_path"), F.col("types").alias("_types"), F.col("nullable").alias("_nullable"), F.col("example").alias("_example"), F.col("distinct_values").alias("_values"))
    on = [stream[k].eqNullSafe(drawn[f"_{k}"]) for k in keys] + [stream["path"] == drawn["_path"]]
    both = stream.join(drawn, on, "full")
    kinds = F.array_union(F.coalesce("types", F.array().cast("array<string>")), F.coalesce("_types", F.array().cast("array<string>")))
    types = F.filter(F.array(*[F.lit(t) for t in TYPE_ORDER]), lambda t: F.array_contains(kinds, t))
    return both.select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys],
        F.coalesce("path", "_path").alias("path"),
        types.alias("types"),
        F.coalesce("observed", F.lit(0)).alias("observed"),
        (F.coalesce("nullable", F.lit(False)) | F.coalesce("_nullable", F.lit(False))).alias("nullable"),
        F.coalesce("required", F.lit(False)).alias("required"),
        F.col("_example").alias("example"),
        F.col("_values").alias("distinct_values"),
    )


def schema_payloads(roots: DataFrame, fields: DataFrame) -> DataFrame:
    """(artifact_id, root_key, payload): the schema of each root as one structure, fields in order of their paths, the last delivery of each counting."""
    last = lambda df, keys, columns: df.groupBy(*keys).agg(F.max_by(F.struct(*columns), "ingested_at").alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in columns])
    root = last(roots, ["artifact_id", "root_key"], ["root_path", "schema_version", "schema_hash", "mode", "completeness", "observed_records"])
    field = last(fields, ["artifact_id", "root_key", "field_path"], ["types", "nullable", "required", "observed_count", "example_value", "distinct_values", "cardinality"])
    rows = F.array_sort(F.collect_list(F.struct("field_path", "types", "nullable", "required", "observed_count", "example_value", "distinct_values", "cardinality")))
    listed = field.groupBy("artifact_id", "root_key").agg(rows.alias("fields"))
    empty = F.expr("cast(array() as array<struct<field_path:string,types:string,nullable:int,required:int,observed_count:bigint,example_value:string,distinct_values:string,cardinality:int>>)")
    both = root.join(listed, ["artifact_id", "root_key"], "left")
    return both.select("artifact_id", "root_key", F.struct("root_path", "schema_version", "schema_hash", "mode", "completeness", "observed_records", F.coalesce("fields", empty).alias("fields")).alias("payload"))


def judged_results(artifacts: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` (artifact_id, generation, ...) with ``outcome``: accepted, stale, settled or unknown.

    A result is accepted only if it was made from the artifact's present generation while that still
    waited for one; so of two workers the later cannot overwrite what the catalog moved on from.
    """
    now = artifacts.select("artifact_id", F.lit(True).alias("_there"), F.col("generation").alias("_now"), F.col("map_status").alias("_status"))
    both = results.join(now, "artifact_id", "left")
    outcome = F.when(F.col("_there").isNull(), "unknown").when(~F.col("generation").eqNullSafe(F.col("_now")), "stale").when(F.col("_status") == "pending", "accepted").otherwise("settled")
    return both.withColumn("outcome", outcome).drop("_there", "_now", "_status")


def persisted(artifacts: DataFrame, judged: DataFrame) -> DataFrame:
    """The catalog after the accepted results: their artifacts are ``ready``."""
    done = judged.where("outcome = 'accepted'").select("artifact_id").distinct().withColumn("_done", F.lit(True))
    return artifacts.join(done, "artifact_id", "left").withColumn("map_status", F.when(F.col("_done"), "ready").otherwise(F.col("map_status"))).drop("_done")
