"""Captures in and tables out: payload text to envelopes, artifacts, records; idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical
from tessera.functions.variants import elements, parse_or_text, type_name
from tessera.sources.store import Table


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of one file a payload."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_blobs(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, length[, content]) of binary files; without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", *(["content"] if content else []))


def read_dataset(spark: SparkSession, path: str, extract: str | None = None, values_of_object: bool = False) -> DataFrame:
    """(idx, v): the records of one JSON file, at a path in it, or the values of an object."""
    v = F.try_parse_json("text")
    rows = read_payloads(spark, path).select((F.try_variant_get(v, extract, "variant") if extract else v).alias("v"))
    if values_of_object:
        return rows.select(F.posexplode(F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))).alias("idx", "v"))
    return rows.select(F.posexplode(elements(F.col("v"))).alias("idx", "v"))


def capture(payloads: DataFrame, session_id: str, source_tool: str, text: str = "text") -> dict[str, DataFrame]:
    """The tables of new captures: payloads (by content), artifacts, records.

    Text that is no JSON is one text record. Ids are hashes of the content and its origin, so a
    capture that is repeated makes the same rows.
    """
    value = parse_or_text(F.col(text))
    rows = payloads.withColumn("v", value).withColumn("canonical", F.coalesce(canonical(F.col(text)), F.col(text))).withColumn("payload_hash_full", F.sha2("canonical", 256))
    rows = rows.withColumn("artifact_id", F.concat(F.lit("art_"), F.substring(F.sha2(F.concat_ws("|", F.lit(session_id), F.lit(source_tool), "path", "payload_hash_full"), 256), 1, 32)))
    blobs = rows.select("payload_hash_full", "canonical", F.octet_length("canonical").alias("payload_json_bytes")).dropDuplicates(["payload_hash_full"])
    artifacts = rows.select("artifact_id", F.lit(session_id).alias("session_id"), F.lit(source_tool).alias("source_tool"), "payload_hash_full", F.when(type_name(F.col("v")).isin("object", "array"), "full").otherwise("none").alias("map_kind"))
    records = rows.select("artifact_id", F.lit("$").alias("root_path"), F.posexplode(F.coalesce(elements(F.col("v")), F.array("v"))).alias("idx", "x")).select("artifact_id", "root_path", "idx", F.to_json("x").alias("record"))
    return {"payload_blobs": blobs, "artifacts": artifacts, "artifact_records": records}


def persist(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Store new captures: payloads by content, then artifacts, then records, each only where it is not there yet."""
    keys = {"payload_blobs": ["payload_hash_full"], "artifacts": ["artifact_id"], "artifact_records": ["artifact_id", "root_path", "idx"]}
    for name, own in keys.items():
        Table(spark, f"{folder}/{name}").append_absent(tables[name], own)


def persist_derived(spark: SparkSession, items: DataFrame, folder: str, parents: list[str], kind: str, expression: str) -> str:
    """Store a query's result as an artifact of its own with the edges to its parents; returns its id."""
    import hashlib
    import json

    request = json.dumps({"parents": sorted(set(parents)), "kind": kind, "expression": expression}, sort_keys=True)
    artifact = "art_" + hashlib.sha256(request.encode()).hexdigest()[:32]
    items.withColumn("artifact_id", F.lit(artifact)).write.mode("overwrite").parquet(f"{folder}/records/{artifact}")
    edges = spark.createDataFrame([(artifact, p, i) for i, p in enumerate(dict.fromkeys(parents))], "artifact_id string, parent_artifact_id string, ord int")
    Table(spark, f"{folder}/lineage").append_absent(edges, ["artifact_id", "parent_artifact_id"])
    return artifact


def write_manifest(manifest: DataFrame, path: str, form: str = "csv") -> None:
    """A blob manifest as CSV (lists joined with ``;``) or JSON."""
    if form == "csv":
        manifest.write.mode("overwrite").option("header", True).csv(path)
    else:
        manifest.write.mode("overwrite").json(path)
