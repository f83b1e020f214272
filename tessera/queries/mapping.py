"""Queries of mapping and of code over several artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, code, mapping, profile
from tessera.queries.profiles import NODES, TYPE
from tessera.queries.registry import ENVELOPES, Registry, envelopes
from tessera.session import table

R = Registry()
V = "with a as (select * exclude (n) from (select *, row_number() over (partition by artifact_id order by generation desc, ingested_at desc) n from artifacts) where n = 1) "


@R("m1_route", "select distinct payload_hash_full, case when payload_json_bytes is null or payload_json_bytes > 20000 then 'failed' when coalesce(contains_binary_refs, 0) > 0 or payload_json_bytes > 2000 then 'partial' else 'full' end map_kind from payload_blobs")
def m1_route(spark: SparkSession, sf: str) -> DataFrame:
    """Which way every payload would be mapped, with limits that send some each way."""
    kind = mapping.route(F.col("payload_json_bytes"), F.col("contains_binary_refs") > 0, full=2000, memory=20_000)
    return table(spark, sf, "payload_blobs").select("payload_hash_full", kind.alias("map_kind")).distinct()


@R("m1_mapped", ENVELOPES + "select payload_hash_full, case when octet_length(encode(j::varchar)) > 2000 then 'partial' else 'full' end map_kind, json_array_length(j, '$.content')::bigint elements from e")
def m1_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Every envelope mapped as a whole or in part, by its size."""
    rows = envelopes(spark, sf).withColumn("size", F.octet_length("envelope"))
    out = mapping.mapped(rows, "payload_hash_full", "envelope", F.col("size"), F.lit(False), full=2000)
    return out.where("root_path = '$.content'").select("payload_hash_full", "map_kind", "elements")


@R(
    "m4_sampled_schema",
    NODES
    + ", k as (select distinct a, rp, i, path, " + TYPE.format(t="json_type(v)") + " kind from n where path <> '$') "
    "select rp root_path, path, list_filter(['null', 'boolean', 'number', 'string', 'array', 'object'], lambda x: list_contains(list(distinct kind), x)) types, count(distinct {'a': a, 'i': i})::bigint observed, "
    "bool_or(kind = 'null') nullable, count(distinct {'a': a, 'i': i}) = any_value(total) required, count(case when i < 5 then 1 end) > 0 sampled from k join total using (rp) group by 1, 2",
)
def m4_sampled_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The schema of every root path: counts of all records, values of a sample."""
    rows = table(spark, sf, "artifact_records")
    out = mapping.sampled_schema(profile.record_profile(rows), profile.record_profile(rows.where("idx < 5")), ["root_path"])
    return out.select("root_path", "path", "types", "observed", "nullable", "required", F.col("example").isNotNull().alias("sampled"))


@R(
    "m15_schema_payloads",
    """with r as (select artifact_id, root_key, arg_max({'p': root_path, 'n': observed_records}, ingested_at) x from artifact_schema_roots group by 1, 2),
    f as (select artifact_id, root_key, field_path, arg_max(observed_count, ingested_at) n from artifact_schema_fields group by 1, 2, 3)
    select r.artifact_id, r.root_key, any_value(x.p) root_path, any_value(x.n) observed_records, count(field_path)::int n_fields, coalesce(string_agg(field_path || ':' || n, ',' order by field_path), '') fields
    from r left join f using (artifact_id, root_key) group by 1, 2""",
)
def m15_schema_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Every root's schema put together."""
    p = mapping.schema_payloads(table(spark, sf, "artifact_schema_roots"), table(spark, sf, "artifact_schema_fields"))
    names = F.array_join(F.transform("payload.fields", lambda f: F.concat(f["field_path"], F.lit(":"), f["observed_count"].cast("string"))), ",")
    return p.select("artifact_id", "root_key", "payload.root_path", "payload.observed_records", F.size("payload.fields").alias("n_fields"), names.alias("fields"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "artifacts").select("artifact_id", "generation").distinct()


@R("m16_guarded_results", V + "select g.artifact_id, g.generation, case when a.generation is distinct from g.generation then 'stale' when a.map_status = 'pending' then 'accepted' else 'settled' end outcome from (select distinct artifact_id, generation from artifacts) g join a using (artifact_id)")
def m16_guarded_results(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping results of every generation there was, judged by the present one."""
    now = catalog.valid_rows(table(spark, sf, "artifacts"))
    return mapping.judged_results(now, _results(spark, sf)).select("artifact_id", "generation", "outcome")


@R("snk5_persisted", V + "select artifact_id, case map_status when 'pending' then 'ready' else map_status end map_status from a")
def snk5_persisted(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog after the accepted ones of those results."""
    now = catalog.valid_rows(table(spark, sf, "artifacts"))
    return mapping.persisted(now, mapping.judged_results(now, _results(spark, sf))).select("artifact_id", "map_status")


_MULTI = """
def run(artifacts, schemas, params):
    key = params["key"]
    seen = {}
    for artifact, records in artifacts.items():
        for r in records:
            if isinstance(r, dict) and isinstance(r.get(key), str):
                seen.setdefault(r[key], set()).add(artifact)
    return [{"artifacts": len(artifacts), "values": len(seen), "shared": sum(len(a) > 1 for a in seen.values())}]
"""


@R(
    "j17_multi_artifact_code",
    """with d as (select distinct artifact_id, arg_max(session_id, (generation, ingested_at)) session_id from artifacts group by 1),
    r as (select artifact_id, min(record)::json j from artifact_records where json_valid(record) group by artifact_id, root_path, idx),
    x as (select session_id, artifact_id, case when json_type(j, '$.name') = 'VARCHAR' then j->>'$.name' end v from r join d using (artifact_id)),
    s as (select session_id, v, count(distinct artifact_id) n from x where v is not null group by 1, 2)
    select session_id, (select count(distinct artifact_id) from x y where y.session_id is not distinct from t.session_id)::bigint artifacts, count(v)::bigint "values", count(case when n > 1 then 1 end)::bigint shared
    from (select distinct session_id from x) t left join s using (session_id) group by session_id""",
)
def j17_multi_artifact_code(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's Python over all artifacts of a session together: values that several of them have."""
    of = catalog.valid_rows(table(spark, sf, "artifacts")).select("artifact_id", "session_id")
    rows = table(spark, sf, "artifact_records").where(F.try_parse_json("record").isNotNull()).groupBy("artifact_id", "root_path", "idx").agg(F.min("record").alias("record"))
    items = code.run_grouped(rows.join(of, "artifact_id"), _MULTI, ["session_id"], {"key": "name"}, order=("artifact_id", "root_path", "idx"))
    number = lambda n: F.get_json_object("item", f"$.{n}").cast("bigint").alias(n)
    return items.where("error is null").select("session_id", number("artifacts"), number("values"), number("shared"))


@R(
    "x9_code_targets",
    """with t as (select artifact_id, case when substr(artifact_id, 5, 1) < '8' then '$' else min(root_path) end root_path from artifact_records group by 1),
    r as (select artifact_id, root_path, idx from artifact_records join t using (artifact_id, root_path) where json_valid(record) group by all) select artifact_id, count(*)::bigint n from r group by 1""",
)
def x9_code_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Code on the records of target roots: ``$`` for some artifacts, their own first root for the others."""
    rows = table(spark, sf, "artifact_records")
    own = rows.groupBy("artifact_id").agg(F.min("root_path").alias("first"))
    roots = own.select("artifact_id", F.when(F.substring("artifact_id", 5, 1) < "8", "$").otherwise(F.col("first")).alias("root_path"))
    valid = rows.where(F.try_parse_json("record").isNotNull()).groupBy("artifact_id", "root_path", "idx").agg(F.min("record").alias("record"))
    items = code.run_grouped(code.targets(valid, roots), "def run(data, schema, params):\n    return len(data)", ["artifact_id"])
    return items.where("error is null").select("artifact_id", F.col("item").cast("bigint").alias("n"))


QUERIES, ORACLE = R.queries, R.sql
