"""Queries of scalar functions and small navigation rules over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, text
from tessera.functions.variants import at, members, text_of, type_name
from tessera.operators import select
from tessera.operators.drift import normal_path
from tessera.queries import drift_sql
from tessera.queries.profiles import TYPE
from tessera.queries.registry import RECORDS, Registry, records
from tessera.session import spread, table

R = Registry()
KEY = ["artifact_id", "root_path", "idx"]


@R("nav_p2_canonical", drift_sql.PATHS.replace("artifact_id, root_key, types, list_transform", "artifact_id, root_key, field_path, types, list_transform") + "stepped as (select field_path, list_transform(names, lambda n: case when n = '[*]' then n when regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_]*') then '.' || n else '[''' || n || ''']' end) steps from raw) select distinct field_path, '$' || array_to_string(steps, '') path from stepped")
def nav_p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every way a path is written and its one normal form."""
    rows = table(spark, sf, "artifact_schema_fields").where("artifact_id is not null and root_key is not null and field_path is not null").select("field_path").distinct()
    return rows.select("field_path", normal_path("field_path").alias("path"))


@R("s10_decimal_parse", "select artifact_id, root_path, idx, json_valid(record) parses from artifact_records where record is not null")
def s10_decimal_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Which records the exact parser reads: numbers as decimals, no NaN and no infinities."""
    rows = spread(table(spark, sf, "artifact_records").where("record is not null").select(*KEY, "record"))
    return rows.select(*KEY, canonical.canonical(F.col("record")).isNotNull().alias("parses"))


@R("s30_visible_scalars", RECORDS + ", k as (select root_path, key, value v from r, json_each(case when json_type(j) = 'OBJECT' then j else '{}'::json end)) select root_path, key field, count(*)::bigint n from k where json_type(v) not in ('NULL', 'OBJECT', 'ARRAY', 'BOOLEAN') and trim(v->>'$') <> '' or json_type(v) = 'BOOLEAN' group by 1, 2")
def s30_visible_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """How often each top-level field shows something: no null, no blank text, no object or array."""
    rows = records(spark, sf).select("root_path", F.explode(members(F.col("v"))).alias("field", "x"))
    return rows.where(text.visible_scalar(type_name(F.col("x")), F.coalesce(text_of(F.col("x")), F.lit("")))).groupBy("root_path", "field").agg(F.count(F.lit(1)).alias("n"))


@R("s31_coerced", """select doc_id, kind, case when kind = 'number' then doc_id::varchar when kind = 'boolean' and doc_id % 2 = 0 then 'true' when kind = 'boolean' then '"' || 'yes' || '"' else '"' || coalesce(lang, '') || '"' end json from documents, (select unnest(['number', 'boolean', 'string']) kind) k""")
def s31_coerced(spark: SparkSession, sf: str) -> DataFrame:
    """Query values in the type of an example: a number, a flag that fits or not, a text."""
    key = F.col("doc_id").cast("string")
    raw = F.when(F.col("kind") == "number", key).when(F.col("kind") == "boolean", F.when(F.col("doc_id") % 2 == 0, "TRUE").otherwise("yes")).otherwise(F.coalesce("lang", F.lit("")))
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.array(*map(F.lit, ("number", "boolean", "string")))).alias("kind"))
    return rows.select("doc_id", "kind", text.coerced_like(raw, F.col("kind")).alias("json"))


@R("s39_truncated_bytes", "select doc_id, left(text, list_max(list_filter(range(0, 41), lambda k: octet_length(encode(left(text, k))) <= 40))::int) short from documents where text is not null")
def s39_truncated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut to 40 bytes, never within a character."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.truncated_bytes(F.col("text"), 40).alias("short"))


@R(
    "u2_collected",
    RECORDS + ", m as (select artifact_id, root_path, idx, json_extract(j, '$.runways') x from r) "
    "select artifact_id, root_path, idx, e.key::int pos, e.value::varchar item from m, json_each(x) e where json_type(x) = 'ARRAY' union all select artifact_id, root_path, idx, 0, x::varchar from m where x is not null and json_type(x) <> 'ARRAY'",
)
def u2_collected(spark: SparkSession, sf: str) -> DataFrame:
    """What a code query gets at a path: the elements of the one match that is a list, else the matches."""
    return select.collected(records(spark, sf), KEY, "v", "$.runways").select(*KEY, "pos", F.to_json("item").alias("item"))


@R("u6_values_of_objects", RECORDS + "select artifact_id, root_path, idx, e.key as name, e.value::varchar item from r, json_each(case when json_type(j, '$.address') = 'OBJECT' then json_extract(j, '$.address') else '{}'::json end) e")
def u6_values_of_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The values of an object as rows, with their names."""
    rows = records(spark, sf).select(*KEY, F.explode(members(at(F.col("v"), "$.address"))).alias("name", "x"))
    return rows.select(*KEY, "name", F.to_json("x").alias("item"))


@R("src17_samples", "with a as (select artifact_id, arg_max(map_kind, (generation, ingested_at)) k from artifacts group by 1), s as (select artifact_id, root_path, idx, min(record) record from artifact_records join a using (artifact_id) where k = 'partial' and record is not null group by 1, 2, 3) select artifact_id, root_path, idx, row_number() over (partition by artifact_id, root_path order by idx)::bigint place from s")
def src17_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The samples of captures that were mapped in part, in order of their index."""
    from tessera.operators.series import numbered

    kinds = table(spark, sf, "artifacts").groupBy("artifact_id").agg(F.max_by("map_kind", F.struct("generation", "ingested_at")).alias("k"))
    rows = table(spark, sf, "artifact_records").where("record is not null").join(kinds.where("k = 'partial'"), "artifact_id", "left_semi").select(*KEY).distinct()
    return numbered(rows, ["artifact_id", "root_path"], ["idx"], "place").select(*KEY, F.col("place").cast("bigint").alias("place"))


@R("t5_object_text", RECORDS + "select artifact_id, root_path, idx, " + TYPE.format(t="json_type(j, '$.address')") + " kind from r where json_type(j, '$.address') in ('OBJECT', 'ARRAY')")
def t5_object_text(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose field is an object or array: matched as its JSON text, which begins like one."""
    x = at(F.col("v"), "$.address")
    rows = records(spark, sf).select(*KEY, text_of(x).alias("t"), type_name(x).alias("kind"))
    return rows.where(F.startswith("t", F.lit("{")) | F.startswith("t", F.lit("["))).where("kind in ('object', 'array')").select(*KEY, "kind")


QUERIES, ORACLE = R.queries, R.sql
