"""Queries of schema inference, sampling, envelopes, pagination and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, redaction, text
from tessera.functions.variants import at, elements, once, parse_or_text, text_as_json, type_name
from tessera.operators import pages, profile, sampling
from tessera.queries.registry import ENVELOPES, RECORDS, Registry, envelopes, records
from tessera.session import spread, table

R = Registry()
KEY = ["artifact_id", "root_path", "idx"]
TYPE = "case {t} when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end"


@R(
    "a5_fields_top",
    RECORDS + ", d as (select * from r where idx < 50 and json_type(j) = 'OBJECT'), k as (select root_path, j, unnest(json_keys(j)) f from d) select root_path, f field, " + TYPE.format(t="json_type(j, '$.\"' || f || '\"')") + " as type, count(*)::bigint n from k group by all",
)
def a5_fields_top(spark: SparkSession, sf: str) -> DataFrame:
    return profile.fields_top(records(spark, sf), ["root_path"])


@R(
    "a6_inventory",
    RECORDS + "select artifact_id, root_path, count(distinct idx)::bigint records, count(case when json_type(j) = 'OBJECT' then 1 end)::bigint objects, max(idx)::int last_idx from r group by 1, 2",
)
def a6_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    return rows.groupBy("artifact_id", "root_path").agg(F.countDistinct("idx").alias("records"), F.count(F.when(type_name(F.col("v")) == "object", 1)).alias("objects"), F.max("idx").alias("last_idx"))


#: Every value below a record's root: path, value and where it comes in the order of sorted names.
NODES = r"""with recursive r as (select distinct artifact_id a, root_path rp, idx i, record t, record::json j from artifact_records where json_valid(record)),
n as (
  select a, rp, i, t, '$' path, j v, []::varchar[] ord from r
  union all
  select a, rp, i, t, n.path || case when json_type(v) = 'ARRAY' then '[*]' when regexp_full_match(e.key, '[A-Za-z_][A-Za-z0-9_]*') then '.' || e.key else '[''' || replace(replace(e.key, '\', '\\'), '''', '\''') || ''']' end,
    e.value, list_append(ord, case when json_type(v) = 'ARRAY' then lpad(e.key, 9, '0') else e.key end)
  from n, json_each(case when json_type(v) in ('OBJECT', 'ARRAY') then v else '[]'::json end) e),
total as (select rp, count(distinct {'a': a, 'i': i}) total from r group by 1)
"""


@R(
    "a7_path_profile",
    NODES
    + "select rp root_path, path, list_filter(['null', 'boolean', 'number', 'string', 'array', 'object'], lambda x: list_contains(kinds, x)) types, observed, nullable, observed = total required from ("
    + "select rp, path, list(distinct " + TYPE.format(t="json_type(v)") + ") kinds, count(distinct {'a': a, 'i': i})::bigint observed, bool_or(json_type(v) = 'NULL') nullable from n where path <> '$' group by 1, 2) join total using (rp)",
)
def a7_path_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of the records of every root with its types and how many records have it (M3)."""
    return profile.record_profile(table(spark, sf, "artifact_records")).select("root_path", "path", "types", "observed", "nullable", "required")


@R(
    "a9_first_values",
    NODES + ", f as (select rp, path, arg_min(v, {'a': a, 'i': i, 't': t, 'o': ord}) v from n where path <> '$' and json_type(v) not in ('OBJECT', 'ARRAY') group by 1, 2) "
    "select rp root_path, path, case when json_type(v) in ('VARCHAR', 'BOOLEAN', 'NULL') then '[' || v::varchar || ']' end \"values\", case when json_type(v) not in ('VARCHAR', 'BOOLEAN', 'NULL') then (v->>'$')::double end number, 1 cardinality from f",
)
def a9_first_values(spark: SparkSession, sf: str) -> DataFrame:
    """The first scalar of every path, by artifact, index and sorted names."""
    found = profile.record_profile(table(spark, sf, "artifact_records")).where("cardinality is not null")
    number = F.regexp_extract("distinct_values", r"^\[(-?[0-9].*)\]$", 1).try_cast("double")
    return found.select("root_path", "path", F.when(number.isNull(), F.col("distinct_values")).alias("values"), number.alias("number"), "cardinality")


@R("a10_merged_profile", NODES + ", k as (select distinct a, rp, i, path, " + TYPE.format(t="json_type(v)") + " kind from n where path <> '$') select path, list_filter(['null', 'boolean', 'number', 'string', 'array', 'object'], lambda x: list_contains(list(distinct kind), x)) types, count(distinct {'a': a, 'r': rp, 'i': i})::bigint observed, bool_or(kind = 'null') nullable from k group by 1")
def a10_merged_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profiles of all roots as one."""
    return profile.merged_profile(profile.record_profile(table(spark, sf, "artifact_records")), []).drop("example")


@R("m13_schema_hash", "with f as (select distinct artifact_id, root_key, field_path, types from artifact_schema_fields where types is not null) select artifact_id, root_key, 'sha256:' || sha256('[' || string_agg('{\"path\":' || to_json(field_path) || ',\"types\":' || to_json(types) || '}', ',' order by '{\"path\":' || to_json(field_path) || ',\"types\":' || to_json(types) || '}') || ']') schema_hash from f group by 1, 2")
def m13_schema_hash(spark: SparkSession, sf: str) -> DataFrame:
    return profile.schema_hash(table(spark, sf, "artifact_schema_fields").where("types is not null"), ["artifact_id", "root_key"], "field_path", "types")


@R("m14_alignment", "with e as (select artifact_id, root_path, max(observed_records) n from artifact_schema_roots group by 1, 2), h as (select artifact_id, root_path, list_sort(list(distinct idx)) i from artifact_records group by 1, 2) select artifact_id, root_path, len(i)::int present, i = list_transform(range(n), lambda x: x::int) aligned from e join h using (artifact_id, root_path) where n > 0")
def m14_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the stored indices are exactly those of the profile."""
    expected = table(spark, sf, "artifact_schema_roots").groupBy("artifact_id", "root_path").agg(F.max("observed_records").alias("n")).where("n > 0")
    # counts instead of lists: distinct indices from 0 to n-1 are aligned if there are n of them within the range
    there = table(spark, sf, "artifact_records").groupBy("artifact_id", "root_path").agg(F.countDistinct("idx").cast("int").alias("present"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return expected.join(there, ["artifact_id", "root_path"]).select("artifact_id", "root_path", "present", ((F.col("present") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("aligned"))


@R("m9_oversize", "select artifact_id, root_path, count(*)::bigint seen, count(case when octet_length(encode(record)) > 200 then 1 end)::bigint oversize, least(count(case when octet_length(encode(record)) <= 200 then 1 end), 100)::bigint sampled from (select distinct artifact_id, root_path, idx, record from artifact_records where record is not null) group by 1, 2")
def m9_oversize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "artifact_records").where("record is not null").select(*KEY, "record").distinct().withColumn("size", F.octet_length("record"))
    out = sampling.coverage(rows, ["artifact_id", "root_path"], "size", max_bytes=200)
    return out.select("artifact_id", "root_path", "seen", "oversize", F.col("sampled").cast("bigint").alias("sampled"))


@R("m6_reservoir")
def m6_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 100 records of every root, the same ones each time."""
    first = table(spark, sf, "artifact_records").where("record is not null").groupBy(*KEY).agg(F.min("record").alias("record"))
    rows = first.withColumn("size", F.octet_length("record")).withColumn("seed", F.sha2(F.concat_ws("|", "artifact_id", "root_path", F.lit("fp")), 256))
    return sampling.reservoir(rows, ["artifact_id", "root_path"], "idx", "size", "seed")


@R("m5_streamed_roots", ENVELOPES + "select payload_hash_full, '$.content' root_path, json_array_length(j, '$.content')::bigint elements, true closed, null::varchar stop_reason from e")
def m5_streamed_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Outermost arrays found in one pass over the text, with why the pass stopped where it did (SRC15, M10, M11)."""
    from tessera.operators.partial import map_payloads

    roots = map_payloads(envelopes(spark, sf), "payload_hash_full", "envelope")
    return roots.where("root_path = '$.content'").select("payload_hash_full", "root_path", "elements", "closed", "stop_reason")


@R("m12_collapsed", ENVELOPES.replace("with e as", "with recursive e as") + ", n as (select payload_hash_full k, j v, 0 d from e union all select k, x.value, d + 1 from n, json_each(case when json_type(v) = 'OBJECT' and d < 5 then v else '{}'::json end) x) select k payload_hash_full, sum(json_array_length(v))::bigint elements, 0::bigint oversize, true complete from n where json_type(v) = 'ARRAY' group by 1")
def m12_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """The roots of every payload laid end to end."""
    from tessera.operators.partial import collapsed, map_payloads

    one = collapsed(map_payloads(envelopes(spark, sf), "payload_hash_full", "envelope"), "payload_hash_full")
    return one.select("payload_hash_full", "elements", "oversize", "complete")


@R("m8_seed", "select distinct artifact_id, sha256(artifact_id || '|' || root_path || '|fp') seed from artifact_records")
def m8_seed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "artifact_records").select("artifact_id", F.sha2(F.concat_ws("|", "artifact_id", "root_path", F.lit("fp")), 256).alias("seed")).distinct()


@R("m11_sampled_kinds", RECORDS + "select root_path, count(*)::bigint counted, count(case when json_type(j) = 'OBJECT' then 1 end)::bigint samplable from r group by 1")
def m11_sampled_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy("root_path").agg(F.count(F.lit(1)).alias("counted"), F.count(F.when(type_name(F.col("v")) == "object", 1)).alias("samplable"))


@R("w4_offsets", "with w as (select artifact_id, root_path, max(observed_records) n from artifact_schema_roots group by 1, 2) select artifact_id, root_path, coalesce(sum(n) over (partition by artifact_id order by root_path rows between unbounded preceding and 1 preceding), 0)::bigint start from w")
def w4_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each root's records start when an artifact's roots are laid end to end."""
    from pyspark.sql import Window

    widths = table(spark, sf, "artifact_schema_roots").groupBy("artifact_id", "root_path").agg(F.max("observed_records").alias("n"))
    before = Window.partitionBy("artifact_id").orderBy("root_path").rowsBetween(Window.unboundedPreceding, -1)
    return widths.select("artifact_id", "root_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


@R("d7_leaf_roots", "with p as (select distinct artifact_id, root_path from artifact_schema_roots) select artifact_id, root_path from p where not exists (select 1 from p q where q.artifact_id = p.artifact_id and q.root_path <> p.root_path and (starts_with(q.root_path, p.root_path || '.') or starts_with(q.root_path, p.root_path || '[')))")
def d7_leaf_roots(spark: SparkSession, sf: str) -> DataFrame:
    return pages.leaf_roots(table(spark, sf, "artifact_schema_roots"), ["artifact_id"], "root_path")


@R("a15_estimate_records", ENVELOPES + ", v as (select payload_hash_full, j->'$.content[0].value' v from e) select payload_hash_full, (case when json_type(v) = 'ARRAY' then json_array_length(v) when json_type(v, '$.data') = 'ARRAY' then json_array_length(v, '$.data') when json_type(v, '$.results') = 'ARRAY' then json_array_length(v, '$.results') when json_type(v, '$.items') = 'ARRAY' then json_array_length(v, '$.items') end)::int n from v where json_type(v) = 'ARRAY' or json_type(v, '$.data') = 'ARRAY' or json_type(v, '$.results') = 'ARRAY' or json_type(v, '$.items') = 'ARRAY'")
def a15_estimate_records(spark: SparkSession, sf: str) -> DataFrame:
    """The number of records a response holds."""
    rows = envelopes(spark, sf).withColumn("n", pages.record_count(at(F.col("v"), "$.content[0].value")))
    return rows.where("n is not null").select("payload_hash_full", "n")


@R("a16_cardinality", ENVELOPES + ", v as (select payload_hash_full, j->'$.content[0].value' v from e where json_type(j, '$.content[0].value') is not null) select payload_hash_full, " + TYPE.format(t="json_type(v)") + " root_type, (case json_type(v) when 'ARRAY' then json_array_length(v) when 'OBJECT' then len(json_keys(v)) end)::int n from v where json_type(v) in ('ARRAY', 'OBJECT')")
def a16_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    v = at(F.col("v"), "$.content[0].value")
    rows = envelopes(spark, sf).select("payload_hash_full", type_name(v).alias("root_type"), F.coalesce(F.size(elements(v)), F.size(F.when(type_name(v) == "object", F.json_object_keys(F.to_json(v))))).alias("n"))
    return rows.where("root_type in ('array', 'object')")


@R("src3_json_or_text", "select doc_id, case when json_valid(text) then " + TYPE.format(t="json_type(text)") + " else 'string' end kind from documents where text is not null")
def src3_json_or_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by what they parse to, text if they are no JSON."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", type_name(parse_or_text(F.col("text"))).alias("kind"))


@R("src5_envelope_faults", ENVELOPES + "select payload_hash_full, j->>'$.status' status, (j->>'$.status' = 'error') <> (coalesce(json_type(j, '$.error'), 'NULL') <> 'NULL') bad_error from e")
def src5_envelope_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes whose status and error block contradict each other."""
    error = at(F.col("v"), "$.error")
    status = F.try_variant_get("v", "$.status", "string")
    return envelopes(spark, sf).select("payload_hash_full", status.alias("status"), ((status == "error") != F.coalesce(~F.is_variant_null(error), F.lit(False))).alias("bad_error"))


@R("src6_reserved_args", "select doc_id, case when source is null then '{}' else json_object('source', source) end::varchar args from documents")
def src6_reserved_args(spark: SparkSession, sf: str) -> DataFrame:
    """A call's arguments without those kept for the gateway."""
    args = F.map_filter(F.create_map(F.lit("_gateway_context"), F.lit("x"), F.lit("source"), F.col("source"), F.lit("_gateway_chain"), F.col("lang")), lambda k, v: v.isNotNull())
    return table(spark, sf, "documents").select("doc_id", F.to_json(text.without_reserved(args)).alias("args"))


@R("src7_oversize_parts", ENVELOPES + "select payload_hash_full, (length(j->>'$.content[0].value') > 1000) oversize from e where json_type(j, '$.content[0].type') = 'VARCHAR' and j->>'$.content[0].type' = 'json'")
def src7_oversize_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = F.get_json_object("envelope", "$.content[0].value")
    return envelopes(spark, sf).where(F.get_json_object("envelope", "$.content[0].type") == "json").select("payload_hash_full", (F.length(part) > 1000).alias("oversize"))


@R("src8_first_json_part", ENVELOPES + ", p as (select payload_hash_full, generate_subscripts(l, 1) - 1 i, unnest(l) x from (select payload_hash_full, (j->'$.content')::json[] l from e)) select payload_hash_full, min(i)::int part from p where x->>'$.type' = 'json' or (x->>'$.type' = 'text' and json_valid(x->>'$.text') and json_type(x->>'$.text') in ('OBJECT', 'ARRAY')) group by 1")
def src8_first_json_part(spark: SparkSession, sf: str) -> DataFrame:
    """The first part of an envelope that can be queried: JSON, or text that holds it (SRC9)."""
    parts = envelopes(spark, sf).select("payload_hash_full", F.posexplode(elements(at(F.col("v"), "$.content"))).alias("i", "x"))
    kind = F.try_variant_get("x", "$.type", "string")
    usable = (kind == "json") | ((kind == "text") & text_as_json(F.try_variant_get("x", "$.text", "string")).isNotNull())
    return parts.where(usable).groupBy("payload_hash_full").agg(F.min("i").alias("part"))


@R("src10_best_part", ENVELOPES + ", p as (select payload_hash_full, generate_subscripts(l, 1) - 1 i, unnest(l) x from (select payload_hash_full, (j->'$.content')::json[] l from e)) select payload_hash_full, arg_max(i, (json_array_length(case when json_type(x, '$.value') = 'ARRAY' then x->'$.value' else '[]'::json end), -i))::int part from p where x->>'$.type' = 'json' group by 1")
def src10_best_part(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON part with most elements, the first of equals."""
    parts = envelopes(spark, sf).select("payload_hash_full", F.posexplode(elements(at(F.col("v"), "$.content"))).alias("i", "x")).where(F.try_variant_get("x", "$.type", "string") == "json")
    size = F.coalesce(F.size(elements(at(F.col("x"), "$.value"))), F.lit(0))
    return parts.groupBy("payload_hash_full").agg(F.max_by("i", F.struct(size, -F.col("i"))).alias("part"))


@R("src12_mime", "select distinct mime, case lower(trim(split_part(mime, ';', 1))) when 'image/jpg' then 'image/jpeg' else lower(trim(split_part(mime, ';', 1))) end normal, lower(trim(split_part(mime, ';', 1))) = 'application/json' is_json, case lower(trim(split_part(mime, ';', 1))) when 'image/jpg' then '.jpg' when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'application/pdf' then '.pdf' when 'text/csv' then '.csv' when 'application/json' then '.json' else '.bin' end ending from binary_blobs")
def src12_mime(spark: SparkSession, sf: str) -> DataFrame:
    """Media types, whether they are JSON, and the file ending (SRC11, S38)."""
    m = F.col("mime")
    return table(spark, sf, "binary_blobs").select("mime", text.normal_mime(m).alias("normal"), text.is_json_mime(m).alias("is_json"), text.extension(m).alias("ending")).distinct()


@R("s38_file_names", "select distinct blob_id, mime, regexp_replace(coalesce(mime, '') || ' ' || blob_id, '[^A-Za-z0-9._-]+', '_', 'g') || case lower(trim(split_part(mime, ';', 1))) when 'image/jpg' then '.jpg' when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'application/pdf' then '.pdf' when 'text/csv' then '.csv' when 'application/json' then '.json' else '.bin' end as name from binary_blobs")
def s38_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that any file system takes, with the ending of the media type."""
    title = F.concat(F.coalesce("mime", F.lit("")), F.lit(" "), F.col("blob_id"))
    return table(spark, sf, "binary_blobs").select("blob_id", "mime", text.safe_filename(title, F.col("mime")).alias("name")).distinct()


@R("src19_artifact_refs", "select doc_id, regexp_extract(text, '(art_[0-9a-f]{8})', 1) ref from documents where regexp_matches(text, 'art_[0-9a-f]{8}')")
def src19_artifact_refs(spark: SparkSession, sf: str) -> DataFrame:
    """The first artifact a text names."""
    return table(spark, sf, "documents").where(F.rlike("text", F.lit("art_[0-9a-f]{8}"))).select("doc_id", F.regexp_extract("text", "(art_[0-9a-f]{8})", 1).alias("ref"))


@R(
    "src18_resolve_refs",
    """with a as (select artifact_id, payload_hash_full from (select *, row_number() over (partition by artifact_id order by generation desc, ingested_at desc) n from artifacts) where n = 1),
    e as (select payload_hash_full, arg_min(envelope, (ingested_at, envelope))::json j from payload_blobs where json_valid(envelope) and json_type(envelope, '$.content') = 'ARRAY' group by 1)
    select doc_id, artifact_id, case when doc_id % 2 = 0 then '$.tool' end path, case when doc_id % 2 = 0 then j->>'$.tool' end as value from documents join a using (artifact_id) join e using (payload_hash_full) where regexp_full_match(artifact_id, 'art_[0-9a-f]{32}')""",
)
def src18_resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References to artifacts, half of them with a path, and the values they lead to (SRC19)."""
    refs = table(spark, sf, "documents").select("doc_id", text.artifact_ref(F.concat("artifact_id", F.when(F.col("doc_id") % 2 == 0, ":$.tool").otherwise(""))).alias("ref")).where("ref is not null")
    now = table(spark, sf, "artifacts").groupBy("artifact_id").agg(F.max_by("payload_hash_full", F.struct("generation", "ingested_at")).alias("payload_hash_full"))
    held = refs.select("doc_id", "ref.artifact_id", "ref.path").join(now, "artifact_id").join(envelopes(spark, sf), "payload_hash_full")
    return held.select("doc_id", "artifact_id", "path", F.expr("get_json_object(to_json(v), path)").alias("value"))


@R("snk9_payload_sizes", "select payload_hash_full, payload_json_bytes + payload_binary_bytes_total total, payload_json_bytes + payload_binary_bytes_total = payload_total_bytes adds_up from payload_blobs")
def snk9_payload_sizes(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("payload_json_bytes") + F.col("payload_binary_bytes_total")
    return table(spark, sf, "payload_blobs").select("payload_hash_full", total.alias("total"), (total == F.col("payload_total_bytes")).alias("adds_up"))


@R("snk10_inline_mode", "select payload_hash_full, case when payload_json_bytes > 2000 then 'minimal' else 'full' end as mode from payload_blobs")
def snk10_inline_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an envelope is answered in full or by reference."""
    return table(spark, sf, "payload_blobs").select("payload_hash_full", F.when(F.col("payload_json_bytes") > 2000, "minimal").otherwise("full").alias("mode"))


@R("src13_integrity", "select payload_hash_full, envelope is not null and json_valid(envelope) readable from payload_blobs")
def src13_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "payload_blobs").select("payload_hash_full", F.try_parse_json("envelope").isNotNull().alias("readable"))


@R("s8_canonical_hash")
def s8_canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of the canonical form of every record: equal for different serialisations."""
    return spread(table(spark, sf, "artifact_records").select(*KEY, "record")).select(*KEY, canonical.canonical_hash(F.col("record")).alias("record_hash"))


@R("s4_shapes")
def s4_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of each structure there are."""
    return spread(table(spark, sf, "artifact_records").select(*KEY, "record")).select(canonical.shape_of(F.col("record")).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@R("nav_p18_resolved")
def p18_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the JSON inside their strings expanded."""
    return spread(table(spark, sf, "artifact_records").select(*KEY, "record")).select(*KEY, canonical.resolved(F.col("record")).alias("record"))


_IDENT = "regexp_full_match({c}, '[A-Za-z_][A-Za-z0-9_]*')"


@R("s2_path_step", f"select distinct k, case when {_IDENT.format(c='k')} then '.' || k else '[''' || replace(replace(k, '\\', '\\\\'), '''', '\\''') || ''']' end step from (select unnest(json_keys(record)) k from artifact_records where json_valid(record) and json_type(record) = 'OBJECT')")
def s2_path_step(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "artifact_records").select(F.explode(F.json_object_keys(F.when(F.try_parse_json("record").isNotNull(), F.col("record")))).alias("k")).distinct()
    return keys.select("k", text.path_step(F.col("k")).alias("step"))


@R("s7_truncate", "select doc_id, case when length(text) > 30 then '[' || left(text, 30) || '](' || (length(text) - 30) || ' more chars truncated)' else text end short from documents")
def s7_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.truncated(F.col("text")).alias("short"))


@R("s11_sha", "select doc_id, substr(sha256(text), 1, 32) h from documents where text is not null")
def s11_sha(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.short_hash(F.col("text"), 32).alias("h"))


@R("s12_base64url", "select artifact_id, rtrim(translate(base64(encode(artifact_id)), '+/', '-_'), '=') b from (select distinct artifact_id from artifacts)")
def s12_base64url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "artifacts").select("artifact_id", text.base64url(F.col("artifact_id").cast("binary")).alias("b")).distinct()


_SECRETS = "' https://h/p?access_token=t' || doc_id || 'x&x=1 Authorization: Bearer abcdef' || doc_id || ' sk_live_12345678' || doc_id || ' ghp_123456789012345678901234 github_pat_12345678901234567890 xoxb-1234567890 EAabcdefghij1234567890'"


def _redacted(c: str) -> str:
    for kept, secret in redaction.PATTERNS:
        c = f"regexp_replace({c}, '{kept}{secret}', '\\1[REDACTED_SECRET]', '{'gi' if kept.startswith('(?i)') else 'g'}')".replace("(?i)", "")
    return c


@R("s14_redact", f"with d as (select doc_id, coalesce(text, '') || {_SECRETS} t from documents) select doc_id, case when octet_length(encode(t)) <= 32768 then md5({_redacted('t')}) else md5(t) end as text_md5, case when octet_length(encode(t)) <= 32768 then 7 else 0 end::int n from d")
def s14_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of seven kinds behind every document's whole text are all replaced; texts over the scan limit stay."""
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.expr("coalesce(text, '') || " + _SECRETS).alias("t"))
    return rows.select("doc_id", F.md5(redaction.redact(F.col("t"))).alias("text_md5"), redaction.secrets(F.col("t")).cast("int").alias("n"))


@R("s20_redact_json", "select artifact_id, root_path, idx, 'Bearer [REDACTED_SECRET]' secret, '{\"c\":\"sk [REDACTED_SECRET]\"}' inner_text, true same from artifact_records where json_valid(record)")
def s20_redact_json(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets beside every record in a tree, also in JSON inside a string, are replaced; the record stays as it is."""
    rows = spread(table(spark, sf, "artifact_records").where(F.try_parse_json("record").isNotNull()).select(*KEY, "record"))
    tree = F.concat(F.lit('{"a":"Bearer abcdef'), F.coalesce(F.col("idx").cast("string"), F.lit("")), F.lit('1","b":"{\\"c\\":\\"sk sk_live_12345678\\"}","r":'), F.col("record"), F.lit("}"))
    clean = rows.select(*KEY, "record", redaction.redact_json(tree).alias("clean")).select(*KEY, "record", once(F.parse_json("clean")).alias("v"))
    same = F.to_json(at(F.col("v"), "$.r")) == F.to_json(F.parse_json("record"))
    return clean.select(*KEY, F.try_variant_get("v", "$.a", "string").alias("secret"), F.try_variant_get("v", "$.b", "string").alias("inner_text"), same.alias("same"))


@R("s27_names", "select distinct source_tool, replace(replace(replace(replace(lower(trim(source_tool)), '-', ''), '_', ''), '.', ''), ' ', '') as name from artifacts")
def s27_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "artifacts").select("source_tool", text.normal_name(F.col("source_tool")).alias("name")).distinct()


@R("s28_url_query", "select doc_id, doc_id::varchar page, 'a b' q from documents")
def s28_url_query(spark: SparkSession, sf: str) -> DataFrame:
    q = text.query_parameters(F.concat(F.lit("https://host/p?q=x&page="), F.col("doc_id").cast("string"), F.lit("&q=a%20b")))
    return table(spark, sf, "documents").select("doc_id", q["page"].alias("page"), q["q"].alias("q"))


@R("s29_link_header", "select doc_id, 'https://h/p?page=' || (doc_id + 1) next_url from documents")
def s29_link_header(spark: SparkSession, sf: str) -> DataFrame:
    header = F.concat(F.lit('<https://h/p?page=1>; rel="first", <https://h/p?page='), (F.col("doc_id") + 1).cast("string"), F.lit('>; rel="next"'))
    return table(spark, sf, "documents").select("doc_id", text.link_next(header).alias("next_url"))


@R("s32_probe_hash", "select doc_id, sha256(encode(text)[1:16]) head, sha256(encode(text)[greatest(octet_length(encode(text)) - 15, 1):]) tail from documents where text is not null")
def s32_probe_hash(spark: SparkSession, sf: str) -> DataFrame:
    h = text.probe_hashes(F.col("text").cast("binary"), 16)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", h["head"].alias("head"), h["tail"].alias("tail"))


@R("s33_fts_tokens", "select doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))::int n from documents where text is not null")
def s33_fts_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.search import tokens

    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))


@R("s34_expiry", "select distinct artifact_id, created_at, created_at + interval 30 day expires from artifacts")
def s34_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "artifacts").select("artifact_id", "created_at", (F.col("created_at") + F.expr("interval 30 days")).alias("expires")).distinct()


@R("s36_cli_flags", "select doc_id, doc_id::varchar lim, 'b' mode from documents")
def s36_cli_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = text.cli_flags(F.concat(F.lit("run --mode a --limit="), F.col("doc_id").cast("string"), F.lit(" --mode b")))
    return table(spark, sf, "documents").select("doc_id", flags["limit"].alias("lim"), flags["mode"].alias("mode"))


@R("s37_primary_root", "with a as (select distinct artifact_id from artifacts), r as (select artifact_id, min(root_path) p from artifact_schema_roots group by 1) select artifact_id, coalesce(p, '$') root_path from a left join r using (artifact_id)")
def s37_primary_root(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "artifact_schema_roots").groupBy("artifact_id").agg(F.min("root_path").alias("p"))
    return table(spark, sf, "artifacts").select("artifact_id").distinct().join(roots, "artifact_id", "left").select("artifact_id", F.coalesce("p", F.lit("$")).alias("root_path"))


_CURSOR_TEXTS = ["", "null", " None ", "UNDEFINED", "string", "<cursor>", "cursor", "next_cursor", "..."]


@R("s40_placeholders", "select doc_id, c.\"at\"::int \"at\", c.\"at\" < 9 is_placeholder from documents, (select unnest(range(10)) \"at\") c where lang is not null")
def s40_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """Cursor values that callers write when they have none, beside a real one."""
    given = F.array(*map(F.lit, _CURSOR_TEXTS), F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")))
    rows = table(spark, sf, "documents").where("lang is not null").select("doc_id", F.posexplode(given).alias("at", "c"))
    return rows.select("doc_id", "at", text.placeholder_cursor(F.col("c")).alias("is_placeholder"))


QUERIES, ORACLE = R.queries, R.sql
