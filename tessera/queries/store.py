"""Queries of catalog search, lineage, blobs and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, text
from tessera.functions.variants import at, once, type_name
from tessera.operators import catalog, lifecycle, pages, search
from tessera.operators.series import numbered
from tessera.queries.registry import ENVELOPES, RECORDS, Registry, envelopes, records
from tessera.session import spread, table

R = Registry()
VALID_BY = ("generation", "ingested_at")
#: The valid rows in SQL.
V = "with a as (select * exclude (n) from (select *, row_number() over (partition by artifact_id order by generation desc, ingested_at desc) n from artifacts) where n = 1) "
B = ", b as (select * exclude (n) from (select *, row_number() over (partition by binary_hash order by ingested_at, mime) n from binary_blobs) where n = 1) "
NOW = "2025-06-01 00:00:00"


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.valid_rows(table(spark, sf, "artifacts"))


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


_SEARCHES = {
    "f20_visible": ({}, "deleted_at is null"),
    "f20_include_deleted": ({"include_deleted": True}, "true"),
    "f20_kind_seq": ({"kind": "data", "created_seq_min": 400, "created_seq_max": 1400}, "deleted_at is null and kind = 'data' and created_seq between 400 and 1400"),
    "f20_capture_time": ({"capture_kind": "mcp_tool", "created_at_after": "2025-02-01", "created_at_before": "2025-04-01"}, "deleted_at is null and capture_kind = 'mcp_tool' and created_at > '2025-02-01' and created_at < '2025-04-01'"),
    "f21_status_error": ({"status": "error"}, "deleted_at is null and error_summary is not null"),
    "f21_status_ok": ({"status": "ok"}, "deleted_at is null and error_summary is null"),
    "f22_tool_prefix": ({"source_tool_prefix": "FORGE"}, "deleted_at is null and starts_with(lower(source_tool), 'forge.')"),
    "f20_binary_refs": ({"has_binary_refs": True}, "deleted_at is null and payload_binary_bytes_total > 0"),
    "f20_parent": ({"source_tool": "gateway.derive", "kind": "derived_query"}, "deleted_at is null and source_tool = 'gateway.derive' and kind = 'derived_query'"),
}
for _name, (_filters, _sql) in _SEARCHES.items():
    R.add(_name, lambda s, d, f=_filters: artifacts(s, d).where(search.conditions(f)).select("artifact_id", "created_seq"), V + f"select artifact_id, created_seq from a where {_sql}")

_ORDERS = {"created_seq_desc": "created_seq desc nulls last, artifact_id", "last_seen_desc": "last_referenced_at desc nulls last, artifact_id", "chain_seq_asc": "chain_seq asc nulls last, created_seq, artifact_id"}
for _name, _sql in _ORDERS.items():
    R.add(f"o8_{_name}", lambda s, d, o=_name: search.page(artifacts(s, d).where("deleted_at is null"), o, 20, 10).select("artifact_id", "chain_seq"), V + f"select artifact_id, chain_seq from a where deleted_at is null order by {_sql} limit 21 offset 10")

_TEXT = """, f as (select artifact_id, string_agg(field_path, ' ') field_names, string_agg(coalesce(example_value, ''), ' ') samples from (select distinct artifact_id, field_path, example_value from artifact_schema_fields) group by 1),
d as (select artifact_id, source_tool || ' ' || kind || ' ' || coalesce(field_names, '') || ' ' || coalesce(samples, '') t from a left join f using (artifact_id)),
w as (select artifact_id, list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from d),
c as (select artifact_id, len(w) dl, len(list_filter(w, lambda x: x = 'forge')) f0, len(list_filter(w, lambda x: starts_with(x, 'lab'))) f1, len(list_filter(w, lambda x: x = 'medal')) f2 from w),
s as (select count(*) n, avg(dl) avgdl, sum((f0 > 0)::int) d0, sum((f1 > 0)::int) d1, sum((f2 > 0)::int) d2 from c)
"""
_PART = "greatest(ln((n - {d} + 0.5) / ({d} + 0.5)), 1e-6) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The text each artifact is found by: tool, kind, names and examples of its fields (one schema wide)."""
    fields = table(spark, sf, "artifact_schema_fields").select("artifact_id", "field_path", "example_value").distinct()
    names = fields.groupBy("artifact_id").agg(F.array_join(F.collect_list("field_path"), " ").alias("field_names"), F.array_join(F.collect_list(F.coalesce("example_value", F.lit(""))), " ").alias("sample_values"))
    return artifacts(spark, sf).select("artifact_id", "source_tool", "kind").join(names, "artifact_id", "left")


@R("c1_bm25", V + _TEXT + f"select artifact_id, round(-({_PART.format(d='d0', f='f0')} + {_PART.format(d='d1', f='f1')}), 6) score from c, s where f0 > 0 and f1 > 0")
def c1_bm25(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.bm25(search_documents(spark, sf), "artifact_id", ["source_tool", "kind", "field_names", "sample_values"], "forge lab*")
    return hits.select("artifact_id", F.round("score", 6).alias("score"))


@R("c1_bm25_or", V + _TEXT + f"select artifact_id, round(-({_PART.format(d='d0', f='f0')} + {_PART.format(d='d2', f='f2')}), 6) score from c, s where f0 > 0 or f2 > 0")
def c1_bm25_or(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.bm25(search_documents(spark, sf), "artifact_id", ["source_tool", "kind", "field_names", "sample_values"], "forge OR medal")
    return hits.select("artifact_id", F.round("score", 6).alias("score"))


@R(
    "c1_phrases",
    V
    + """, f as (select artifact_id, string_agg(field_path, ' ') field_names, string_agg(coalesce(example_value, ''), ' ') samples from (select distinct artifact_id, field_path, example_value from artifact_schema_fields) group by 1),
    w as (select artifact_id, list_transform([source_tool, kind, coalesce(field_names, ''), coalesce(samples, '')], lambda t: list_filter(string_split_regex(lower(coalesce(t, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) w from a left join f using (artifact_id)),
    c as (select artifact_id, list_sum(list_transform(w, lambda x: len(x))) dl, len(list_filter(range(1, len(w[1])), lambda i: w[1][i] = 'forge' and w[1][i + 1] = 'list')) f0, len(list_filter(flatten(w), lambda x: x = 'derived')) f1, len(list_filter(w[1], lambda x: starts_with(x, 'med'))) f2 from w),
    s as (select count(*) n, avg(dl) avgdl, sum((f0 > 0)::int) d0, sum((f2 > 0)::int) d2 from c)
    """
    + "select artifact_id, round(-(" + _PART.format(d="d0", f="f0") + " + " + _PART.format(d="d2", f="f2") + "), 6) score from c, s where (f0 > 0 and f1 = 0) or f2 > 0",
)
def c1_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases, columns, exclusions and alternatives."""
    hits = search.bm25(search_documents(spark, sf), "artifact_id", ["source_tool", "kind", "field_names", "sample_values"], 'source_tool:"forge list" NOT derived OR source_tool:med*')
    return hits.select("artifact_id", F.round("score", 6).alias("score"))


@R("c2_search", V + _TEXT + ", x as (select artifact_id, round(-(" + _PART.format(d="d2", f="f2") + "), 6) score from c, s where f2 > 0) select artifact_id, score, created_seq from x join a using (artifact_id) where deleted_at is null order by score, created_seq desc limit 11")
def c2_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text search joined with the catalog, best first."""
    hits = search.bm25(search_documents(spark, sf), "artifact_id", ["source_tool", "kind", "field_names", "sample_values"], "medal").withColumn("score", F.round("score", 6))
    rows = artifacts(spark, sf).where(search.conditions({})).join(hits, "artifact_id")
    return search.page(rows, [F.col("score"), F.col("created_seq").desc()], 10).select("artifact_id", "score", "created_seq")


@R("snk13_fts_document", "select artifact_id, length(string_agg(field_path, ' ' order by field_path)) n_chars from (select distinct artifact_id, field_path from artifact_schema_fields) group by 1")
def snk13_fts_document(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "artifact_schema_fields").groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_set("field_path")), " ").alias("t"))
    return names.select("artifact_id", F.length("t").cast("bigint").alias("n_chars"))


@R("c3_list_artifacts", V + "select artifact_id, source_tool, created_seq from a where deleted_at is null and kind = 'data' order by created_seq desc limit 50")
def c3_list_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts(spark, sf).where("deleted_at is null and kind = 'data'").orderBy(F.desc("created_seq")).limit(50).select("artifact_id", "source_tool", "created_seq")


@R("j3_list_derived", V + "select c.artifact_id, p.artifact_id parent_id, p.source_tool parent_tool from a c join a p on lower(trim(c.parent_artifact_id)) = p.artifact_id where c.kind <> 'data'")
def j3_list_derived(spark: SparkSession, sf: str) -> DataFrame:
    a = artifacts(spark, sf)
    parents = a.select(F.col("artifact_id").alias("parent_id"), F.col("source_tool").alias("parent_tool"))
    return a.where("kind <> 'data'").withColumn("parent_id", F.lower(F.trim("parent_artifact_id"))).join(parents, "parent_id").select("artifact_id", "parent_id", "parent_tool")


@R("j4_chain_edges", V + "select c.artifact_id, p.artifact_id parent_id, c.chain_seq from a c join a p on lower(trim(c.parent_artifact_id)) = p.artifact_id where c.deleted_at is null and p.deleted_at is null and c.chain_seq is not null")
def j4_chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    a = artifacts(spark, sf).where("deleted_at is null")
    parents = a.select(F.col("artifact_id").alias("parent_id"))
    return a.where("chain_seq is not null").withColumn("parent_id", F.lower(F.trim("parent_artifact_id"))).join(parents, "parent_id").select("artifact_id", "parent_id", "chain_seq")


#: The artifacts that can be reached from each along parent links in any direction.
_REACH = (
    "with recursive a as (select * exclude (n) from (select *, row_number() over (partition by artifact_id order by generation desc, ingested_at desc) n from artifacts) where n = 1), "
    "e as (select c.artifact_id x, p.artifact_id y from a c join a p on lower(trim(c.parent_artifact_id)) = p.artifact_id), "
    "reach(id, x) as (select artifact_id, artifact_id from a union select reach.id, case when e.x = reach.x then e.y else e.x end from reach join e on e.x = reach.x or e.y = reach.x), "
    "chain as (select id artifact_id, min(x) chain from reach group by 1) "
)


@R("j5_chain_members", _REACH + "select id artifact_id, count(distinct x)::bigint members from reach group by 1")
def j5_chain_members(spark: SparkSession, sf: str) -> DataFrame:
    """For each artifact the size of its chain, whatever the direction of the links, cycles too."""
    chains = catalog.chains(table(spark, sf, "artifacts"))
    sizes = chains.groupBy("chain_id").agg(F.count(F.lit(1)).alias("members"))
    return chains.join(sizes, "chain_id").select("artifact_id", "members")


@R("o5_chain_order", _REACH + "select artifact_id, row_number() over (partition by chain order by chain_seq nulls first, created_seq nulls first, artifact_id)::bigint place from a join chain using (artifact_id)")
def o5_chain_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each artifact's place in its chain."""
    return catalog.chain_places(table(spark, sf, "artifacts")).select("artifact_id", F.col("place").cast("bigint").alias("place"))


@R("a11_root_catalog", "with r as (select distinct artifact_id, root_key, root_path, lower(trim(mode)) m, lower(trim(completeness)) c, schema_hash, observed_records from artifact_schema_roots) select root_path, count(distinct artifact_id)::bigint artifacts, sum(observed_records)::bigint records, count(distinct concat_ws('|', m, c, schema_hash))::bigint signatures, count(distinct concat_ws('|', m, c, schema_hash)) <= 1 compatible from r group by 1")
def a11_root_catalog(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "artifact_schema_roots").select("artifact_id", "root_key", "root_path", F.lower(F.trim("mode")).alias("mode"), F.lower(F.trim("completeness")).alias("completeness"), "schema_hash", "observed_records").distinct()
    return catalog.root_catalog(roots)


@R("a12_map_status", V + "select map_status, count(*)::bigint n from a group by 1")
def a12_map_status(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts(spark, sf).groupBy("map_status").agg(F.count(F.lit(1)).alias("n"))


@R("a17_overlap", "select dataset_hash, count(distinct artifact_id)::bigint artifacts, min(artifact_id) first_artifact from artifact_schema_roots where dataset_hash is not null group by 1 having count(distinct artifact_id) > 1")
def a17_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "artifact_schema_roots").where("dataset_hash is not null")
    return rows.groupBy("dataset_hash").agg(F.countDistinct("artifact_id").alias("artifacts"), F.min("artifact_id").alias("first_artifact")).where("artifacts > 1")


@R("c9_related_set_hash", _REACH + ", h as (select chain, sha256('[\"' || string_agg(artifact_id || ':' || generation, '\",\"' order by artifact_id || ':' || generation) || '\"]') related_set_hash from a join chain using (artifact_id) group by 1) select artifact_id, related_set_hash from chain join h using (chain)")
def c9_related_set_hash(spark: SparkSession, sf: str) -> DataFrame:
    """For each artifact the hash of the members of its chain."""
    chains = catalog.chains(table(spark, sf, "artifacts"))
    members = artifacts(spark, sf).select("artifact_id", "generation").join(chains, "artifact_id")
    return chains.join(catalog.related_set_hash(members, "chain_id"), "chain_id").select("artifact_id", "related_set_hash")


@R("c10_single_root", V + ", r as (select artifact_id, min(root_path) root_path, count(distinct root_path) n from artifact_schema_roots group by 1) select a.artifact_id, coalesce(r.n, 0)::bigint roots, case when n = 1 then root_path end root_path from a left join r using (artifact_id)")
def c10_single_root(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "artifact_schema_roots").groupBy("artifact_id").agg(F.min("root_path").alias("root_path"), F.countDistinct("root_path").alias("n"))
    return artifacts(spark, sf).join(roots, "artifact_id", "left").select("artifact_id", F.coalesce("n", F.lit(0)).alias("roots"), F.when(F.col("n") == 1, F.col("root_path")).alias("root_path"))


@R("c11_mixed_schemas", V + ", r as (select distinct session_id, root_path, schema_hash from artifact_schema_roots join a using (artifact_id) where deleted_at is null) select session_id, root_path, count(*)::bigint signatures from r group by 1, 2 having count(*) > 1")
def c11_mixed_schemas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "artifact_schema_roots").join(artifacts(spark, sf).where("deleted_at is null").select("artifact_id", "session_id"), "artifact_id")
    return rows.select("session_id", "root_path", "schema_hash").distinct().groupBy("session_id", "root_path").agg(F.count(F.lit(1)).alias("signatures")).where("signatures > 1")


@R("j12_describe", V + ", r as (select distinct artifact_id, root_key, root_path from artifact_schema_roots), f as (select artifact_id, root_key, count(distinct field_path) n from artifact_schema_fields group by 1, 2) select a.artifact_id, r.root_path, coalesce(f.n, 0)::bigint fields from a join r using (artifact_id) left join f using (artifact_id, root_key) where a.deleted_at is null")
def j12_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of each visible artifact with the number of their fields."""
    roots = table(spark, sf, "artifact_schema_roots").select("artifact_id", "root_key", "root_path").distinct()
    fields = table(spark, sf, "artifact_schema_fields").groupBy("artifact_id", "root_key").agg(F.countDistinct("field_path").alias("n"))
    rows = artifacts(spark, sf).where("deleted_at is null").select("artifact_id").join(roots, "artifact_id").join(fields, ["artifact_id", "root_key"], "left")
    return rows.select("artifact_id", "root_path", F.coalesce("n", F.lit(0)).alias("fields"))


@R("j13_missing_roots", V + "select a.artifact_id, exists (select 1 from artifact_schema_roots r where r.artifact_id = a.artifact_id) has_root from a where map_status = 'ready'")
def j13_missing_roots(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "artifact_schema_roots").select("artifact_id", F.lit(True).alias("there")).distinct()
    return artifacts(spark, sf).where("map_status = 'ready'").join(roots, "artifact_id", "left").select("artifact_id", F.coalesce("there", F.lit(False)).alias("has_root"))


@R("j14_previous_capture", V + "select artifact_id, lag(payload_hash_full) over (partition by session_id, source_tool order by created_seq, artifact_id) previous_hash from a")
def j14_previous_capture(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.previous_capture(artifacts(spark, sf), "payload_hash_full", "previous_hash").select("artifact_id", "previous_hash")


@R("c18_duplicate_page", V + ", p as (select artifact_id, payload_hash_full h, lag(payload_hash_full) over (partition by session_id, source_tool order by created_seq, artifact_id) q from a) select artifact_id from p where h = q")
def c18_duplicate_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.previous_capture(artifacts(spark, sf), "payload_hash_full", "q").where("payload_hash_full = q").select("artifact_id")


@R(
    "c19_collection_signature",
    ENVELOPES + ", v as (select payload_hash_full, j->'$.content[0].value' v from e), "
    "c as (select payload_hash_full, p, json_array_length(case when p = '$' then v else json_extract(v, p) end) n from v, (select unnest(['$', '$.data', '$.results', '$.items', '$.records', '$.entries', '$.nodes', '$.result.data', '$.result.items']) p) "
    "where json_type(case when p = '$' then v else json_extract(v, p) end) = 'ARRAY') select payload_hash_full, arg_max(p, (n, length(p), p)) root_path, max(n)::int records from c where n >= 2 group by 1",
)
def c19_collection_signature(spark: SparkSession, sf: str) -> DataFrame:
    """The list that a response's records are in, and how many."""
    rows = envelopes(spark, sf).select("payload_hash_full", pages.collection_signature(F.to_json(at(F.col("v"), "$.content[0].value"))).alias("s"))
    return rows.where("s.root_path is not null").select("payload_hash_full", "s.root_path", "s.records")


@R("c20_request_identity", V + "select artifact_id, sha256(coalesce(upstream_instance_id, '') || '|' || split_part(coalesce(source_tool, ''), '.', 1) || '|' || coalesce(source_tool, '') || '|{\"after\":\"' || artifact_id || '\",\"limit\":5}') request_key from a")
def c20_request_identity(spark: SparkSession, sf: str) -> DataFrame:
    """One name for a request, however its arguments are written."""
    args = F.concat(F.lit('{ "limit" : 5.0, "after":"'), F.col("artifact_id"), F.lit('"}'))
    rows = artifacts(spark, sf).select("artifact_id", F.col("upstream_instance_id").alias("u"), F.substring_index(F.coalesce("source_tool", F.lit("")), ".", 1).alias("p"), F.col("source_tool").alias("t"), args.alias("a"))
    return rows.select("artifact_id", text.request_identity("u", "p", "t", "a").alias("request_key"))


@R("s6_representative_sample", """select doc_id, case when doc_id % 2 = 0 then '{"sample_item":{"id":' || doc_id || ',"t":"[' || repeat('x', 30) || '](6 more chars truncated)"},"sample_item_count":2,"sample_item_source_index":0,"sample_item_text_truncated":true}' end sample from documents""")
def s6_representative_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first of two items where it stands for both, with its long text cut."""
    key = F.col("doc_id").cast("string")
    items = F.concat(F.lit('[{"id":'), key, F.lit(',"t":"' + "x" * 36 + '"},{"t":"y","id":'), F.when(F.col("doc_id") % 2 == 0, "7").otherwise('"7"'), F.lit("}]"))
    return table(spark, sf, "documents").select("doc_id", canonical.representative_sample(items).alias("sample"))


@R("s13_utc_times", "select distinct created_at, created_at - interval 2 hour utc from artifacts")
def s13_utc_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times written with an offset, read as UTC."""
    shown = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, sf, "artifacts").select("created_at").distinct().select("created_at", text.utc_time(shown).alias("utc"))


@R("u4_located_records", RECORDS + "select artifact_id, root_path, idx, json_type(j) <> 'OBJECT' wrapped, true same from r")
def u4_located_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with where they come from, read back: objects beside their locator, all else as its value."""
    rows = spread(table(spark, sf, "artifact_records").where(F.try_parse_json("record").isNotNull()).select("artifact_id", "root_path", "idx", "record"))
    located = rows.select(once(F.parse_json("record")).alias("r"), text.with_locator(F.col("record"), F.col("artifact_id"), F.col("root_path"), F.col("idx")).alias("t")).select("r", once(F.parse_json("t")).alias("v"))
    place = F.try_variant_get("v", "$._locator", "struct<artifact_id:string,root_path:string,index:int>")
    wrapped = type_name(F.col("r")) != "object"
    own = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, x: k != "_locator")
    same = F.when(wrapped, F.to_json(at(F.col("v"), "$.value")) == F.to_json("r")).otherwise(F.to_json(own) == F.to_json(F.try_variant_get("r", "$", "map<string,variant>")))
    return located.select(place["artifact_id"].alias("artifact_id"), place["root_path"].alias("root_path"), place["index"].alias("idx"), wrapped.alias("wrapped"), same.alias("same"))


@R("j11_array_membership", RECORDS + "select artifact_id, root_path, idx from r where json_type(j, '$.kinds') = 'ARRAY' and exists (select 1 from json_each(j, '$.kinds') k where k.value::varchar = '\"early\"')")
def j11_array_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a value in one of their arrays."""
    kinds = F.try_variant_get("v", "$.kinds", "array<variant>")
    return records(spark, sf).where(F.exists(kinds, lambda x: F.coalesce(F.try_variant_get(x, "$", "string") == "early", F.lit(False)))).select("artifact_id", "root_path", "idx")


_LINKS = V + B + ", l as (select distinct a.artifact_id, b.binary_hash, b.mime, b.byte_count from a join payload_binary_refs r using (payload_hash_full) join b on b.binary_hash = r.binary_hash) "


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.artifact_blobs(artifacts(spark, sf), table(spark, sf, "payload_binary_refs"), table(spark, sf, "binary_blobs"))


@R("j2_artifact_blobs", _LINKS + "select * from l")
def j2_artifact_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("artifact_id", "binary_hash", "mime", "byte_count")


@R("a13_blob_list", _LINKS + "select binary_hash, count(distinct artifact_id)::bigint artifacts, min(artifact_id) first_artifact, max(byte_count) byte_count from l group by 1")
def a13_blob_list(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.blob_list(_links(spark, sf))


@R("snk11_manifest", _LINKS + "select binary_hash, string_agg(distinct artifact_id, ';' order by artifact_id) artifact_ids from l group by 1")
def snk11_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).groupBy("binary_hash").agg(F.array_join(F.array_sort(F.collect_set("artifact_id")), ";").alias("artifact_ids"))


@R("c28_blob_by_id", B[1:].replace(" b as", "with b as", 1) + ", d as (select doc_id, 'bin_' || substr(md5(doc_id::varchar), 1, 32) blob_id from documents union all select r.doc_id, b.blob_id from (select distinct doc_id, payload_hash_full from documents join artifacts using (artifact_id)) r join payload_binary_refs f using (payload_hash_full) join b on b.binary_hash = f.binary_hash) select distinct doc_id, blob_id, binary_hash, byte_count from d join b using (blob_id)")
def c28_blob_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs looked up by the ids that documents lead to, some of which there are none of."""
    blobs = catalog.distinct_blobs(table(spark, sf, "binary_blobs")).select("blob_id", "binary_hash", "byte_count")
    docs = table(spark, sf, "documents")
    known = docs.join(table(spark, sf, "artifacts").select("artifact_id", "payload_hash_full"), "artifact_id").join(table(spark, sf, "payload_binary_refs").select("payload_hash_full", "binary_hash"), "payload_hash_full")
    known = known.join(blobs.select("binary_hash", "blob_id"), "binary_hash").select("doc_id", "blob_id")
    asked = docs.select("doc_id", F.concat(F.lit("bin_"), F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("blob_id")).unionByName(known)
    return asked.join(blobs, "blob_id").select("doc_id", "blob_id", "binary_hash", "byte_count").distinct()


@R("snk7_blob_id", "select distinct binary_hash, blob_id = 'bin_' || substr(binary_hash, 1, 32) ok from binary_blobs")
def snk7_blob_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "binary_blobs").select("binary_hash", (F.col("blob_id") == F.concat(F.lit("bin_"), F.substring("binary_hash", 1, 32))).alias("ok")).distinct()


@R("j6_parent_or_self", V + "select artifact_id from a where kind = 'derived_query' or exists (select 1 from a c where c.kind = 'derived_query' and lower(trim(c.parent_artifact_id)) = a.artifact_id)")
def j6_parent_or_self(spark: SparkSession, sf: str) -> DataFrame:
    a = artifacts(spark, sf)
    parents = a.where("kind = 'derived_query'").select(F.lower(F.trim("parent_artifact_id")).alias("artifact_id")).where("artifact_id is not null").distinct().withColumn("is_parent", F.lit(True))
    return a.join(parents, "artifact_id", "left").where("kind = 'derived_query' or is_parent").select("artifact_id")


@R("j7_has_binary_refs", V + "select artifact_id from a where payload_hash_full in (select payload_hash_full from payload_binary_refs)")
def j7_has_binary_refs(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts(spark, sf).join(table(spark, sf, "payload_binary_refs"), "payload_hash_full", "left_semi").select("artifact_id")


@R("j8_unreferenced_payloads", "select distinct payload_hash_full from payload_blobs p where not exists (select 1 from artifacts a where a.payload_hash_full = p.payload_hash_full)")
def j8_unreferenced_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "payload_blobs").select("payload_hash_full").distinct().join(table(spark, sf, "artifacts"), "payload_hash_full", "left_anti")


@R("j9_unreferenced_blobs", "select distinct binary_hash from binary_blobs b where not exists (select 1 from payload_binary_refs r where r.binary_hash = b.binary_hash)")
def j9_unreferenced_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "binary_blobs").select("binary_hash").distinct().join(table(spark, sf, "payload_binary_refs"), "binary_hash", "left_anti")


@R("j10_reconcile", "with e as (select distinct payload_hash_full k from artifacts where payload_hash_full is not null), p as (select distinct payload_hash_full k from payload_blobs where payload_hash_full is not null) select k payload_hash_full, 'orphan' fault from (select k from p except select k from e) union all select k, 'missing' from (select k from e except select k from p)")
def j10_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.reconcile(table(spark, sf, "artifacts").where("payload_hash_full is not null"), table(spark, sf, "payload_blobs").where("payload_hash_full is not null"), "payload_hash_full")


_STORE = "with p as (select payload_hash_full, max(payload_json_bytes) x from payload_blobs group by 1), b as (select binary_hash, max(byte_count) y from binary_blobs group by 1), u as (select (select coalesce(sum(x), 0) from p)::bigint payload_bytes, (select coalesce(sum(y), 0) from b)::bigint binary_bytes) "


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "payload_blobs").groupBy("payload_hash_full").agg(F.max("payload_json_bytes").alias("payload_json_bytes"))
    b = table(spark, sf, "binary_blobs").groupBy("binary_hash").agg(F.max("byte_count").alias("byte_count"))
    return lifecycle.storage_usage(p, b)


@R("a3_storage_usage", _STORE + "select *, payload_bytes + binary_bytes total_bytes from u")
def a3_storage_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _usage(spark, sf)


@R("a4_breaches", _STORE + "select payload_bytes > 500000 payload_breach, binary_bytes > 1000000000 binary_breach, payload_bytes + binary_bytes > 1000000000 total_breach from u")
def a4_breaches(spark: SparkSession, sf: str) -> DataFrame:
    return _usage(spark, sf).select((F.col("payload_bytes") > 500000).alias("payload_breach"), (F.col("binary_bytes") > 1000000000).alias("binary_breach"), (F.col("total_bytes") > 1000000000).alias("total_breach"))


@R("c12_ttl", V + f"select artifact_id, expires_at from a where deleted_at is null and expires_at <= timestamp '{NOW}' order by expires_at, artifact_id limit 100")
def c12_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.expired(artifacts(spark, sf), _now(), 100)


@R("c13_unreferenced", V + f"select artifact_id from a where deleted_at is null and last_referenced_at < timestamp '{NOW}' and artifact_id not in (select parent_artifact_id from a where parent_artifact_id is not null)")
def c13_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.unreferenced(artifacts(spark, sf), _now())


@R("c14_hard_delete", V + f", gone as (select artifact_id, payload_hash_full from a where deleted_at < timestamp '{NOW}'), dead as (select distinct payload_hash_full from payload_blobs p where not exists (select 1 from a where a.payload_hash_full = p.payload_hash_full and a.artifact_id not in (select artifact_id from gone))), blobs as (select distinct binary_hash from binary_blobs b where not exists (select 1 from payload_binary_refs r where r.binary_hash = b.binary_hash and r.payload_hash_full not in (select payload_hash_full from dead))) select 'artifacts' what, count(*)::bigint n from gone union all select 'payloads', count(*) from dead union all select 'blobs', count(*) from blobs")
def c14_hard_delete(spark: SparkSession, sf: str) -> DataFrame:
    parts = lifecycle.hard_delete(artifacts(spark, sf), table(spark, sf, "payload_blobs"), table(spark, sf, "payload_binary_refs"), table(spark, sf, "binary_blobs"), _now())
    counts = [df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R(
    "c15_quota",
    V
    + ", l as (select artifact_id, payload_hash_full, payload_total_bytes, last_referenced_at from a where deleted_at is null and payload_hash_full is not null), f as (select *, row_number() over (partition by payload_hash_full order by last_referenced_at desc, artifact_id desc) n, max(payload_total_bytes) over (partition by payload_hash_full) most from l), g as (select artifact_id, last_referenced_at, case when n = 1 then most else 0 end freed from f), h as (select artifact_id, freed, sum(freed) over (order by last_referenced_at, artifact_id) running from g) select artifact_id, freed, running::bigint running from h where running - freed < 2000000",
)
def c15_quota(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.quota_victims(artifacts(spark, sf), 2_000_000)


@R("o10_lru_batch", V + "select artifact_id from a where deleted_at is null order by last_referenced_at, artifact_id limit 100")
def o10_lru_batch(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts(spark, sf).where("deleted_at is null").orderBy("last_referenced_at", "artifact_id").limit(100).select("artifact_id")


@R("c22_touch", V + ", t as (select artifact_id, max(captured_at) seen from documents where artifact_id is not null group by 1) select a.artifact_id, greatest(a.last_referenced_at, coalesce(t.seen, a.last_referenced_at)) last_referenced_at from a left join t using (artifact_id)")
def c22_touch(spark: SparkSession, sf: str) -> DataFrame:
    """Access times brought up to date from a log of accesses."""
    seen = table(spark, sf, "documents").where("artifact_id is not null").groupBy("artifact_id").agg(F.max("captured_at").alias("seen"))
    return artifacts(spark, sf).join(seen, "artifact_id", "left").select("artifact_id", F.greatest("last_referenced_at", "seen").alias("last_referenced_at"))


@R("c23_visible", "select doc_id from documents d where exists (select 1 from artifacts a where a.artifact_id = d.artifact_id)")
def c23_visible(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "artifact_id").join(table(spark, sf, "artifacts").select("artifact_id"), "artifact_id", "left_semi").select("doc_id")


@R("c24_sample_gaps", "with e as (select artifact_id, root_path, max(observed_records) n from artifact_schema_roots group by 1, 2), h as (select artifact_id, root_path, count(distinct idx) there from artifact_records group by 1, 2) select artifact_id, root_path, n expected, coalesce(there, 0)::bigint there from e left join h using (artifact_id, root_path) where coalesce(there, 0) < n")
def c24_sample_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Roots with fewer records than their profile saw."""
    expected = table(spark, sf, "artifact_schema_roots").groupBy("artifact_id", "root_path").agg(F.max("observed_records").alias("expected"))
    there = table(spark, sf, "artifact_records").groupBy("artifact_id", "root_path").agg(F.countDistinct("idx").alias("there"))
    return expected.join(there, ["artifact_id", "root_path"], "left").select("artifact_id", "root_path", "expected", F.coalesce("there", F.lit(0)).alias("there")).where("there < expected")


@R("c25_schema_fields", "with t as (select distinct artifact_id, root_key from artifact_schema_roots where root_path = '$.docs') select distinct artifact_id, field_path, observed_count from artifact_schema_fields join t using (artifact_id, root_key)")
def c25_schema_fields(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "artifact_schema_roots").where("root_path = '$.docs'")
    return table(spark, sf, "artifact_schema_fields").join(roots, ["artifact_id", "root_key"], "left_semi").select("artifact_id", "field_path", "observed_count").distinct()


@R("c26_row_violations", V + "select artifact_id, not regexp_full_match(artifact_id, 'art_[0-9a-f]{32}') bad_id, payload_json_bytes + payload_binary_bytes_total <> payload_total_bytes bad_sizes, (kind = 'data') <> (derivation is null) bad_derivation from a")
def c26_row_violations(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts(spark, sf).select(
        "artifact_id",
        (~F.rlike("artifact_id", F.lit("^art_[0-9a-f]{32}$"))).alias("bad_id"),
        (F.col("payload_json_bytes") + F.col("payload_binary_bytes_total") != F.col("payload_total_bytes")).alias("bad_sizes"),
        ((F.col("kind") == "data") != F.col("derivation").isNull()).alias("bad_derivation"),
    )


@R("c27_capture_identity", V + "select artifact_id, split_part(source_tool, '.', 1) origin, substr(source_tool, strpos(source_tool, '.') + 1) tool, coalesce(capture_kind, 'mcp_tool') capture_kind from a")
def c27_capture_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Where a capture comes from."""
    return artifacts(spark, sf).select("artifact_id", F.substring_index("source_tool", ".", 1).alias("origin"), F.expr("substr(source_tool, instr(source_tool, '.') + 1)").alias("tool"), F.coalesce("capture_kind", F.lit("mcp_tool")).alias("capture_kind"))


@R("d4_shared_payloads", "select payload_hash_full from (select distinct payload_hash_full from artifacts where generation = 1 and payload_hash_full is not null intersect select payload_hash_full from artifacts where generation > 1)")
def d4_shared_payloads(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "artifacts").where("payload_hash_full is not null")
    return a.where("generation = 1").select("payload_hash_full").intersect(a.where("generation > 1").select("payload_hash_full"))


@R("d3_edge_directions", V + ", e as (select artifact_id x, lower(trim(parent_artifact_id)) y from a where nullif(trim(parent_artifact_id), '') is not null) select x, y from e union select y, x from e")
def d3_edge_directions(spark: SparkSession, sf: str) -> DataFrame:
    e = artifacts(spark, sf).where("nullif(trim(parent_artifact_id), '') is not null").select(F.col("artifact_id").alias("x"), F.lower(F.trim("parent_artifact_id")).alias("y"))
    return e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


@R("w5_created_seq", "with f as (select artifact_id, min(created_at) created_at from artifacts group by 1) select artifact_id, row_number() over (order by created_at, artifact_id)::bigint seq from f")
def w5_created_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Global monotone numbers, though no task sees all rows."""
    first = table(spark, sf, "artifacts").groupBy("artifact_id").agg(F.min("created_at").alias("created_at"))
    return numbered(first, [], ["created_at", "artifact_id"], "seq").select("artifact_id", F.col("seq").cast("bigint").alias("seq"))


@R(
    "c6_describe",
    V
    + """, r as (select artifact_id, root_key, max(root_path) root_path, max(observed_records) records from artifact_schema_roots group by 1, 2), f as (select artifact_id, root_key, count(distinct field_path) n from artifact_schema_fields group by 1, 2),
    x as (select artifact_id, string_agg(root_path || ':' || case when root_path <> '$' or records > 1 then 'array' else 'object' end || ':' || coalesce(n, 0), ',' order by root_path) roots from r left join f using (artifact_id, root_key) group by 1),
    s as (select session_id, count(*)::bigint session_artifacts, count(case when map_status = 'ready' then 1 end)::bigint session_ready from a where deleted_at is null group by 1)
    select artifact_id, map_kind, map_status, roots, session_artifacts, session_ready from a left join x using (artifact_id) join s on s.session_id is not distinct from a.session_id where deleted_at is null""",
)
def c6_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Every visible artifact with its roots, their shapes and fields, and the state of its session."""
    d = catalog.described(artifacts(spark, sf), table(spark, sf, "artifact_schema_roots"), table(spark, sf, "artifact_schema_fields"))
    shown = F.array_join(F.transform("roots", lambda r: F.concat_ws(":", r["root_path"], r["shape"], r["fields"].cast("string"))), ",")
    return d.select("artifact_id", "map_kind", "map_status", shown.alias("roots"), "session_artifacts", "session_ready")


@R("c11_schema_groups", V + ", o as (select distinct artifact_id, root_path, schema_hash, session_id from artifact_schema_roots join a using (artifact_id) where deleted_at is null), g as (select session_id, root_path, schema_hash, count(*)::bigint artifacts, min(artifact_id) first, max(artifact_id) last from o group by 1, 2, 3) select * from g where (session_id, root_path) in (select (session_id, root_path) from g group by session_id, root_path having count(*) > 1)")
def c11_schema_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Where a session has a root with several schemas: the artifacts of each."""
    return catalog.schema_groups(artifacts(spark, sf), table(spark, sf, "artifact_schema_roots"))


_ROOTS = ", r as (select artifact_id, list_sort(list(distinct root_path)) p from artifact_schema_roots group by 1), q as (select artifact_id, coalesce(p, []) p from a left join r using (artifact_id)) "


@R("c10_resolved_root", V + _ROOTS + "select artifact_id, case len(p) when 0 then 'missing' when 1 then 'ok' else 'ambiguous' end status, case when len(p) = 1 then p[1] end root_path, case when len(p) <> 1 then array_to_string(p, ',') end suggestions from q")
def c10_resolved_root(spark: SparkSession, sf: str) -> DataFrame:
    """The one root of each artifact, or what a caller may choose from."""
    return catalog.resolved_root(artifacts(spark, sf), table(spark, sf, "artifact_schema_roots"), None)


@R("c10_asked_root", V + _ROOTS + "select artifact_id, case when list_contains(p, '$.docs') then 'ok' else 'missing' end status, case when list_contains(p, '$.docs') then '$.docs' end root_path, case when not list_contains(p, '$.docs') then array_to_string(p, ',') end suggestions from q")
def c10_asked_root(spark: SparkSession, sf: str) -> DataFrame:
    """The same for a root that was asked for."""
    return catalog.resolved_root(artifacts(spark, sf), table(spark, sf, "artifact_schema_roots"), "$.docs")


@R("c17_blobs_of_session", _LINKS + ", w as (select session_id, binary_hash, max(byte_count) byte_count from l join a using (artifact_id) group by 1, 2), p as (select *, row_number() over (partition by session_id order by byte_count desc nulls last, binary_hash)::bigint place, count(*) over (partition by session_id) > 5 truncated from w) select * from p where place <= 5")
def c17_blobs_of_session(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest blobs of every session, and whether it has more."""
    links = _links(spark, sf).join(artifacts(spark, sf).select("artifact_id", "session_id"), "artifact_id")
    found = catalog.blobs_in_scope(links, ["session_id"], 5)
    return found.select("session_id", "binary_hash", "byte_count", F.col("place").cast("bigint").alias("place"), "truncated")


QUERIES, ORACLE = R.queries, R.sql
