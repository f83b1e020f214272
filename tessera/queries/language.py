"""Queries of the filter language, JSON navigation, record materialisation and select."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.functions.variants import at, elements, members, text_as_json, type_name
from tessera.operators.filters import compile_filter
from tessera.operators.select import Select, count, select
from tessera.queries.registry import ENVELOPES, RECORDS, Registry, envelopes, records
from tessera.session import table

R = Registry()
KEY = ["artifact_id", "root_path", "idx"]
_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"


def _t(path: str, j: str = "j") -> str:
    return f"json_type({j}, '{path}')"


def _num(path: str, j: str = "j") -> str:
    return f"(case when {_t(path, j)} in {_NUMBERS} then ({j}->>'{path}')::double when {_t(path, j)} = 'BOOLEAN' then (({j}->>'{path}') = 'true')::int::double end)"


def _txt(path: str, j: str = "j") -> str:
    return f"(case when {_t(path, j)} in ('VARCHAR', 'OBJECT', 'ARRAY') then {j}->>'{path}' end)"


def _cmp(path: str, op: str, value: float | str) -> str:
    """Storage-class comparison: text is above every number."""
    if isinstance(value, str):
        below = "true" if op in ("<", "<=", "<>") else "false"
        return f"(case when {_num(path)} is not null then {below} else {_txt(path)} {op} '{value}' end)"
    above = "true" if op in (">", ">=", "<>") else "false"
    return f"(case when {_txt(path)} is not null then {above} else {_num(path)} {op} {value} end)"


def _present(path: str) -> str:
    return f"coalesce({_t(path)}, 'NULL') <> 'NULL'"


_CASES: dict[str, tuple[dict, str]] = {
    "f1_eq_text": ({"path": "$.state", "op": "eq", "value": "open"}, _cmp("$.state", "=", "open")),
    "f1_eq_bool": ({"path": "$.draft", "op": "eq", "value": True}, _cmp("$.draft", "=", 1)),
    "f1_eq_number": ({"path": "$.properties.tsunami", "op": "eq", "value": 1}, _cmp("$.properties.tsunami", "=", 1)),
    "f2_ne": ({"path": "$.state", "op": "ne", "value": "open"}, _cmp("$.state", "<>", "open")),
    "f3_gt": ({"path": "$.elevation", "op": "gt", "value": 1000}, _cmp("$.elevation", ">", 1000)),
    "f4_gte": ({"path": "$.amount", "op": "gte", "value": 5000.5}, _cmp("$.amount", ">=", 5000.5)),
    "f5_lt": ({"path": "$.elevation", "op": "lt", "value": 1000}, _cmp("$.elevation", "<", 1000)),
    "f6_lte": ({"path": "$.blood_group", "op": "lte", "value": "M2"}, _cmp("$.blood_group", "<=", "M2")),
    "f7_eq_null": ({"path": "$.felt", "op": "eq", "value": None}, f"not {_present('$.felt')}"),
    "f8_ne_null": ({"path": "$.felt", "op": "ne", "value": None}, _present("$.felt")),
    "f9_in": ({"path": "$.iata", "op": "in", "value": ["A1", "B7", 3]}, f"({_cmp('$.iata', '=', 'A1')} or {_cmp('$.iata', '=', 'B7')} or {_cmp('$.iata', '=', 3)})"),
    "f9_in_empty": ({"path": "$.iata", "op": "in", "value": []}, "false"),
    "f10_contains": ({"path": "$.title", "op": "contains", "value": "QUI"}, f"contains(lower({_txt('$.title')}), 'qui')"),
    "f11_array_contains": ({"path": "$.kinds", "op": "array_contains", "value": "glossy"}, "coalesce(json_type(j, '$.kinds') = 'ARRAY' and list_contains(list_filter((case when json_type(j, '$.kinds') = 'ARRAY' then j->'$.kinds' else '[]'::json end)::json[], lambda x: json_type(x) = 'VARCHAR')::varchar[], '\"glossy\"'), false)"),
    "f12_exists": ({"path": "$.license", "op": "exists"}, f"{_t('$.license')} is not null"),
    "f13_not_exists": ({"path": "$.license", "op": "not_exists"}, f"{_t('$.license')} is null"),
    "f14_and": ({"logic": "and", "filters": [{"path": "$.paid", "op": "eq", "value": True}, {"path": "$.amount", "op": "gt", "value": 1000}]}, f"({_cmp('$.paid', '=', 1)} and {_cmp('$.amount', '>', 1000)})"),
    "f14_or": ({"logic": "or", "filters": [{"path": "$.region", "op": "gt", "value": "S"}, {"path": "$.stars", "op": "lt", "value": 100}]}, f"({_cmp('$.region', '>', 'S')} or {_cmp('$.stars', '<', 100)})"),
    "f14_empty_or": ({"logic": "or", "filters": []}, "false"),
    "f15_not": ({"not": {"path": "$.stars", "op": "gte", "value": 100}}, f"not {_cmp('$.stars', '>=', 100)}"),
    "t1_cross_type_order": ({"path": "$.id", "op": "gt", "value": 99999999}, _cmp("$.id", ">", 99999999)),
    "t7_bracket_path": ({"path": "$['x-trace']", "op": "exists"}, "json_type(j, '$.\"x-trace\"') is not null"),
}


def _filter_query(raw: dict):
    return lambda spark, sf: records(spark, sf).where(compile_filter(raw, F.col("v"))).select(*KEY)


for _name, (_raw, _sql) in _CASES.items():
    R.add(_name, _filter_query(_raw), RECORDS + f"select artifact_id, root_path, idx from r where {_sql}")


@R("s1_type_name", RECORDS + f"select type, count(*)::bigint n from (select case json_type(j) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end type from r) group by 1")
def s1_type_name(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy(type_name(F.col("v")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@R("nav_p3_path", RECORDS + "select artifact_id, idx, j->>'$.user.login' login from r where json_type(j, '$.user.login') = 'VARCHAR'")
def p3_path(spark: SparkSession, sf: str) -> DataFrame:
    x = jsonpath.get(F.col("v"), "$.user.login")
    return records(spark, sf).where(type_name(x) == "string").select("artifact_id", "idx", x.cast("string").alias("login"))


_UNNEST = "(select {cols}, generate_subscripts(l, 1) - 1 pos, unnest(l) x from (select {cols}, (case when json_type(j, '{path}') = 'ARRAY' then j->'{path}' else '[]'::json end)::json[] l from {src}))"


@R("nav_p4_wildcard_array", RECORDS + f"select artifact_id, idx, pos::int pos, x->>'$.name' name from {_UNNEST.format(cols='artifact_id, root_path, idx', path='$.labels', src='r')} where json_type(x, '$.name') = 'VARCHAR'")
def p4_wildcard_array(spark: SparkSession, sf: str) -> DataFrame:
    found = jsonpath.evaluate(records(spark, sf), "v", "$.labels[*].name").where(type_name(F.col("match")) == "string")
    # objects have members by name where arrays have elements by position
    return found.where(type_name(jsonpath.get(F.col("v"), "$.labels")) == "array").select("artifact_id", "idx", F.col("match_pos")[0].alias("pos"), F.col("match").cast("string").alias("name"))


@R(
    "nav_p5_wildcard_object",
    RECORDS + "select artifact_id, idx, k, j->>('$.base.\"' || k || '\"') val from (select artifact_id, idx, j, unnest(json_keys(j, '$.base')) k from r where json_type(j, '$.base') = 'OBJECT') where json_type(j, '$.base.\"' || k || '\"') = 'UBIGINT'",
)
def p5_wildcard_object(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).select("artifact_id", "idx", F.explode(members(jsonpath.get(F.col("v"), "$.base"))).alias("k", "x"))
    return rows.where(F.schema_of_variant("x") == "BIGINT").select("artifact_id", "idx", "k", F.col("x").cast("string").alias("val"))


@R("nav_p6_index", RECORDS + "select artifact_id, idx, j->>'$.kinds[1]' kind from r where json_type(j, '$.kinds[1]') = 'VARCHAR'")
def p6_index(spark: SparkSession, sf: str) -> DataFrame:
    x = jsonpath.get(F.col("v"), "$.kinds[1]")
    return records(spark, sf).where(type_name(x) == "string").select("artifact_id", "idx", x.cast("string").alias("kind"))


@R("nav_p8_two_wildcards", RECORDS + f"select artifact_id, idx, count(*)::bigint n from (select artifact_id, idx, unnest((case when json_type(x, '$.replies') = 'ARRAY' then x->'$.replies' else '[]'::json end)::json[]) y from {_UNNEST.format(cols='artifact_id, root_path, idx', path='$.threads', src='r')}) group by 1, 2")
def p8_two_wildcards(spark: SparkSession, sf: str) -> DataFrame:
    return jsonpath.evaluate(records(spark, sf), "v", "$.threads[*].replies[*]").groupBy("artifact_id", "idx").agg(F.count(F.lit(1)).alias("n"))


def _projection(spark: SparkSession, sf: str, missing_as_null: bool) -> DataFrame:
    rows = records(spark, sf).where(type_name(jsonpath.get(F.col("v"), "$.state")) == "string")
    item = F.parse_json(select(rows, Select(paths=["user.login", "state", "draft"], missing_as_null=missing_as_null), KEY).item)
    return rows, item


@R(
    "nav_p10_project",
    RECORDS + "select artifact_id, idx, j->>'$.state' state, case when json_type(j, '$.user.login') = 'VARCHAR' then j->>'$.user.login' end login, (case when json_type(j, '$.user.login') is not null and json_type(j, '$.user.login') <> 'NULL' then 1 else 0 end) has_login from r where json_type(j, '$.state') = 'VARCHAR'",
)
def p10_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).where(type_name(jsonpath.get(F.col("v"), "$.state")) == "string")
    items = select(rows, Select(paths=["user.login", "state"]), KEY).withColumn("o", F.parse_json("item"))
    login = at(F.col("o"), "$['$.user.login']")
    return items.select("artifact_id", "idx", F.try_variant_get("o", "$['$.state']", "string").alias("state"), F.when(type_name(login) == "string", login.cast("string")).alias("login"), F.contains("item", F.lit('"$.user.login":')).cast("int").alias("has_login"))


@R("nav_p13_missing_as_null", RECORDS + "select count(*)::bigint n, count(case when json_type(j, '$.felt') is null or json_type(j, '$.felt') = 'NULL' then 1 end)::bigint nulls from r")
def p13_missing_as_null(spark: SparkSession, sf: str) -> DataFrame:
    items = select(records(spark, sf), Select(paths=["felt"], missing_as_null=True), KEY)
    return items.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("item") == '{"$.felt":null}', 1)).alias("nulls"))


@R("nav_p15_get_envelope", ENVELOPES + f"select payload_hash_full, pos::int pos, x->>'$.type' type from {_UNNEST.format(cols='payload_hash_full', path='$.content', src='e')}")
def p15_get_envelope(spark: SparkSession, sf: str) -> DataFrame:
    found = jsonpath.evaluate(envelopes(spark, sf), "v", "$.content[*]")
    return found.select("payload_hash_full", F.col("match_pos")[0].alias("pos"), F.try_variant_get("match", "$.type", "string").alias("type"))


@R("nav_p17_part_by_index", ENVELOPES + "select payload_hash_full, j->>'$.content[0].type' type, json_type(j, '$.content[0].value') is not null has_value from e where json_array_length(j, '$.content') > 0")
def p17_part_by_index(spark: SparkSession, sf: str) -> DataFrame:
    part = F.get(elements(jsonpath.get(F.col("v"), "$.content")), F.lit(0))
    return envelopes(spark, sf).where(part.isNotNull()).select("payload_hash_full", F.try_variant_get(part, "$.type", "string").alias("type"), at(part, "$.value").isNotNull().alias("has_value"))


@R(
    "nav_p18_json_string",
    "with s as (select artifact_id, root_path, idx, record::json j from artifact_records where json_valid(record) and json_type(record) = 'VARCHAR'), t as (select *, j->>'$' inner_text from s) select artifact_id, idx, case json_type(inner_text) when 'OBJECT' then 'object' else 'array' end kind from t where json_valid(inner_text) and json_type(inner_text) in ('OBJECT', 'ARRAY')",
)
def p18_json_string(spark: SparkSession, sf: str) -> DataFrame:
    text = records(spark, sf).where(type_name(F.col("v")) == "string").withColumn("held", text_as_json(F.col("v").cast("string")))
    return text.where(F.col("held").isNotNull()).select("artifact_id", "idx", type_name(F.col("held")).alias("kind"))


@R(
    "nav_p20_item_sequence",
    ENVELOPES
    + """, v as (select payload_hash_full, j->'$.content[0].value' v from e where json_type(j, '$.content[0].value') is not null),
    lists as (select payload_hash_full, k from (select payload_hash_full, v, unnest(json_keys(v)) k from v where json_type(v) = 'OBJECT') where json_type(v, '$."' || k || '"') = 'ARRAY'),
    one as (select payload_hash_full, min(k) k from lists group by 1 having count(*) = 1)
    select payload_hash_full, case when json_type(v) = 'ARRAY' then '$' when json_type(v, '$.items') = 'ARRAY' then '$.items' else '$.' || k end path from v left join one using (payload_hash_full)
    where json_type(v) = 'ARRAY' or json_type(v, '$.items') = 'ARRAY' or k is not null""",
)
def p20_item_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Where the items of a payload are: the payload itself, ``items``, or its only list."""
    v = F.col("x")
    lists = F.map_keys(F.map_filter(members(v), lambda k, e: type_name(e) == "array"))
    rows = envelopes(spark, sf).withColumn("x", at(F.col("v"), "$.content[0].value")).withColumn("lists", lists)
    path = F.when(type_name(v) == "array", "$").when(type_name(at(v, "$.items")) == "array", "$.items").when(F.size("lists") == 1, F.concat(F.lit("$."), F.col("lists")[0]))
    return rows.select("payload_hash_full", path.alias("path")).where("path is not null")


@R(
    "u1_records",
    ENVELOPES
    + """, v as (select payload_hash_full, j->'$.content[0].value' v from e where json_type(j, '$.content[0].value') is not null)
    select payload_hash_full, idx::int idx, case when json_type(x, '$.id') in ('UBIGINT', 'BIGINT') then x->>'$.id' end id from (
      select payload_hash_full, generate_subscripts(l, 1) - 1 idx, unnest(l) x from (select payload_hash_full, v::json[] l from v where json_type(v) = 'ARRAY')
      union all select payload_hash_full, 0, v from v where json_type(v) <> 'ARRAY')""",
)
def u1_records(spark: SparkSession, sf: str) -> DataFrame:
    """Array payloads give a row per element, others one row."""
    rows = materialise(envelopes(spark, sf).withColumn("x", at(F.col("v"), "$.content[0].value")).where("x is not null"), "x")
    item = at(F.col("record"), "$.id")
    return rows.select("payload_hash_full", "idx", F.when(F.schema_of_variant(item) == "BIGINT", item.cast("string")).alias("id"))


def materialise(rows: DataFrame, value: str) -> DataFrame:
    """Rows of (other columns, idx, record) from one value each."""
    keep = [c for c in rows.columns if c not in (value, "v")]
    return rows.select(*keep, F.posexplode(F.coalesce(elements(F.col(value)), F.array(F.col(value)))).alias("idx", "record"))


@R(
    "u3_sampled_records",
    "with m as (select artifact_id, arg_max(map_kind, (generation, ingested_at)) map_kind from artifacts group by 1) select map_kind, count(*)::bigint n, count(distinct artifact_id)::bigint artifacts from artifact_records join m using (artifact_id) group by 1",
)
def u3_sampled_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records by whether their artifact is mapped fully or by a sample."""
    kinds = table(spark, sf, "artifacts").groupBy("artifact_id").agg(F.max_by("map_kind", F.struct("generation", "ingested_at")).alias("map_kind"))
    return table(spark, sf, "artifact_records").join(kinds, "artifact_id").groupBy("map_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artifact_id").alias("artifacts"))


@R("u5_input_limits", "select artifact_id, count(*)::bigint records, sum(octet_length(encode(record)))::bigint bytes, count(*) > 1000 or sum(octet_length(encode(record))) > 100000 too_large from artifact_records where record is not null group by 1")
def u5_input_limits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "artifact_records").where("record is not null")
    sized = rows.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("record").cast("bigint")).alias("bytes"))
    return sized.withColumn("too_large", (F.col("records") > 1000) | (F.col("bytes") > 100000))


@R(
    "u7_zip_arrays",
    RECORDS
    + """, h as (select artifact_id, root_path, idx, (case when json_type(j, '$.hourly.time') = 'ARRAY' then j->'$.hourly.time' else '[]'::json end)::json[] a, (case when json_type(j, '$.hourly.temperature') = 'ARRAY' then j->'$.hourly.temperature' else '[]'::json end)::json[] b from r),
    z as (select artifact_id, root_path, idx, unnest(range(least(len(a), len(b)))) i, a, b from h)
    select artifact_id, idx, i::int pos, a[i + 1]->>'$' taken_at, (b[i + 1]->>'$')::double temperature from z where json_type(a[i + 1]) = 'VARCHAR' and json_type(b[i + 1]) in """
    + _NUMBERS,
)
def u7_zip_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays of one record side by side, as far as both reach."""
    a, b = (elements(jsonpath.get(F.col("v"), f"$.hourly.{n}")) for n in ("time", "temperature"))
    rows = records(spark, sf).select("artifact_id", "idx", F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("pos", "z"))
    rows = rows.where((type_name(F.col("z.a")) == "string") & (type_name(F.col("z.b")) == "number"))
    return rows.select("artifact_id", "idx", "pos", F.col("z.a").cast("string").alias("taken_at"), F.try_variant_get("z.b", "$", "double").alias("temperature"))


_STATE = RECORDS + ", s as (select artifact_id, root_path, idx, j->>'$.state' state, j->>'$.user.login' login, (j->>'$.id') id from r where json_type(j, '$.state') = 'VARCHAR') "


def _tickets(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where(type_name(jsonpath.get(F.col("v"), "$.state")) == "string").dropDuplicates(KEY)


@R("a1_count", RECORDS + f"select count(*)::bigint n from r where {_cmp('$.stars', '>', 500)}")
def a1_count(spark: SparkSession, sf: str) -> DataFrame:
    return count(records(spark, sf), Select(where={"path": "$.stars", "op": "gt", "value": 500}))


@R("a2_count_distinct", RECORDS + "select count(*)::bigint n from (select distinct j->'$.region' from r where json_type(j, '$.region') is not null and json_type(j, '$.region') <> 'NULL')")
def a2_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return count(records(spark, sf), Select(paths=["region"], where={"path": "$.region", "op": "ne", "value": None}, distinct=True))


@R("d1_distinct", RECORDS + "select distinct j->>'$.region' region from r where json_type(j, '$.region') = 'VARCHAR'")
def d1_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).where(type_name(jsonpath.get(F.col("v"), "$.region")) == "string")
    return select(rows, Select(paths=["region"], distinct=True), KEY).select(F.get_json_object("item", "$['$.region']").alias("region"))


_TOP = RECORDS + ", s as (select distinct artifact_id, root_path, idx, (j->>'$.population')::double population, case when json_type(j, '$.name.common') = 'VARCHAR' then j->>'$.name.common' end name from r where json_type(j, '$.population') in " + _NUMBERS + ") "


@R("o2_order_limit", _TOP + "select artifact_id, idx, population from s order by population desc, artifact_id, root_path, idx limit 50")
def o2_order_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).where(type_name(jsonpath.get(F.col("v"), "$.population")) == "number").dropDuplicates(KEY)
    top = select(rows, Select(paths=["population"], order_by="to_number(population) DESC", limit=50), KEY)
    return top.select("artifact_id", "idx", F.get_json_object("item", "$['$.population']").cast("double").alias("population"))


@R("o6_offset_limit", _STATE + "select artifact_id, idx, state from (select distinct artifact_id, root_path, idx, state from s) order by state, artifact_id, root_path, idx limit 25 offset 40")
def o6_offset_limit(spark: SparkSession, sf: str) -> DataFrame:
    page = select(_tickets(spark, sf), Select(paths=["state"], order_by="to_string(state)", offset=40, limit=25), KEY)
    return page.select("artifact_id", "idx", F.get_json_object("item", "$['$.state']").alias("state"))


@R(
    "w2_byte_budget",
    _STATE
    + ", p as (select artifact_id, root_path, idx, '{\"$.state\":\"' || state || '\"}' item from (select distinct artifact_id, root_path, idx, state from s) order by artifact_id, root_path, idx limit 200), b as (select *, sum(length(item)) over (order by artifact_id, root_path, idx) bytes, row_number() over (order by artifact_id, root_path, idx) n from p) select artifact_id, idx, item from b where bytes <= 1000 or n = 1",
)
def w2_byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    return select(_tickets(spark, sf), Select(paths=["state"], limit=200, max_bytes=1000), KEY).select("artifact_id", "idx", "item")


@R(
    "w1_keep_first",
    _STATE + "select login, artifact_id, idx from (select *, row_number() over (partition by login order by artifact_id, root_path, idx) n from s where login is not null) where n = 1",
)
def w1_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of each login in chain order; one aggregate, no window."""
    login = jsonpath.get(F.col("v"), "$.user.login")
    rows = _tickets(spark, sf).where(login.isNotNull() & (type_name(login) != "null")).select(*KEY, F.when(type_name(login) == "string", login.cast("string")).otherwise(F.to_json(login)).alias("login"))
    return rows.groupBy("login").agg(F.min(F.struct(*KEY)).alias("k")).select("login", "k.artifact_id", "k.idx")


QUERIES, ORACLE = R.queries, R.sql
