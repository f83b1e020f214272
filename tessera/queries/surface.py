"""Queries of the code surface, metrics, and the star tables read as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.variants import once
from tessera.operators import code
from tessera.operators.filters import compile_filter
from tessera.operators.select import Select, select
from tessera.queries.registry import RECORDS, Registry
from tessera.session import table

R = Registry()

_CODE = """
def run(data, schema, params):
    stars = [r.get("stars") for r in data if isinstance(r, dict)]
    stars = [s for s in stars if isinstance(s, int) and not isinstance(s, bool)]
    return [{"n": len(stars), "most": max(stars)}] if stars else []
"""
_DISTINCT = "with r as (select artifact_id, min(record) record from artifact_records where json_valid(record) group by artifact_id, root_path, idx) "


def _first_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "artifact_records").where(F.try_parse_json("record").isNotNull())
    return rows.groupBy("artifact_id", "root_path", "idx").agg(F.min("record").alias("record"))


@R("x1_code_query", _DISTINCT + "select artifact_id, count(*)::bigint n, max((record->>'$.stars')::bigint) most from r where json_type(record, '$.stars') in ('UBIGINT', 'BIGINT') group by 1")
def x1_code_query(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's Python over each artifact's records."""
    items = code.run_grouped(_first_records(spark, sf), _CODE, ["artifact_id"]).where("error is null")
    return items.select("artifact_id", F.get_json_object("item", "$.n").cast("bigint").alias("n"), F.get_json_object("item", "$.most").cast("bigint").alias("most"))


@R("x1_code_rows", _DISTINCT + "select record->>'$.user.login' login, count(*)::bigint n from r where json_type(record, '$.user.login') = 'VARCHAR' group by 1")
def x1_code_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's Python that maps records, then an aggregation by the engine."""
    source = "def run(data, schema, params):\n    users = [r.get('user') for r in data if isinstance(r, dict)]\n    return [{'login': u['login']} for u in users if isinstance(u, dict) and isinstance(u.get('login'), str)]\n"
    items = code.run_rows(_first_records(spark, sf), source)
    return items.groupBy(F.get_json_object("item", "$.login").alias("login")).agg(F.count(F.lit(1)).alias("n"))


@R("x10_sampled_warning", "with m as (select artifact_id, arg_max(map_kind, (generation, ingested_at)) map_kind from artifacts group by 1) select artifact_id, case map_kind when 'partial' then 'SAMPLED' when 'none' then 'NO_ROOT' end warning from m where map_kind <> 'full'")
def x10_sampled_warning(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "artifacts").groupBy("artifact_id").agg(F.max_by("map_kind", F.struct("generation", "ingested_at")).alias("map_kind"))
    return kinds.where("map_kind <> 'full'").select("artifact_id", F.when(F.col("map_kind") == "partial", "SAMPLED").when(F.col("map_kind") == "none", "NO_ROOT").alias("warning"))


@R(
    "x10_warnings",
    """with a as (select artifact_id, arg_max(map_kind, (generation, ingested_at)) map_kind, arg_max(session_id, (generation, ingested_at)) session_id from artifacts group by 1),
    r as (select distinct artifact_id, root_path, dataset_hash, schema_hash from artifact_schema_roots),
    o as (select dataset_hash from r where dataset_hash is not null group by 1 having count(distinct artifact_id) > 1),
    m as (select session_id, root_path from r join a using (artifact_id) group by 1, 2 having count(distinct schema_hash) > 1)
    select artifact_id, 'SAMPLED' warning from a where map_kind = 'partial' union select artifact_id, 'NO_ROOT' from a where artifact_id not in (select artifact_id from r)
    union select artifact_id, 'OVERLAPPING_DATASETS' from r join o using (dataset_hash) union select artifact_id, 'MIXED_SCHEMAS' from r join a using (artifact_id) join m on m.root_path = r.root_path and m.session_id is not distinct from a.session_id""",
)
def x10_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What callers of code over a session's artifacts are warned of: samples, missing roots, equal datasets, schemas that differ."""
    now = table(spark, sf, "artifacts").groupBy("artifact_id").agg(*[F.max_by(c, F.struct("generation", "ingested_at")).alias(c) for c in ("map_kind", "session_id")])
    return code.warnings(now, table(spark, sf, "artifact_schema_roots"))


@R("a18_histogram", "select event_type, count(*)::bigint n, round(min(value), 4) least, round(max(value), 4) most, round(sum(value), 2) total, round(avg(value), 4) mean from events group by 1")
def a18_histogram(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"), F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 4).alias("mean"))


@R("a19_percentiles", "select event_type, round(quantile_cont(value, 0.5), 4) p50, round(quantile_cont(value, 0.95), 4) p95, round(quantile_disc(value, 0.9), 4) p90_nearest from events group by 1")
def a19_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda kind, p: F.round(F.expr(f"percentile_{kind}({p}) within group (order by value)"), 4)
    return table(spark, sf, "events").groupBy("event_type").agg(q("cont", 0.5).alias("p50"), q("cont", 0.95).alias("p95"), q("disc", 0.9).alias("p90_nearest"))


@R("c8_select_orders", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000 order by o_totalprice desc, o_orderkey limit 50")
def c8_select_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The select operator over a table read as JSON records."""
    rows = table(spark, sf, "orders").select("o_orderkey", once(F.parse_json(F.to_json(F.struct("*")))).alias("v"))
    where = {"logic": "and", "filters": [{"path": "$.o_orderstatus", "op": "eq", "value": "F"}, {"path": "$.o_totalprice", "op": "gt", "value": 100000}]}
    page = select(rows, Select(paths=["o_orderkey", "o_totalprice"], where=where, order_by="to_number(o_totalprice) DESC", limit=50), ["o_orderkey"])
    return page.select("o_orderkey", F.get_json_object("item", "$['$.o_totalprice']").cast("double").alias("o_totalprice"))


@R("f3_json_column", "select event_id, (props->>'$.k')::bigint k from events where (props->>'$.k')::bigint > 50")
def f3_json_column(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate on a JSON column beside typed ones."""
    rows = table(spark, sf, "events").select("event_id", once(F.try_parse_json("props")).alias("v"))
    return rows.where(compile_filter({"path": "$.k", "op": "gt", "value": 50}, F.col("v"))).select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@R("u1_nested_orders", "select o_orderkey, count(*)::bigint lines, round(sum(l_extendedprice), 2) total from orders join lineitem on l_orderkey = o_orderkey group by 1")
def u1_nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines nested, then flattened again and summed."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_extendedprice")).alias("lines"))
    nested = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("lines").alias("x"))
    return nested.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("x.l_extendedprice"), 2).alias("total"))


@R("j15_cross_join", "select n_name, count(*)::bigint customers, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1")
def j15_cross_join(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@R("j16_semi_join", "select count(*)::bigint n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def j16_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(rich, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@R("stream_window_counts", "select date_trunc('day', ts) as day, event_type, count(*)::bigint n from events group by 1, 2")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of event time that the streaming reader keeps, over a finished table."""
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("day"), "event_type", "n")


@R("o3_mixed_order", RECORDS + "select distinct artifact_id, idx, j->>'$.blood_group' v from r where json_type(j, '$.blood_group') in ('VARCHAR', 'UBIGINT') order by v, artifact_id, idx limit 40")
def o3_mixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Values of mixed types ordered by their text."""
    from tessera.functions import jsonpath
    from tessera.functions.variants import type_name
    from tessera.queries.registry import records

    rows = records(spark, sf).where(type_name(jsonpath.get(F.col("v"), "$.blood_group")).isin("string", "number")).dropDuplicates(["artifact_id", "root_path", "idx"])
    page = select(rows, Select(paths=["blood_group"], order_by="to_string(blood_group)", limit=40), ["artifact_id", "idx"])
    return page.select("artifact_id", "idx", F.get_json_object("item", "$['$.blood_group']").alias("v"))


@R("d5_difference", "select artifact_id from artifact_records where artifact_id is not null except select artifact_id from artifact_schema_roots")
def d5_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts with records but no profile."""
    known = table(spark, sf, "artifact_schema_roots").select("artifact_id")
    return table(spark, sf, "artifact_records").where("artifact_id is not null").select("artifact_id").distinct().join(known, "artifact_id", "left_anti")


@R("d2_chain_union", "with c as (select artifact_id, arg_max(session_id, (generation, ingested_at)) session_id from artifacts group by 1) select session_id, count(*)::bigint records from artifact_records join c using (artifact_id) group by 1")
def d2_chain_union(spark: SparkSession, sf: str) -> DataFrame:
    """The records of all captures of a session as one set: one scan, no union of parts."""
    sessions = table(spark, sf, "artifacts").groupBy("artifact_id").agg(F.max_by("session_id", F.struct("generation", "ingested_at")).alias("session_id"))
    return table(spark, sf, "artifact_records").select("artifact_id").join(sessions, "artifact_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("records"))


QUERIES, ORACLE = R.queries, R.sql
