"""Queries of pagination over generated pages: every path, header and argument name takes its turn along the orders' keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.variants import at, once
from tessera.operators import nextpage, pages
from tessera.queries.registry import Registry
from tessera.session import spread, table

R = Registry()
_MARK = "@"


def _page(path: str, value: object = _MARK) -> str:
    """A page that has one value, at a path."""
    for name in reversed(path.split(".")[1:]):
        value = {name: value}
    return json.dumps(value)


def _turns(spark: SparkSession, sf: str, templates: list[str]) -> DataFrame:
    """(o_orderkey, k, turn, page): the templates in turn, the order's key put in for the mark; ``turn`` counts the rounds through them."""
    rows = spread(table(spark, sf, "orders").select("o_orderkey")).withColumn("k", (F.col("o_orderkey") % len(templates)).cast("int"))
    rows = rows.withColumn("turn", F.floor(F.col("o_orderkey") / len(templates)))
    return rows.withColumn("page", _filled(templates))


def _filled(templates: list[str]) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, templates)), F.col("k") + 1), F.lit(_MARK), F.col("o_orderkey").cast("string"))


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _none() -> Column:
    return F.lit(None).cast("string")


@R(
    "g4_cursor_paths",
    f"""with spec(k, first_name, last_name, sure) as {_values([(i, n.split()[0], n.split()[-1], c) for i, (_, n, c) in enumerate(nextpage.CURSORS)])},
    o as (select o_orderkey, (o_orderkey // {len(nextpage.CURSORS)}) % 4 turn, first_name, last_name, sure from orders join spec on k = o_orderkey % {len(nextpage.CURSORS)})
    select o_orderkey, case when turn = 2 then 'COMPLETE' else 'PARTIAL' end state, case when turn <> 2 then json_object(case turn when 1 then last_name else first_name end, 'c' || o_orderkey)::varchar end params,
      case when turn = 2 then 0.0 else sure end::double confidence, turn = 2 stuck from o""",
)
def g4_cursor_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every cursor path, for requests with none, the last, the same and another argument; repeated cursors are stuck."""
    first, last = [n.split()[0] for _, n, _ in nextpage.CURSORS], [n.split()[-1] for _, n, _ in nextpage.CURSORS]
    rows = _turns(spark, sf, [_page(p, "c@") for p, _, _ in nextpage.CURSORS])
    turn = F.col("turn") % 4
    args = F.when(turn == 1, _filled([json.dumps({n: "old"}) for n in last])).when(turn == 2, _filled([json.dumps({n: "c@"}) for n in first])).when(turn == 3, F.lit('{"LIMIT":5}'))
    return rows.withColumn("a", nextpage.assessment(first=False)("page", args, _none())).select("o_orderkey", "a.state", "a.params", "a.confidence", "a.stuck")


_FLAGS = [*nextpage.HAS_NEXT, *nextpage.HAS_MORE, *nextpage.IS_LAST]
_NEXT = [*nextpage.NEXT_VALUE, *("$.result" + p[1:] for p in nextpage.NEXT_VALUE)]


@R(
    "g2_has_more",
    f"""select o_orderkey, case when k >= {len(_FLAGS)} - {len(nextpage.IS_LAST)} and k < {len(_FLAGS)} then not odd else odd end more
    from (select o_orderkey, o_orderkey % {len(_FLAGS) + len(_NEXT)} k, (o_orderkey // {len(_FLAGS) + len(_NEXT)}) % 2 = 1 odd from orders)""",
)
def g2_has_more(spark: SparkSession, sf: str) -> DataFrame:
    """Every path that says whether more follows, with a yes and a no."""
    yes = [_page(p, True) for p in _FLAGS] + [_page(p, "n@") for p in _NEXT]
    no = [_page(p, False) for p in _FLAGS] + [_page(p, " ") for p in _NEXT]
    rows = _turns(spark, sf, yes).withColumn("page", F.when(F.col("turn") % 2 == 1, F.col("page")).otherwise(_filled(no)))
    return rows.select("o_orderkey", nextpage.assessment()("page", _none(), _none())["has_more"].alias("more"))


_URLS = [*nextpage.NEXT_URL, *("$.result" + p[1:] for p in nextpage.NEXT_URL)]


@R(
    "g5_next_url",
    f"""select o_orderkey, case (o_orderkey // {len(_URLS)}) % 3 when 0 then json_object('after', 'k' || o_orderkey) when 1 then json_object('After', 'k' || o_orderkey, 'limit', 2) end::varchar params,
    case (o_orderkey // {len(_URLS)}) % 3 when 0 then 0.9 when 1 then 0.97 else 0 end::double confidence, (o_orderkey // {len(_URLS)}) % 3 = 2 stuck from orders""",
)
def g5_next_url(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of a next address: parameters under the request's own names and types, private ones left out, no step back to the same place."""
    rows = _turns(spark, sf, [_page(p, "/p?after=k@&limit=2&access_token=z&x=1") for p in _URLS])
    turn = F.col("turn") % 3
    same = F.replace(F.lit('{"after":"k@"}'), F.lit(_MARK), F.col("o_orderkey").cast("string"))
    args = F.when(turn == 1, F.lit('{"After":"old","limit":5}')).when(turn == 2, same)
    return rows.withColumn("a", nextpage.assessment()("page", args, _none())).select("o_orderkey", "a.params", "a.confidence", "a.stuck")


@R(
    "g6_next_object",
    f"""select o_orderkey, case (o_orderkey // {len(nextpage.NEXT_OBJECT)}) % 2 when 0 then json_object('cursor', 'n' || o_orderkey) else json_object('Cursor', 'n' || o_orderkey, 'size', 3) end::varchar params,
    case (o_orderkey // {len(nextpage.NEXT_OBJECT)}) % 2 when 0 then 0.85 else 0.8 end::double confidence from orders""",
)
def g6_next_object(spark: SparkSession, sf: str) -> DataFrame:
    """Next objects: their cursors and what the request has arguments for; flags and blanks are neither."""
    rows = _turns(spark, sf, [_page(p, {"cursor": "n@", "size": 3, "flag": True, "token": " "}) for p in nextpage.NEXT_OBJECT])
    args = F.when(F.col("turn") % 2 == 1, F.lit('{"Cursor":"old","size":9}'))
    return rows.withColumn("a", nextpage.assessment()("page", args, _none())).select("o_orderkey", "a.params", "a.confidence")


_HEADERS = [*nextpage.HEADER_URLS, "link", *nextpage.HEADER_CURSORS]
_TOKEN_NAME = [next((n[0] for part, n in nextpage.TOKEN_NAMES.items() if part in h), nextpage.CURSOR_NAMES[0]) for h in nextpage.HEADER_CURSORS]


@R(
    "g7_headers",
    f"""with spec(k, name, strategy, sure) as {_values([(i, "page", "header_link" if h == "link" else "header_next_url", 0.97) for i, h in enumerate(_HEADERS[:5])] + [(5 + i, n, "header_cursor", 0.88) for i, n in enumerate(_TOKEN_NAME)])}
    select o_orderkey, true has_more, strategy, sure::double confidence, case when k < 5 then json_object(name, o_orderkey) else json_object(name, 'h' || o_orderkey) end::varchar params
    from orders join spec on k = o_orderkey % {len(_HEADERS)}""",
)
def g7_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Every header that names the next page, by address, link or cursor; its being there says that more follows."""
    url = "https://h/p?page=@&sig=1"
    value = lambda h: ['<https://h/p?page=1>; rel="first"', f'<{url}>; title="a,b"; rel="x next"'] if h == "link" else [url] if h in nextpage.HEADER_URLS else "h@"
    rows = _turns(spark, sf, [json.dumps({"response_headers": {h.upper(): value(h)}}) for h in _HEADERS])
    rows = rows.withColumn("a", nextpage.assessment()(F.lit("{}"), F.lit('{"page":-1}'), "page"))
    return rows.select("o_orderkey", "a.has_more", "a.strategy", "a.confidence", "a.params")


_STEPS = [(limit, name) for limit in nextpage.LIMITS for name in [*nextpage.OFFSETS, *nextpage.PAGES]]


@R(
    "g8_numbers",
    f"""with spec(k, name, step, sure) as {_values([(i, n, 2 if n in nextpage.OFFSETS else 1, 0.72 if n in nextpage.OFFSETS else 0.68) for i, (_, n) in enumerate(_STEPS)])}
    select o_orderkey, case when (o_orderkey // {len(_STEPS)}) % 2 = 0 then json_object(name, o_orderkey + step)::varchar end params, case when (o_orderkey // {len(_STEPS)}) % 2 = 0 then sure else 0 end::double confidence
    from orders join spec on k = o_orderkey % {len(_STEPS)}""",
)
def g8_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a limit with an offset or page argument: numbers go on after a full page and only then."""
    rows = _turns(spark, sf, [json.dumps({limit: 2, name: "@"}).replace('"@"', "@") for limit, name in _STEPS])
    body = F.when(F.col("turn") % 2 == 0, F.lit('{"items":[1,2]}')).otherwise(F.lit('{"items":[1]}'))
    return rows.withColumn("a", nextpage.assessment()(body, "page", _none())).select("o_orderkey", "a.params", "a.confidence")


_CONFIGS = {
    "cursor": {"strategy": "cursor", "cursor_response_path": "$.meta.next", "cursor_param_name": "from_id", "has_more_response_path": "$.meta.more"},
    "offset": {"strategy": "offset", "offset_param_name": "skip", "page_size_param_name": "take"},
    "page_number": {"strategy": "page_number", "page_param_name": "p"},
    "param_map": {"strategy": "param_map", "next_params_response_paths": {"a": "$.meta.next", "b": "$.meta.n"}},
}


@R(
    "g11_configured",
    """select o_orderkey, 'cursor' strategy, case when o_orderkey % 3 = 0 then 'PARTIAL' else 'COMPLETE' end state, case when o_orderkey % 3 = 0 then json_object('from_id', 'm' || o_orderkey)::varchar end params from orders
    union all select o_orderkey, 'offset', 'PARTIAL', json_object('skip', o_orderkey + 10)::varchar from orders
    union all select o_orderkey, 'page_number', 'PARTIAL', '{"p":2}' from orders
    union all select o_orderkey, 'param_map', 'PARTIAL', json_object('a', 'm' || o_orderkey, 'b', o_orderkey)::varchar from orders""",
)
def g11_configured(spark: SparkSession, sf: str) -> DataFrame:
    """The configured strategies on one kind of page."""
    key = F.col("o_orderkey").cast("string")
    rows = spread(table(spark, sf, "orders").select("o_orderkey"))
    page = F.concat(F.lit('{"meta":{"next":"m'), key, F.lit('","n":'), key, F.lit(',"more":'), F.when(F.col("o_orderkey") % 3 == 0, '"yes"').otherwise("[]"), F.lit("}}"))
    args = F.concat(F.lit('{"skip":'), key, F.lit(',"take":10}'))
    out = [rows.withColumn("a", nextpage.assessment(config)(page, args, _none())).select("o_orderkey", F.lit(name).alias("strategy"), "a.state", "a.params") for name, config in _CONFIGS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_PAGE = """case o_orderkey % 5 when 0 then '{"has_more":true,"next_cursor":"c' || o_orderkey || '","items":[1,2]}'
  when 1 then '{"result":{"pageInfo":{"hasNextPage":false}},"data":[]}' when 2 then '{"paging":{"next":"https://h/p?after=k' || o_orderkey || '&limit=2"},"items":[1]}'
  when 3 then '{"isLast":true,"items":[]}' else '{"items":[1,2,3]}' end"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", F.expr(_PAGE).alias("page"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("o_orderkey", once(F.parse_json("page")).alias("v"))


@R(
    "g1_assess",
    """select o_orderkey, case when o_orderkey % 5 in (1, 3) then 'COMPLETE' else 'PARTIAL' end state, case when o_orderkey % 5 not in (1, 3) then 'MORE_PAGES_AVAILABLE' end reason,
    case o_orderkey % 5 when 0 then 'cursor_path' when 2 then 'next_url_query' when 4 then 'numeric_args' when 1 then null when 3 then null end strategy,
    case o_orderkey % 5 when 0 then json_object('next_cursor', 'c' || o_orderkey) when 2 then json_object('after', 'k' || o_orderkey, 'limit', 2) when 4 then json_object('offset', o_orderkey + 3) end::varchar params from orders""",
)
def g1_assess(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of several kinds: whether they are the last, and how to ask for the next."""
    args = F.concat(F.lit('{"limit":3,"offset":'), F.col("o_orderkey").cast("string"), F.lit("}"))
    return _texts(spark, sf).withColumn("a", nextpage.assessment()("page", args, _none())).select("o_orderkey", "a.state", "a.reason", "a.strategy", "a.params")


@R(
    "g13_next_requests",
    """select 'o' || o_orderkey parent_artifact_id, (case when o_orderkey % 3 = 0 then 0 else o_orderkey % 7 end + 1)::bigint chain_seq,
    case o_orderkey % 5 when 0 then json_object('limit', 3, 'next_cursor', 'c' || o_orderkey, 'offset', o_orderkey) when 2 then json_object('after', 'k' || o_orderkey, 'limit', 2, 'offset', o_orderkey) else json_object('limit', 3, 'offset', o_orderkey + 3) end::varchar args
    from orders where o_orderkey % 5 not in (1, 3)""",
)
def g13_next_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that continue every chain of pages: merged arguments, the next place, the page before as parent."""
    key = F.col("o_orderkey").cast("string")
    rows = _texts(spark, sf).select("page", F.concat(F.lit('{"limit":3,"offset":'), key, F.lit("}")).alias("args"), F.concat(F.lit("o"), key).alias("artifact_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7).cast("bigint").alias("chain_seq"))
    return nextpage.next_requests(rows, nextpage.assessment()("page", "args", _none()), "args")


@R("g12_truth", "select o_orderkey, o_orderkey % 5 = 0 more from orders")
def g12_truth(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("o_orderkey", pages.is_true(at(F.col("v"), "$.has_more")).alias("more"))


@R("d6_page_merge", "select o_custkey, sum(case o_orderkey % 5 when 0 then 2 when 2 then 1 when 4 then 3 else 0 end)::bigint merged from orders group by 1 having sum(case o_orderkey % 5 when 0 then 2 when 2 then 1 when 4 then 3 else 0 end) > 0")
def d6_page_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a customer's pages one after the other."""
    rows = _pages(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return pages.merge_pages(rows, "o_custkey", ["o_orderkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("merged"))


@R("d6_latest_wrapper", "with p as (select o_custkey, max(o_orderkey) k from orders group by 1) select o_custkey, case k % 5 when 0 then true end more from p")
def d6_latest_wrapper(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    w = pages.merged_wrapper(rows, "o_custkey", ["o_orderkey"])
    return w.select("o_custkey", F.get_json_object("wrapper", "$.has_more").cast("boolean").alias("more"))


QUERIES, ORACLE = R.queries, R.sql
