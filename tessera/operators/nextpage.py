"""What a response says about the page after it, and how to ask for that page.

Every source of a hint (addresses of a next page, cursors, next objects, headers, the request's own
numbers) makes offers: argument values that would move the request on. The first offer that changes
the request's position wins; an offer that only repeats it is remembered, and is why a response with
no better one counts as stuck. Runs in Arrow batches, one page at a time; pages never meet.

Defined results: a page, request or header block that is null or no JSON object counts as empty (a page
may also be an array); blank strings and booleans are no cursors; a signal of the body goes before one
of the headers; numbers only progress if more is signalled or the page is full.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import parse_qsl, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

# Where bodies and headers say whether there is more and where it starts, and how arguments are called.
HAS_NEXT = "$.has_next $.hasNext $.has_next_page $.hasNextPage $.paging.has_next $.paging.hasNext $.paging.has_next_page $.paging.hasNextPage $.page_info.has_next_page $.pageInfo.hasNextPage $.result.page_info.has_next_page $.result.pageInfo.hasNextPage".split()
HAS_MORE = "$.has_more $.hasMore $.paging.has_more $.paging.hasMore $.pagination.has_more $.pagination.hasMore $.meta.has_more $.meta.hasMore $.result.has_more $.result.hasMore $.result.paging.has_more $.result.paging.hasMore $.result.pagination.has_more $.result.pagination.hasMore".split()
IS_LAST = "$.is_last $.isLast $.last_page $.lastPage $.paging.is_last $.paging.isLast $.paging.last_page $.paging.lastPage $.page_info.is_last_page $.pageInfo.isLastPage $.result.page_info.is_last_page $.result.pageInfo.isLastPage".split()
NEXT_VALUE = "$.next $.next_page $.nextPage $.next_url $.nextUrl $.paging.next $.paging.next_url $.paging.nextUrl $.pagination.next $.pagination.next_url $.pagination.nextUrl $.links.next $.links.next.href".split()
NEXT_URL = "$.paging.next $.paging.next_url $.paging.nextUrl $.pagination.next $.pagination.next_url $.pagination.nextUrl $.links.next $.links.next.href $.next $.next_url $.nextUrl".split()
NEXT_OBJECT = "$.next $.paging.next $.pagination.next $.result.next $.result.paging.next $.result.pagination.next".split()
RECORDS = "$.data $.results $.items $.records $.entries $.nodes $.result.data $.result.items".split()
CURSORS = (
    ("$.result.paging.cursors.after", "after cursor", 0.99),
    ("$.result.paging.after", "after cursor", 0.95),
    ("$.result.paging.next_cursor", "next_cursor cursor after", 0.94),
    ("$.result.paging.nextCursor", "nextCursor cursor after", 0.94),
    ("$.result.pagination.next_cursor", "next_cursor cursor after", 0.93),
    ("$.result.pagination.nextCursor", "nextCursor cursor after", 0.93),
    ("$.paging.cursors.after", "after cursor", 0.99),
    ("$.paging.after", "after cursor", 0.95),
    ("$.paging.next_cursor", "next_cursor cursor after", 0.94),
    ("$.paging.nextCursor", "nextCursor cursor after", 0.94),
    ("$.pagination.next_cursor", "next_cursor cursor after", 0.93),
    ("$.pagination.nextCursor", "nextCursor cursor after", 0.93),
    ("$.next_cursor", "next_cursor cursor after", 0.9),
    ("$.nextCursor", "nextCursor cursor after", 0.9),
    ("$.result.next_cursor", "next_cursor cursor after", 0.9),
    ("$.result.nextCursor", "nextCursor cursor after", 0.9),
    ("$.cursor", "cursor after", 0.82),
    ("$.page_info.end_cursor", "after cursor end_cursor", 0.92),
    ("$.pageInfo.endCursor", "after cursor endCursor", 0.92),
    ("$.next_page_token", "next_page_token page_token token", 0.92),
    ("$.nextPageToken", "nextPageToken pageToken page_token token", 0.92),
    ("$.continuation_token", "continuation_token continuationToken page_token token", 0.9),
    ("$.continuationToken", "continuationToken continuation_token pageToken token", 0.9),
    ("$.response_metadata.next_page_token", "next_page_token page_token token", 0.88),
    ("$.result.next_page_token", "next_page_token page_token token", 0.88),
    ("$.result.response_metadata.next_page_token", "next_page_token page_token token", 0.88),
)
LIMITS = "limit per_page page_size pageSize max_results maxResults count".split()
OFFSETS = "offset skip start from".split()
PAGES = "page page_number pageNumber page_index pageIndex".split()
#: Spelled without case and separators.
POSITIONS = frozenset("after before cursor nextcursor pagetoken nextpagetoken continuationtoken token offset skip start page pagenumber pageindex".split())
SIZES = frozenset("limit perpage pagesize maxresults count".split())
PRIVATE = frozenset("accesstoken apikey fields signature sig".split())
HEADER_BLOCKS = ("headers", "response_headers", "http_headers")
HEADER_MORE = ("x-has-more", "x-has-next-page")
HEADER_URLS = ("x-next-page", "x-next-url", "next-page", "next-url")
HEADER_CURSORS = ("x-next-cursor", "x-cursor", "x-page-token", "x-next-page-token", "x-continuation-token")
CURSOR_NAMES = "after cursor nextCursor next_cursor pageToken token".split()
TOKEN_NAMES = {"page-token": "nextPageToken next_page_token pageToken page_token token".split(), "continuation": "continuationToken continuation_token pageToken page_token token".split()}
YES, NO = frozenset("1 true yes y on".split()), frozenset("0 false no n off".split())

_WRAPPED_VALUE = NEXT_VALUE + ["$.result" + p[1:] for p in NEXT_VALUE]
_WRAPPED_URL = NEXT_URL + ["$.result" + p[1:] for p in NEXT_URL]
_LINK = re.compile(r'<([^>]*)>((?:[^,"<]|"[^"]*")*)')
_REL = re.compile(r';\s*rel\s*=\s*(?:"([^"]*)"|([^;,\s]+))', re.IGNORECASE)


def read(value: Any, path: str) -> Any:
    """The value at a path of plain names; None if there is none."""
    for name in path.split(".")[1:]:
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


def spelling(name: str) -> str:
    return re.sub(r"[-_. ]", "", name.strip().lower())


def scalar(value: Any) -> bool:
    """Whether a value can be a cursor."""
    return value.strip() != "" if isinstance(value, str) else isinstance(value, (int, float)) and not isinstance(value, bool)


def like(raw: str, example: Any) -> Any:
    """A query value in the type of an example, the text itself if it does not fit."""
    if isinstance(example, bool):
        word = raw.strip().lower()
        return word in YES if word in YES | NO else raw
    if isinstance(example, (int, float)):
        try:
            return type(example)(raw)
        except ValueError:
            return raw
    return raw


class Request:
    """The arguments of the request a page answers, found under any spelling of their names."""

    def __init__(self, args: dict[str, Any]) -> None:
        self.args = args
        self.own: dict[str, str] = {}
        for name in args:
            self.own.setdefault(spelling(name), name)
        self.repeated = False

    def known(self, names: list[str]) -> list[str]:
        return [self.own[s] for s in map(spelling, names) if s in self.own]

    def number(self, names: list[str], least: int) -> tuple[str, int] | None:
        for name in self.known(names):
            value = self.args[name]
            if type(value) is int and value >= least:
                return name, value
        return None

    def offer(self, names: list[str], value: Any) -> dict[str, Any] | None:
        """A cursor for whichever of the names the request uses; None if it is where the request stands already."""
        known = self.known(names)
        if any(self.args[n] == value for n in known if spelling(n) not in SIZES):
            self.repeated = True
        if known and all(self.args[n] == value for n in known):
            return None
        return {known[0] if known else names[0]: value}

    def offer_query(self, url: str) -> tuple[dict[str, Any], float] | None:
        """The parameters of an address that are the request's or belong to paging, if they move it."""
        chosen: dict[str, Any] = {}
        moves = stays = False
        for name, raw in parse_qsl(urlparse(url).query):
            s = spelling(name)
            own = self.own.get(s)
            if not s or s in PRIVATE or (own is None and s not in POSITIONS):
                continue
            value = raw if own is None else like(raw, self.args[own])
            chosen[own or name] = value
            if s not in SIZES:
                if own is not None and value == self.args[own]:
                    stays = True
                else:
                    moves = True
        self.repeated |= stays and not moves
        return (chosen, 0.97 if self.args.keys() & chosen.keys() else 0.9) if moves else None

    def offer_object(self, fields: dict[str, Any]) -> tuple[dict[str, Any], float] | None:
        chosen: dict[str, Any] = {}
        for name, value in fields.items():
            if scalar(value):
                own = self.own.get(spelling(name))
                if own is None:
                    if spelling(name) in POSITIONS:
                        chosen[name] = value
                elif self.args[own] != value:
                    chosen[own] = value
                elif spelling(own) not in SIZES:
                    self.repeated = True
        return (chosen, 0.85 if len(chosen) == 1 else 0.8) if chosen else None


def _is_url(value: Any) -> bool:
    return isinstance(value, str) and ("://" in value or value.strip()[:1] in ("/", "?") or "?" in value) and bool(value.strip())


def headers_of(meta: Any) -> dict[str, str]:
    """Names in small letters -> text; of a list the first value, of links all."""
    block = next((meta[b] for b in HEADER_BLOCKS if isinstance(meta.get(b), dict)), {}) if isinstance(meta, dict) else {}
    out = {}
    for name, value in block.items():
        key = name.strip().lower()
        values = [str(v) for v in value if isinstance(v, (str, int, float))] if isinstance(value, list) else [value] if isinstance(value, str) else []
        if values:
            out[key] = ", ".join(values) if key == "link" else values[0]
    return out


def link_next(header: str) -> str | None:
    """The address with rel=next among the entries of a Link header."""
    for url, rest in _LINK.findall(header):
        if url.strip() and any("next" in (quoted or bare).lower().split() for quoted, bare in _REL.findall(rest)):
            return url.strip()
    return None


def _there(value: Any) -> bool | None:
    """Whether a next value is one; None if it is missing."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, dict):
        return any(bool(v.strip()) if isinstance(v, str) else bool(v) if isinstance(v, (bool, list, dict)) else isinstance(v, (int, float)) for v in value.values())
    return bool(value.strip()) if isinstance(value, str) else bool(value) if isinstance(value, list) else True


def more_of(page: Any, headers: dict[str, str]) -> bool | None:
    """Whether a response says that more follows; None if it does not say."""
    for paths, turned in ((HAS_NEXT, False), (HAS_MORE, False), (IS_LAST, True)):
        for path in paths:
            if isinstance(value := read(page, path), bool):
                return value != turned
    for path in _WRAPPED_VALUE:
        if (there := _there(read(page, path))) is not None:
            return there
    for key in HEADER_MORE:
        word = headers.get(key, "").strip().lower()
        if word in YES | NO:
            return word in YES
    if link_next(headers.get("link", "")) or any(headers.get(k, "").strip() for k in (*HEADER_URLS, *HEADER_CURSORS)):
        return True
    return None


def count_of(page: Any) -> int | None:
    """The number of records of a response: its own length, or that of its first usual list."""
    return next((len(v) for v in (page, *(read(page, p) for p in RECORDS)) if isinstance(v, list)), None)


def offers(page: Any, request: Request, headers: dict[str, str], more: bool | None) -> Iterator[tuple[dict[str, Any] | None, float, str]]:
    """All offers, the surest source first."""
    for path in _WRAPPED_URL:
        if _is_url(value := read(page, path)) and (found := request.offer_query(value.strip())):
            yield *found, "next_url_query"
    for path, names, confidence in CURSORS:
        if scalar(value := read(page, path)):
            yield request.offer(names.split(), value), confidence, "cursor_path"
    for path in NEXT_OBJECT:
        if isinstance(value := read(page, path), dict) and (found := request.offer_object(value)):
            yield *found, "next_object"
    if (link := link_next(headers.get("link", ""))) and (found := request.offer_query(link)):
        yield *found, "header_link"
    for key in HEADER_URLS:
        if key in headers and (found := request.offer_query(headers[key].strip())):
            yield *found, "header_next_url"
    for key in HEADER_CURSORS:
        if value := headers.get(key, "").strip():
            names = next((n for part, n in TOKEN_NAMES.items() if part in key), CURSOR_NAMES)
            yield request.offer(names, value), 0.88, "header_cursor"
    limit, count = request.number(LIMITS, 1), count_of(page)
    if more or (limit and count is not None and count >= limit[1]):
        if limit and (offset := request.number(OFFSETS, 0)):
            yield {offset[0]: offset[1] + limit[1]}, 0.72, "numeric_args"
        elif number := request.number(PAGES, 0):
            yield {number[0]: number[1] + 1}, 0.68, "numeric_args"


def configured(page: Any, args: dict[str, Any], config: dict[str, Any]) -> tuple[bool | None, dict[str, Any] | None]:
    """(more, params) by a configured strategy: cursor, offset, page_number or param_map."""
    signal = config.get("has_more_response_path")
    more = None
    if signal:
        value = read(page, signal)
        more = value if isinstance(value, bool) else value is not None and value != [] and not (isinstance(value, str) and not value.strip())
    whole = lambda name, default: v if type(v := args.get(name, default)) is int else default
    filled = lambda path: None if (v := read(page, path)) is None or (isinstance(v, str) and not v.strip()) else v
    params: dict[str, Any] | None = None
    if config["strategy"] == "cursor":
        value = filled(config.get("cursor_response_path") or "")
        params = None if value is None else {config.get("cursor_param_name") or "after": value}
    elif config["strategy"] == "offset":
        name, size = config.get("offset_param_name") or "offset", whole(config.get("page_size_param_name") or "limit", 0)
        params = {name: whole(name, 0) + size} if size > 0 else None
    elif config["strategy"] == "page_number":
        name = config.get("page_param_name") or "page"
        params = {name: whole(name, 1) + 1}
    elif config["strategy"] == "param_map":
        found = {n: filled(p) for n, p in (config.get("next_params_response_paths") or {}).items()}
        params = found if found and None not in found.values() else None
    return more, None if more is False else params


def assess(page: Any, args: dict[str, Any], meta: Any = None, config: dict[str, Any] | None = None, first: bool = True) -> tuple:
    """(state, reason, has_more, params, confidence, strategy, stuck) of a response.

    state: COMPLETE, PARTIAL, or None where a first page gives no hint at all. params: JSON text of the
    arguments to change. stuck: the only cursors there are repeat the request's own.
    """
    confidence, strategy, stuck = 0.0, None, False
    if config is not None:
        more, params = configured(page, args, config)
        strategy = config["strategy"]
    else:
        headers, request = headers_of(meta), Request(args)
        more, params = more_of(page, headers), None
        for params, confidence, strategy in offers(page, request, headers, more):
            if params:
                break
        if not params:
            params, confidence, strategy, stuck = None, 0.0, None, request.repeated
    shown = json.dumps(params, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if params else None
    if more is False:
        return "COMPLETE", None, more, None, confidence, strategy, stuck
    if params:
        return "PARTIAL", "MORE_PAGES_AVAILABLE", more, shown, confidence, strategy, stuck
    if more:
        return "PARTIAL", "NEXT_TOKEN_MISSING", more, None, confidence, strategy, stuck
    if config is not None:
        return "PARTIAL", "SIGNAL_INCONCLUSIVE", more, None, confidence, strategy, stuck
    return None if first else "COMPLETE", None, more, None, confidence, strategy, stuck


ASSESSMENT = StructType(
    [StructField(n, StringType()) for n in ("state", "reason")] + [StructField("has_more", BooleanType()), StructField("params", StringType()), StructField("confidence", DoubleType()), StructField("strategy", StringType()), StructField("stuck", BooleanType())]
)


def _json(text: str | None, kinds: tuple[type, ...] = (dict,)) -> Any:
    try:
        value = json.loads(text) if text else {}
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, kinds) else {}


def assessment(config: dict[str, Any] | None = None, first: bool = True):
    """A column function of page, arguments and response metadata (JSON texts) giving ``ASSESSMENT``."""

    @F.pandas_udf(ASSESSMENT)
    def run(pages: pd.Series, args: pd.Series, metas: pd.Series) -> pd.DataFrame:
        rows = [assess(_json(p, (dict, list)), _json(a), _json(m), config, first) for p, a, m in zip(pages, args, metas)]
        return pd.DataFrame(rows, columns=ASSESSMENT.names)

    return run


@F.pandas_udf(StringType())
def merged_arguments(args: pd.Series, params: pd.Series) -> pd.Series:
    """The arguments of the request for the next page: the request's own with the changed ones, as JSON text; null without any."""
    return pd.Series([None if p is None else json.dumps(_json(a) | _json(p), sort_keys=True, ensure_ascii=False, separators=(",", ":")) for a, p in zip(args, params)], dtype=object)


def next_requests(pages: DataFrame, assessment: Column, args: str, artifact: str = "artifact_id", chain_seq: str = "chain_seq") -> DataFrame:
    """(parent_artifact_id, chain_seq, args): what to ask for after each page that is not the last of its chain."""
    rows = pages.withColumn("_a", assessment).where("_a.params is not null")
    return rows.select(F.col(artifact).alias("parent_artifact_id"), (F.coalesce(F.col(chain_seq), F.lit(0)) + 1).alias("chain_seq"), merged_arguments(F.col(args), F.col("_a.params")).alias("args"))
