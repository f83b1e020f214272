"""SQL of the queries of problem 3: a recursive walk over JSON that opens strings holding objects or arrays."""

from __future__ import annotations

_INNER = ["(x->>'$')", "(try_cast(x->>'$' as json)->>'$')", "(try_cast(try_cast(x->>'$' as json)->>'$' as json)->>'$')"]


def _held(layer: int = 1) -> str:
    """What a string holds after one to three layers, with the layers left; null if it is no object or array."""
    if layer > 3:
        return "null"
    text = _INNER[layer - 1]
    return f"""case when layers >= {layer} and json_valid({text}) then
      case when json_type({text}) in ('OBJECT', 'ARRAY') then {{'v': try_cast({text} as json), 'l': layers - {layer}}}
           when json_type({text}) = 'VARCHAR' then {_held(layer + 1)} end end"""


_OPEN = f"case when json_type(x) = 'VARCHAR' then {_held()} end"
_STEP = r"""case when t = 'ARRAY' then '[' || key || ']' when regexp_full_match(key, '[A-Za-z_][A-Za-z0-9_]*') then '.' || key
  else '[''' || replace(replace(replace(replace(replace(key, '\', '\\'), '''', '\'''), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || ''']' end"""

_RECORDS = "select distinct {'a': artifact_id, 'r': root_path, 'i': idx} k, record::json x, 3 layers from artifact_records where json_valid(record)"
_ENVELOPES = "select distinct payload_hash_full k, envelope::json x, 3 layers from payload_blobs where json_valid(envelope)"


def _walk(source: str) -> str:
    """n: every value v with its path, its place, the row it belongs to (with parent and place) and its field there."""
    return f"""with recursive s as ({source}),
n as (
  select k, '$' path, '$' place, '$' node_path, null::varchar parent_path, '$' row_place, '' field, coalesce(o.v, x) v, coalesce(o.l, layers) layers, false el from (select *, {_OPEN} o from s)
  union all
  select k, path || step, place || case when t = 'ARRAY' then '[*]' else step end,
    case when t = 'ARRAY' then path || step else node_path end,
    case when t <> 'ARRAY' then parent_path when field <> '' or (el and json_type(n_v) = 'OBJECT') then node_path else coalesce(parent_path, '$') end,
    case when t = 'ARRAY' then place || '[*]' else row_place end,
    case when t = 'ARRAY' then '' when field = '' and step[1] = '.' then step[2:] else field || step end,
    coalesce(o.v, x), coalesce(o.l, layers), t = 'ARRAY'
  from (select *, {_STEP} step, {_OPEN} o from (
    select n.* exclude (v), n.v n_v, json_type(n.v) t, e.key, e.value x from n, json_each(case when json_type(n.v) in ('OBJECT', 'ARRAY') then n.v else '[]'::json end) e))
)"""


_KEYS = "k.a artifact_id, k.r root_path, k.i idx"
#: The values that are no row and hold nothing: scalars, empty arrays, and empty objects that are members.
_CELLS = """, c as (
  select distinct k, node_path, parent_path, row_place place, case when field = '' then 'value' else field end field, v,
    case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end kind
  from n where case json_type(v) when 'OBJECT' then field <> '' and len(json_keys(v)) = 0 when 'ARRAY' then json_array_length(v) = 0 else true end)"""
_ROWS = """, w as (select distinct k, node_path, parent_path, row_place place from n where field = '' and not (json_type(v) = 'ARRAY' and json_array_length(v) > 0))"""


def _table(place: str, columns: dict[str, tuple[str, str]]) -> str:
    """The typed table of a place: column name -> (field, type)."""
    shown = ", ".join(f"max(case when field = '{f}' then v->>'$' end)::{t} {n}" for n, (f, t) in columns.items())
    return _walk(_RECORDS) + _ROWS + _CELLS + f" select {_KEYS}, w.node_path, w.parent_path, {shown} from w left join c using (k, node_path) where w.place = '{place}' group by all"


ORACLE = {
    "p3_found": _walk(_RECORDS) + f" select distinct {_KEYS}, node_path, coalesce(parent_path, '$') parent_path from n where el and json_type(v) = 'OBJECT'",
    "p3_cells": _walk(_RECORDS) + _CELLS + f" select {_KEYS}, node_path, parent_path, place, field, kind, case when kind not in ('number', 'null') then v->>'$' end \"text\", case when kind = 'number' then (v->>'$')::double end number from c",
    "p3_columns": _walk(_RECORDS)
    + _CELLS
    + """ select place, field, case when sum((kind = 'number')::int) = sum((kind <> 'null')::int) and sum((kind = 'number')::int) > 0
    then case when bool_and(kind = 'null' or json_type(v) in ('UBIGINT', 'BIGINT')) then 'bigint' else 'double' end
    when sum((kind = 'boolean')::int) = sum((kind <> 'null')::int) and sum((kind = 'boolean')::int) > 0 then 'boolean' else 'string' end as type,
    count(*)::bigint n, sum((kind = 'null')::int)::bigint nulls from c group by 1, 2""",
    "p3_envelope_cells": _walk(_ENVELOPES) + _CELLS + " select place, field, kind, count(*)::bigint n from c group by all",
    "p3_table_releases": _table("$.releases[*]", {"tag": ("tag", "varchar"), "assets": ("assets", "varchar")}),
    "p3_table_assets": _table("$.releases[*].assets[*]", {"file": ("file", "varchar"), "size": ("size", "bigint"), "links_html": ("links.html", "varchar"), "links_self": ("links.self", "varchar")}),
    "p3_table_coordinates": _table("$.geometry.coordinates[*]", {"value": ("value", "double")}),
}
