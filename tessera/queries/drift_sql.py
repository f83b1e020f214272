"""SQL of the queries of problem 2: paths as lists of normal steps, types as sorted sets, renames by depth."""

from __future__ import annotations

PATHS = r"""
with recursive art as (select artifact_id, arg_max(upstream_instance_id, (generation, ingested_at)) u, arg_max(source_tool, (generation, ingested_at)) t, arg_max(created_seq, (generation, ingested_at)) q from artifacts group by 1),
prof as (select distinct artifact_id, root_key from artifact_schema_roots where lower(trim(mode, e' \t\r\n')) = 'exact' and lower(trim(completeness, e' \t\r\n')) = 'complete'),
pair as (select * from (select artifact_id, root_key, lag(artifact_id) over (partition by u, t, root_key order by q nulls first, artifact_id) prev from prof join art using (artifact_id)) where prev is not null),
raw as (
  select artifact_id, root_key, types, list_transform(
    regexp_extract_all(case when field_path[1] in ('$', '.', '[') then field_path else '.' || field_path end, '\.[^.\[\]]+|\[\s*''(?:[^''\\]|\\.)*''\s*\]|\[\s*"(?:[^"\\]|\\.)*"\s*\]|\[\s*\*\s*\]|\[\s*\d+\s*\]'),
    lambda x: case when x[1] = '.' then x[2:] when x[2] = '*' then '[*]' else regexp_replace(x, '^\[\s*.|.\s*\]$', '', 'g') end) names
  from artifact_schema_fields where artifact_id is not null and root_key is not null and field_path is not null),
"""
_COLUMNS = PATHS + r"""
col as (
  select artifact_id, root_key, steps, list_sort(list_distinct(flatten(list(types)))) types from (
    select artifact_id, root_key,
      list_transform(names, lambda n: case when n = '[*]' then n when regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_]*') then '.' || n else '[''' || n || ''']' end) steps,
      list_filter(regexp_extract_all(lower(coalesce(types, '')), '[a-z]+'), lambda x: x <> 'null') types from raw) group by all),
"""
_CHANGES = _COLUMNS + """
o as (select p.artifact_id, p.root_key, steps, types from pair p join col c on c.artifact_id = p.prev and c.root_key = p.root_key),
n as (select p.artifact_id, p.root_key, steps, types from pair p join col c on c.artifact_id = p.artifact_id and c.root_key = p.root_key),
gone as (select *, steps[:-2] parent, count(*) over (partition by artifact_id, root_key, steps[:-2], types) m from o anti join n using (artifact_id, root_key, steps) where len(steps) > 0),
come as (select *, steps[:-2] parent, count(*) over (partition by artifact_id, root_key, steps[:-2], types) m from n anti join o using (artifact_id, root_key, steps) where len(steps) > 0),
ren as (
  select g.artifact_id, g.root_key, g.steps a, c.steps b from gone g join come c using (artifact_id, root_key, parent, types) where g.m = 1 and c.m = 1
  union
  select artifact_id, root_key, g.steps, c.steps from ren join gone g using (artifact_id, root_key) join come c using (artifact_id, root_key, types) where g.parent = ren.a and c.parent = ren.b and g.steps[-1] = c.steps[-1]),
found as (
  select artifact_id, root_key, 'retyped' change, steps a, null b from n join o using (artifact_id, root_key, steps) where n.types <> o.types
  union all select artifact_id, root_key, 'renamed', b, a from ren
  union all select artifact_id, root_key, 'removed', steps, null from gone anti join (select artifact_id, root_key, a steps from ren) using (artifact_id, root_key, steps)
  union all select artifact_id, root_key, 'added', steps, null from come anti join (select artifact_id, root_key, b steps from ren) using (artifact_id, root_key, steps))
"""

ORACLE = {"p2_found": _CHANGES + "select artifact_id, root_key, change, '$' || array_to_string(a, '') field_path, coalesce('$' || array_to_string(b, ''), '') other_path from found"}

ORACLE["p3_field_paths"] = (
    PATHS.rstrip().rstrip(",")
    + """, stepped as (select artifact_id, root_key, list_transform(names, lambda n: case when n = '[*]' then n when regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_]*') then '.' || n else '[''' || n || ''']' end) s from raw),
placed as (select *, coalesce(list_max(list_filter(range(1, len(s)), lambda i: s[i] = '[*]')), 0) i from stepped)
select distinct artifact_id, root_key, '$' || array_to_string(s, '') node_path, '$' || array_to_string(s[:i], '') parent_path, array_to_string(s[i + 1:], '') field from placed"""
)
