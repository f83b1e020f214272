"""Schemas that drift between captures.

Each profile's columns get a type set, sketches of their known values and of how these are written,
and a name; vanished and new columns of successive profiles of one series become the two sides of a
bipartite graph whose edges join columns of equal types under the same or a matched parent, weighted by
likeness. A maximum-weight matching picks the pairs. A pair that is the only possible one of its kind
weighs more than any two others, so likeness never breaks it: it is ``renamed``. Where several pairs are
possible likeness decides: such a pair is ``likely``, no change to be reported (both sides are, as
removed and added) but one column for the unified table.

Defined results: profiles whose mode is not exact or whose completeness is not complete (nulls
included) are passed over; repeated rows and both path notations of a column are one column, with
the union of their types; null types are the empty set; rows with a null path, artifact or root are
no columns; a series of one profile has no changes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from json.encoder import encode_basestring

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.operators.hierarchy import hierarchy
from tessera.operators.nesting import STRING_LAYERS, _reject, _utf8, unwrap
from tessera.operators.paths import bracket_name, name_step, normal_steps, show
from tessera.operators.references import BLANKS
from tessera.operators.series import as_of, with_previous
from tessera.session import cut_lineage

DIFFERENCES = "artifact_id string, root_key string, change string, field_path string, other_path string, likeness double"
_SKETCH = 8  # smallest hashes kept of a column
#: Likeness from which an ambiguous pair counts as one column.
LIKELY = 0.5
_CERTAIN, _MOVED = 4.0, 3.0  # weights above those of any two pairs that likeness speaks for


def type_set(raw: str | None) -> frozenset[str]:
    """The types of a field, however they are written; case and null do not count."""
    if raw is None:
        return frozenset()
    try:
        value = json.loads(raw)
    except ValueError:
        value = [x.strip(" \"'[]") for x in raw.split(",")]
    values = value if isinstance(value, list) else [value]
    return frozenset(x for x in (str(v).strip().lower() for v in values if v is not None) if x and x != "null")


def _smallest(values: set[str]) -> frozenset[int]:
    return frozenset(sorted(zlib.crc32(v.encode("utf-8", "replace")) for v in values)[:_SKETCH])


_RUNS = [(re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\W\dA-Z_]+"), "a"), (re.compile(r"\d+"), "9")]


def _shape(value: str) -> str:
    """How a value is written: runs of letters and digits as one character each."""
    for run, mark in _RUNS:
        value = run.sub(mark, value)
    return value


def value_sketch(example: str | None, distinct: str | None) -> tuple[frozenset[int], frozenset[int]]:
    """The smallest hashes of the values known of a column, and of their shapes."""
    values = {example} if example is not None else set()
    try:
        known = json.loads(distinct) if distinct else []
        values |= {v if isinstance(v, str) else json.dumps(v, sort_keys=True) for v in known} if isinstance(known, list) else {distinct}
    except ValueError:
        values.add(distinct)
    return _smallest(values), _smallest({_shape(v) for v in values})


def _grams(name: str) -> set[str]:
    text = f"^{name.strip('.').lower()}$"
    return {text[i : i + 2] for i in range(len(text) - 1)}


def _overlap(a: set | frozenset, b: set | frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def max_weight_matching(edges: dict[tuple[int, int], float]) -> dict[int, int]:
    """Left -> right of the matching of greatest total weight; ``edges`` has the weight (above 0) of each pair.

    Worked out for each connected component by itself, by shortest augmenting paths with potentials.
    """
    near: dict[tuple[str, int], list[tuple[str, int]]] = defaultdict(list)
    for i, j in edges:
        near["l", i].append(("r", j))
        near["r", j].append(("l", i))
    found: dict[int, int] = {}
    seen: set[tuple[str, int]] = set()
    for start in near:
        if start in seen:
            continue
        seen.add(start)
        part = [start]
        for node in part:
            for x in near[node]:
                if x not in seen:
                    seen.add(x)
                    part.append(x)
        left, right = sorted(i for side, i in part if side == "l"), sorted(j for side, j in part if side == "r")
        if len(left) == 1 == len(right):
            found[left[0]] = right[0]
            continue
        # leaving a node alone costs nothing, a pair earns its weight
        cost = np.zeros((len(left), len(left) + len(right)))
        place = {j: y for y, j in enumerate(right)}
        for x, i in enumerate(left):
            for _, j in near["l", i]:
                cost[x, place[j]] = -edges[i, j]
        for x, y in enumerate(_assign(cost)):
            if y < len(right) and (left[x], right[y]) in edges:
                found[left[x]] = right[y]
    return found


def _assign(cost: np.ndarray) -> list[int]:
    """The column of each row in the cheapest assignment; there are no fewer columns than rows."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            reduced = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            back[1:][better] = at
            open_slack = np.where(done, np.inf, slack)
            nearest = int(open_slack.argmin())
            step = open_slack[nearest]
            u[owner[done]] += step
            v[done] -= step
            slack[~done] -= step
            at = nearest
        while at:
            owner[at], at = owner[back[at]], back[at]
    out = [0] * n
    for y in range(1, m + 1):
        if owner[y]:
            out[owner[y] - 1] = y - 1
    return out


class Profile:
    """The columns of one capture: steps -> types, value sketch, shape sketch."""

    def __init__(self, columns: list[dict] | None):
        self.types: dict[tuple, frozenset] = {}
        self._columns: dict[tuple, list[dict]] = defaultdict(list)
        self._sketches: dict[tuple, tuple[frozenset, frozenset]] = {}
        for c in columns or []:
            steps = normal_steps(c["field_path"])
            self.types[steps] = self.types.get(steps, frozenset()) | type_set(c["types"])
            self._columns[steps].append(c)

    def sketches(self, steps: tuple) -> tuple[frozenset, frozenset]:
        if steps not in self._sketches:
            both = [value_sketch(c["example_value"], c["distinct_values"]) for c in self._columns[steps]]
            self._sketches[steps] = tuple(frozenset(sorted(frozenset().union(*part))[:_SKETCH]) for part in zip(*both))
        return self._sketches[steps]


def likeness(old: Profile, new: Profile, a: tuple, b: tuple) -> float:
    """0 to 1: half for the names, the rest for the way values are written and for the values."""
    (values_a, shapes_a), (values_b, shapes_b) = old.sketches(a), new.sketches(b)
    return 0.5 * _overlap(_grams(a[-1]), _grams(b[-1])) + 0.3 * _overlap(shapes_a, shapes_b) + 0.2 * _overlap(values_a, values_b)


def matches(old: Profile, new: Profile) -> dict[tuple, tuple[tuple, float, bool]]:
    """Old steps -> (new steps, likeness, whether the pair is the only possible one) of the columns that were renamed."""
    gone, come = [s for s in old.types if s not in new.types and s], [s for s in new.types if s not in old.types and s]
    cell_old, cell_new, moved_to = defaultdict(list), defaultdict(list), {}
    for s in gone:
        cell_old[s[:-1], old.types[s]].append(s)
    for s in come:
        cell_new[s[:-1], new.types[s]].append(s)
        moved_to[s] = new.types[s]
    found: dict[tuple, tuple[tuple, float, bool]] = {}
    taken: set[tuple] = set()
    # columns of one parent and one type set; parents come before what is in them
    for (parent, types), left in sorted(cell_old.items(), key=lambda c: len(c[0][0])):
        same = [b for b in cell_new.get((parent, types), ()) if b not in taken]
        only = len(left) == 1 == len(cell_new.get((parent, types), ()))
        above = found.get(parent)
        edges: dict[tuple[int, int], float] = {}
        right = list(same)
        place = {b: j for j, b in enumerate(right)}
        for i, a in enumerate(left):
            for j, b in enumerate(same):
                score = likeness(old, new, a, b)
                if only or score >= LIKELY:
                    edges[i, j] = score + (_CERTAIN if only else 0.0)
            if above and (b := (*above[0], a[-1])) not in taken and moved_to.get(b) == types:
                if b not in place:
                    place[b] = len(right)
                    right.append(b)
                # under a renamed parent an equal name is enough
                edges.setdefault((i, place[b]), 1.0 + (_MOVED - 1.0 if above[2] else 0.0))
        for i, j in max_weight_matching(edges).items():
            a, b = left[i], right[j]
            direct = a[:-1] == b[:-1]
            found[a] = (b, likeness(old, new, a, b), only if direct else above[2])
            taken.add(b)
    return found


def compare(old: Profile, new: Profile) -> list[tuple[str, str, str, float | None]]:
    """(change, field_path, other_path, likeness) of all differences."""
    if old.types == new.types:
        return []
    pairs = matches(old, new)
    sure = {a: b for a, (b, _, certain) in pairs.items() if certain}
    target = set(sure.values())
    out = [("retyped", show(s), "", None) for s, t in new.types.items() if s in old.types and old.types[s] != t]
    out += [("renamed" if certain else "likely", show(b), show(a), score) for a, (b, score, certain) in pairs.items()]
    out += [("removed", show(s), "", None) for s in old.types if s not in new.types and s not in sure]
    out += [("added", show(s), "", None) for s in new.types if s not in old.types and s not in target]
    return out


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(x.split()[0], pa.float64() if x.endswith("double") else pa.string()) for x in DIFFERENCES.split(", ")])
    for batch in batches:
        rows: list[list] = [[] for _ in schema]
        for r in batch.to_pylist():
            for change in compare(Profile(r["old"]), Profile(r["new"])):
                for column, value in zip(rows, (r["artifact_id"], r["root_key"], *change)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def _is(name: str, value: str) -> Column:
    return F.lower(F.btrim(F.col(name), F.lit(BLANKS))) == value


def counting_profiles(artifacts: DataFrame, roots: DataFrame) -> DataFrame:
    """(artifact_id, root_key, upstream_instance_id, source_tool, created_seq) of the profiles that count."""
    profiles = roots.where(_is("mode", "exact") & _is("completeness", "complete")).where("artifact_id is not null and root_key is not null").select("artifact_id", "root_key").distinct()
    valid = F.struct("generation", "ingested_at")
    of = artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(*[F.max_by(c, valid).alias(c) for c in ("upstream_instance_id", "source_tool", "created_seq")])
    return profiles.join(of, "artifact_id")


def schema_changes(artifacts: DataFrame, roots: DataFrame, fields: DataFrame) -> DataFrame:
    """(artifact_id, root_key, change, field_path, other_path) of each capture against the one before it."""
    return differences(artifacts, roots, fields).where("change <> 'likely'").drop("likeness")


def differences(artifacts: DataFrame, roots: DataFrame, fields: DataFrame) -> DataFrame:
    """(artifact_id, root_key, change, field_path, other_path, likeness): the changes, and the ambiguous pairs likeness speaks for as ``likely``.

    A profile's columns are gathered once (as many as its schema is wide); what is compared is always
    two profiles, whatever the length of their series.
    """
    pairs = with_previous(counting_profiles(artifacts, roots), ["upstream_instance_id", "source_tool", "root_key"], "created_seq", "artifact_id", "previous_id")
    pairs = pairs.where("previous_id is not null").select("artifact_id", "root_key", "previous_id")
    columns = (
        fields.where("artifact_id is not null and root_key is not null and field_path is not null")
        .groupBy("artifact_id", "root_key")
        .agg(F.collect_set(F.struct("field_path", "types", "example_value", "distinct_values")).alias("columns"))
    )
    new = columns.select("artifact_id", "root_key", F.col("columns").alias("new"))
    old = columns.select(F.col("artifact_id").alias("previous_id"), "root_key", F.col("columns").alias("old"))
    both = pairs.join(new, ["artifact_id", "root_key"], "left").join(old, ["previous_id", "root_key"], "left")
    return both.select("artifact_id", "root_key", "old", "new").mapInArrow(_compare_batches, DIFFERENCES)


SERIES = ["upstream_instance_id", "source_tool", "root_key"]


def column_names(artifacts: DataFrame, roots: DataFrame, fields: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(artifact_id, root_key, names): for captures with renamed fields (for certain or likely), at any depth, the path each is unified under.

    A field keeps the name it had before its first rename. A name that was given away by a rename and
    comes up again is another column and gets ``~n``, n being the number of times it was given away.
    """
    changes = differences(artifacts, roots, fields) if changes is None else changes
    valid = F.struct("generation", "ingested_at")
    of = artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(*[F.max_by(c, valid).alias(c) for c in ("upstream_instance_id", "source_tool", "created_seq")])
    events = cut_lineage(changes.where(F.col("change").isin("renamed", "likely")).join(of, "artifact_id").select(*SERIES, "created_seq", F.col("field_path").alias("new"), F.col("other_path").alias("old")))
    # each event's earlier event, the one that made the name it takes away; events are rare against rows
    made = events.select(*SERIES, F.col("new").alias("path"), (2 * F.col("created_seq")).alias("at"), F.concat_ws("\u0001", *SERIES, "created_seq", "new").alias("event"))
    asked = events.select(*SERIES, F.col("old").alias("path"), (2 * F.col("created_seq") - 1).alias("at"), F.lit(None).cast("string").alias("event"), "new", "old", "created_seq")
    linked = as_of(made.unionByName(asked, allowMissingColumns=True), [*SERIES, "path"], "at", "event", "earlier").where("old is not null")
    tree = linked.select(F.concat_ws("\u0001", *SERIES, "created_seq", "new").alias("event"), "earlier", "old", F.lit(1).alias("gen"), *SERIES, "created_seq", "new")
    rooted = hierarchy(tree, "event", "earlier", ("gen",)) if events.limit(1).count() else None
    if rooted is None:
        return fields.select("artifact_id", "root_key", F.expr("cast(map() as map<string,string>)").alias("names")).limit(0)
    first = tree.select(F.col("event").alias("root_id"), F.col("old").alias("first"))
    named = cut_lineage(rooted.join(first, "root_id").select(F.col("id").alias("event"), "first").join(tree, "event").select(*SERIES, "created_seq", "new", "old", "first"))
    # what each path of each capture is called, for paths that any rename of its series touches
    touched = named.select(*SERIES, F.col("new").alias("path")).unionByName(named.select(*SERIES, F.col("old").alias("path"))).distinct()
    used = fields.where("artifact_id is not null and root_key is not null").select("artifact_id", "root_key", normal_path("field_path").alias("path")).distinct()
    used = used.join(of, "artifact_id").join(touched, [*SERIES, "path"], "left_semi")
    given = named.groupBy(*SERIES, F.col("old").alias("path"), "created_seq").agg(F.count(F.lit(1)).alias("given"))
    away = running_given(given)
    notes = (
        named.select(*SERIES, F.col("new").alias("path"), (2 * F.col("created_seq")).alias("at"), F.col("first").alias("note"))
        .unionByName(away.select(*SERIES, "path", (2 * F.col("created_seq")).alias("at"), F.concat("path", F.lit("~"), F.col("times").cast("string")).alias("note")))
    )
    asked = used.select(*SERIES, "path", (2 * F.col("created_seq") + 1).alias("at"), F.lit(None).cast("string").alias("note"), "artifact_id")
    called = as_of(notes.unionByName(asked, allowMissingColumns=True), [*SERIES, "path"], "at", "note", "name").where("artifact_id is not null and name is not null")
    pairs = F.map_from_entries(F.collect_list(F.struct("path", "name")))
    return called.groupBy("artifact_id", "root_key").agg(pairs.alias("names"))


def running_given(given: DataFrame) -> DataFrame:
    """How often a name had been given away by each such rename (a handful for any one name)."""
    so_far = Window.partitionBy(*SERIES, "path").orderBy("created_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return given.withColumn("times", F.sum("given").over(so_far))


@F.pandas_udf(StringType())
def normal_path(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: show(normal_steps(p)), na_action="ignore")


_LAST = re.compile(r"(\.[A-Za-z_][A-Za-z0-9_]*|\['(?:[^'\\]|\\.)*'\])((?:~\d+)?)\Z", re.DOTALL)


class Names:
    """The unified paths of one capture, step by step from the top, so that what no rename is known of follows its parent."""

    def __init__(self, names: dict[str, str] | None) -> None:
        self.last = {own: m.group() for own, at in (names or {}).items() if (m := _LAST.search(own)) and (m := _LAST.search(at))}

    def step(self, own: str, step: str) -> str:
        """The unified last step of a path; elements keep their place."""
        return self.last.get(own, step)

    def unified(self, path: str) -> str:
        own = at = "$"
        for step in normal_steps(path):
            own += step
            at += self.step(own, step)
        return at


@F.pandas_udf(StringType())
def unified_path(paths: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([Names(dict(n) if n is not None else None).unified(p) for p, n in zip(paths, names)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _types(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: sorted(type_set(r)))


def _series_paths(artifacts: DataFrame, fields: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifact_id, root_key, series) of the captures, and (series, path, types) of their unified paths; series keys in one struct, whose null parts equal each other."""
    valid = F.struct("generation", "ingested_at")
    of = artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(*[F.max_by(c, valid).alias(c) for c in ("upstream_instance_id", "source_tool")])
    own = fields.where("artifact_id is not null and root_key is not null and field_path is not null").select("artifact_id", "root_key", "field_path", "types").distinct()
    series = F.struct(*SERIES).alias("series")
    paths = own.join(names, ["artifact_id", "root_key"], "left").join(of, "artifact_id").select(series, unified_path("field_path", "names").alias("path"), F.explode_outer(_types("types")).alias("type"))
    captures = own.select("artifact_id", "root_key").distinct().join(of, "artifact_id").select("artifact_id", "root_key", series)
    return captures, paths.groupBy("series", "path").agg(F.array_sort(F.collect_set("type")).alias("types"))


def mixed_columns(artifacts: DataFrame, fields: DataFrame, names: DataFrame) -> DataFrame:
    """(artifact_id, root_key, mixed): the unified paths that have more than one type in the profiles of the capture's series."""
    captures, paths = _series_paths(artifacts, fields, names)
    mixed = paths.where("size(types) > 1").groupBy("series").agg(F.collect_list("path").alias("mixed"))
    return captures.join(mixed, "series").select("artifact_id", "root_key", "mixed")


def unified_columns(artifacts: DataFrame, fields: DataFrame, names: DataFrame) -> DataFrame:
    """(upstream_instance_id, source_tool, root_key, path, type): the columns of each series' one table.

    Numbers are double, booleans boolean; texts, columns of several types and columns never seen but
    null are string; objects and arrays are string too, as JSON text.
    """
    _, paths = _series_paths(artifacts, fields, names)
    only = lambda t: F.col("types") == F.array(F.lit(t))
    return paths.select("series.*", "path", F.when(only("number"), "double").when(only("boolean"), "boolean").otherwise("string").alias("type"))


def typed_table(records: DataFrame, artifacts: DataFrame, names: DataFrame, mixed: DataFrame, columns: DataFrame, source_tool: str, root_key: str) -> DataFrame:
    """The typed table of all records of a tool and root: keys, element, and one column per unified top-level field.

    The columns are read off the profiles (as many as the schemas are wide); a column of different types
    in different upstreams is text. Values a profile gave no notice of, in a column of another type, are null.
    Only the records of the tool and root are unified.
    """
    path = r"^\$(\[\*\])?(\.[A-Za-z_][A-Za-z0-9_]*|\['([^'\\]|\\.)*'\])(~[0-9]+)?$"
    own = columns.where((F.col("source_tool") == source_tool) & (F.col("root_key") == root_key) & F.col("path").rlike(path))
    known = own.groupBy("path").agg(F.min("type").alias("type"), F.max("type").alias("other")).orderBy("path").collect()
    valid = F.struct("generation", "ingested_at")
    of = artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(F.max_by("source_tool", valid).alias("tool")).where(F.col("tool") == source_tool)
    rows = unified_records(records.where(F.col("root_path") == root_key).join(of, "artifact_id", "left_semi"), names, mixed=mixed)
    # a field has one column whether its record is an object or an element of an array
    fields: dict[str, list] = defaultdict(list)
    for r in known:
        fields[r.path.replace("$[*]", "$", 1)].append(r)
    taken = {"artifact_id", "root_path", "idx", "element"}
    columns = []
    for path, same in fields.items():
        value = F.coalesce(*[F.try_element_at("fields", F.lit(r.path)) for r in same])
        kinds = {t for r in same for t in (r.type, r.other)}
        name = base = re.sub(r"^_+|_+$", "", re.sub(r"\W+", "_", path)) or "_"
        n = 2
        while name.lower() in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name.lower())
        columns.append((value.try_cast(kinds.pop()) if len(kinds) == 1 and "string" not in kinds else _plain_text(value)).alias(name))
    return rows.select("artifact_id", "root_path", "idx", "element", *columns)


def _plain_text(text: Column) -> Column:
    """A JSON text as a column has it: strings without quotes, null for null."""
    return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")).when(text != "null", text)


UNIFIED = "artifact_id string, root_path string, idx int, element string, fields map<string,string>, value string"


class _Number(str):
    """A number as it is written."""


_decode = json.JSONDecoder(parse_constant=_reject, parse_int=_Number, parse_float=_Number).decode


def _parse(text: str) -> tuple[bool, object]:
    try:
        return True, _decode(text)
    except (ValueError, RecursionError):
        return False, None


class Unifier:
    """Rows and unified names of the records of one capture."""

    def __init__(self, names: dict[str, str] | None = None, mixed: list[str] | None = None) -> None:
        self.names = Names(names)
        self.mixed = frozenset(mixed or ())

    def rows(self, text: str | None) -> list[tuple]:
        """(element, fields, value) of a record: one row, or one for each element of an array."""
        if text is None:
            return [(None, None, None)]
        ok, value = _parse(text)
        try:
            return list(self._rows(value, None, "$", STRING_LAYERS)) if ok else [(None, None, _utf8(text))]
        except RecursionError:
            return [(None, None, _utf8(text))]

    def _rows(self, value: object, element: str | None, path: str, layers: int) -> Iterator[tuple]:
        if type(value) is str and (held := unwrap(value, layers, _parse)):
            value, layers = held
        if type(value) is dict:
            yield element, [(_utf8(path + step), _utf8(self._text(value[name], path + name_step(name), path + step, layers))) for name, step in self._members(value, path)], None
        elif type(value) is list and value:
            for i, x in enumerate(value):
                yield from self._rows(x, f"{element or ''}[{i}]", path + "[*]", layers)
        else:
            yield element, None, _utf8(self._text(value, path, path, layers))

    def _members(self, value: dict, path: str) -> list[tuple[str, str]]:
        """(name, unified step) of an object's members; known names come first, others that would share one are numbered."""
        order = sorted(value)
        if not self.names.last:
            return [(name, name_step(name)) for name in order]
        found, taken = {}, set()
        for known in (True, False):
            for i, name in enumerate(order):
                own = name_step(name)
                if (path + own in self.names.last) is known:
                    step, n = self.names.step(path + own, own), i + 1
                    shown = step
                    while shown in taken:
                        shown, n = f"{step}~{n}", n + 1
                    taken.add(shown)
                    found[name] = shown
        return [(name, found[name]) for name in order]

    def _text(self, value: object, own: str, at: str, layers: int) -> str:
        """JSON text of a value at its own and its unified path, strings that hold an object or array as what they hold."""
        kind = type(value)
        if kind is str:
            if not (layers and value[:1] in ("{", "[", '"', " ", "\t", "\r", "\n") and (held := unwrap(value, layers, _parse))):
                return encode_basestring(value)
            value, layers = held
            kind = type(value)
        if kind is dict:
            members = self._members(value, own)
            text = "{" + ",".join([f"{encode_basestring(_key(s))}:{self._text(value[k], own + name_step(k), at + s, layers)}" for k, s in members]) + "}"
        elif kind is list:
            text = "[" + ",".join([self._text(x, own + "[*]", at + "[*]", layers) for x in value]) + "]"
        elif value is None:
            return "null"
        else:
            text = str(value) if kind is _Number else "true" if value else "false"
        return encode_basestring(text) if at in self.mixed else text


@lru_cache(maxsize=100_000)
def _key(step: str) -> str:
    """The field name of a step, with its number if it has one."""
    base, mark = _LAST.match(step).groups()
    return (base[1:] if base[0] == "." else bracket_name(base[2:-2])) + mark


def _unify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string()) for n in ("artifact_id", "root_path")] + [("idx", pa.int32()), ("element", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("value", pa.string())])
    for batch in batches:
        captures: dict[tuple, Unifier] = {}
        origin: list[int] = []
        rows: list[tuple] = []
        keys = zip(batch.column("artifact_id").to_pylist(), batch.column("root_path").to_pylist())
        for i, (key, text) in enumerate(zip(keys, batch.column("record").to_pylist())):
            if key not in captures:
                captures[key] = Unifier(dict(batch.column("names")[i].as_py() or ()), batch.column("mixed")[i].as_py())
            found = captures[key].rows(text)
            origin.extend([i] * len(found))
            rows.extend(found)
        take = pa.array(origin, pa.int32())
        out = [batch.column(c).take(take) for c in ("artifact_id", "root_path", "idx")]
        out += [pa.array([r[j] for r in rows], schema.field(3 + j).type) for j in range(3)]
        yield pa.RecordBatch.from_arrays(out, schema=schema)


def unified_records(records: DataFrame, names: DataFrame, renamed_only: bool = False, mixed: DataFrame | None = None) -> DataFrame:
    """(artifact_id, root_path, idx, element, fields, value): every record as a map from unified top-level names to JSON text.

    Strings that hold an object or array count as it, like in ``nesting``. A record that is an array has
    a row for each element, ``element`` being its position (``[0]``), with the names the profile has for
    them (``$[*].a``). What is no object has its JSON text in ``value`` instead of fields, a record that
    is no valid JSON its own text. Names inside objects and arrays are unified like those at the top. A
    record's own names stay where no rename is known; of fields that would share a name those no rename
    is known of are numbered. Columns that are ``mixed`` (see ``mixed_columns``) have one type: strings,
    numbers and booleans as they are written, objects and arrays as JSON text.
    """
    rows = records.select("artifact_id", "root_path", "idx", "record").join(names.withColumnRenamed("root_key", "root_path"), ["artifact_id", "root_path"], "inner" if renamed_only else "left")
    none = F.lit(None).cast("array<string>")
    rows = rows.withColumn("mixed", none) if mixed is None else rows.join(mixed.withColumnRenamed("root_key", "root_path"), ["artifact_id", "root_path"], "left")
    return rows.mapInArrow(_unify_batches, UNIFIED)
