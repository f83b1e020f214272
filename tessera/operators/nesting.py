"""Deeply nested records into related flat tables.

A bottom-up tree automaton runs over every record: the state of an object is decided by its field
names and the states of their values, so that objects of one structural variant, wherever they sit,
end in one state. The record itself, every object that is an element of an array and every other
element becomes a row that carries its variant (the subtype table it is routed to), its supertype
(the place it sits at, positions left out), the keys of its record and the link to the object around
it. Objects that are plain members are columns of the row around them (``user.login``), so the tables
together hold every value of the record: numbers as they are written, empty arrays and objects as
``[]`` and ``{}``.

Defined results: null records, records that are no valid JSON (NaN and infinities are none) or nested
too deeply for the parser give no row; a record that is an array has its elements as ``$[i]`` and no
row of its own, a record that is a scalar is a row with the one field ``value``, like an element that
is no object; an array in an array has no row, its elements do; a string that holds an object or array
counts as it, up to three string layers along a path; of equal field names in an object the last
counts; rows that repeat a record key add only objects not seen before, the copy of the smaller text
first; null parts of a record key are kept as nulls and equal each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.operators.paths import name_step, normal_steps, show

STRING_LAYERS = 3
_NULL, _BOOL, _NUMBER, _TEXT = 1, 2, 3, 4
_MASK = (1 << 63) - 1
_OPENING = ("{", "[", '"', " ", "\t", "\r", "\n")


def _reject(name: str) -> None:
    raise ValueError(name)


class Number(str):
    """A number as it is written."""


_decode = json.JSONDecoder(parse_constant=_reject, strict=True, parse_int=float).decode
_decode_exact = json.JSONDecoder(parse_constant=_reject, strict=True, parse_int=Number, parse_float=Number).decode


def parse(text: str | None) -> tuple[bool, object]:
    """(is valid JSON, value)."""
    if text is None:
        return False, None
    try:
        return True, _decode(text)
    except (ValueError, RecursionError):
        return False, None


def parse_exact(text: str | None) -> tuple[bool, object]:
    """The same with every number as it is written."""
    if text is None:
        return False, None
    try:
        return True, _decode_exact(text)
    except (ValueError, RecursionError):
        return False, None


def unwrap(text: str, layers: int, parse: Callable[[str], tuple[bool, object]] = parse) -> tuple[object, int] | None:
    """The object or array held by a string and the string layers left, None if it holds neither."""
    value: object = text
    while layers and isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        ok, value = parse(value)
        if not ok:
            return None
        layers -= 1
        if isinstance(value, (dict, list)):
            return value, layers
    return None


class ShapeAutomaton:
    """States are 63-bit hashes of what decides them, so all tasks agree on them without exchange."""

    def __init__(self) -> None:
        self._objects: dict[tuple, int] = {}
        self._arrays: dict[frozenset, int] = {}

    @staticmethod
    def _number(key: object) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(repr(key)) & _MASK

    def object_state(self, fields: list[tuple[str, int]]) -> int:
        fields.sort()
        key = tuple(fields)
        state = self._objects.get(key)
        if state is None:
            if len(self._objects) > 200_000:
                self._objects.clear()
            state = self._objects[key] = self._number(key)
        return state

    def array_state(self, elements: set[int]) -> int:
        key = frozenset(elements)
        state = self._arrays.get(key)
        if state is None:
            if len(self._arrays) > 200_000:
                self._arrays.clear()
            state = self._arrays[key] = self._number(sorted(key))
        return state


class Flattener:
    """Walks one record at a time for its objects in arrays; ``nodes`` takes (node_path, parent_path, variant)."""

    def __init__(self) -> None:
        self.shapes = ShapeAutomaton()
        self.nodes: list[tuple] = []

    def record(self, text: str | None) -> None:
        ok, value = parse(text)
        if not ok:
            return
        try:
            self._state(value, "$", "$", STRING_LAYERS)
        except RecursionError:
            self.nodes.clear()

    def _state(self, value: object, path: str, parent: str, layers: int) -> int:
        """The automaton's state of a value; reports the objects in the arrays within it."""
        kind = type(value)
        if kind is str:
            if layers and value[:1] in '{[" \t\r\n' and value:
                held = unwrap(value, layers)
                if held:
                    return self._state(held[0], path, parent, held[1])
            return _TEXT
        if kind is float or kind is int:
            return _NUMBER
        if kind is dict:
            fields = []
            for name, x in value.items():
                k = type(x)
                if k is float:
                    state = _NUMBER
                elif k is dict or k is list or (k is str and x[:1] in '{[" \t\r\n'):
                    state = self._state(x, path + name_step(name), parent, layers)
                elif k is str:
                    state = _TEXT
                else:
                    state = _NULL if x is None else _BOOL
                fields.append((name, state))
            return self.shapes.object_state(fields)
        if kind is list:
            states = set()
            for i, x in enumerate(value):
                left = layers
                if type(x) is str and (held := unwrap(x, layers)):
                    x, left = held
                if type(x) is dict:
                    at = f"{path}[{i}]"
                    mark = len(self.nodes)
                    self.nodes.append(())
                    state = self._state(x, at, at, left)
                    self.nodes[mark] = (at, parent, state)
                else:
                    state = self._state(x, f"{path}[{i}]", parent, left)
                states.add(state)
            return self.shapes.array_state(states)
        return _NULL if value is None else _BOOL


class TableFlattener(Flattener):
    """Walks one record at a time for its rows; ``nodes`` takes (node_path, parent_path, variant, place, cells), cells being (field, kind, value)."""

    def record(self, text: str | None) -> None:
        ok, value = parse_exact(text)
        if not ok:
            return
        try:
            self._row(value, "$", None, "$", STRING_LAYERS)
        except RecursionError:
            self.nodes.clear()

    def _row(self, value: object, path: str, parent: str | None, place: str, layers: int) -> int:
        """The state of a record or of an array's element, which is a row unless it is an array itself."""
        if type(value) is str and (held := unwrap(value, layers, parse_exact)):
            value, layers = held
        if type(value) is list and value:
            return self._elements(value, path, parent or "$", place, layers)
        mark, cells = len(self.nodes), []
        self.nodes.append(())
        if type(value) is dict:
            state = self._members(value, path, path, place, layers, cells, "")
        else:
            state = self._cell(value, path, parent or "$", place, layers, cells, "value")
        self.nodes[mark] = (path, parent, state, place, cells)
        return state

    def _elements(self, values: list, path: str, parent: str, place: str, layers: int) -> int:
        inner = place + "[*]"
        return self.shapes.array_state({self._row(x, f"{path}[{i}]", parent, inner, layers) for i, x in enumerate(values)})

    def _members(self, value: dict, path: str, parent: str, place: str, layers: int, cells: list, field: str) -> int:
        fields = []
        for name, x in value.items():
            step = name_step(name)
            own = field + step if field or step[0] != "." else step[1:]
            fields.append((name, self._cell(x, path + step, parent, place + step, layers, cells, own)))
        return self.shapes.object_state(fields)

    def _cell(self, value: object, path: str, parent: str, place: str, layers: int, cells: list, field: str) -> int:
        """The state of a value that is no row: its scalars are cells of the row around it."""
        kind = type(value)
        if kind is str:
            if not (layers and value[:1] in _OPENING and (held := unwrap(value, layers, parse_exact))):
                cells.append((field, "string", value))
                return _TEXT
            value, layers = held
            kind = type(value)
        if kind is dict:
            if not value:
                cells.append((field, "object", "{}"))
            return self._members(value, path, parent, place, layers, cells, field)
        if kind is list:
            if not value:
                cells.append((field, "array", "[]"))
            return self._elements(value, path, parent, place, layers)
        if kind is Number:
            cells.append((field, "number" if "." in value or "e" in value or "E" in value else "integer", str(value)))
            return _NUMBER
        cells.append((field, "null", None) if value is None else (field, "boolean", "true" if value else "false"))
        return _NULL if value is None else _BOOL


def _utf8(text: str) -> str:
    """Text without lone surrogates, which no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


_CELL = pa.struct([("kind", pa.string()), ("value", pa.string())])
_ROWS = 20_000  # rows of a batch that is passed on


def _cells_array(nodes: list[tuple]) -> pa.MapArray:
    offsets = [0, *accumulate(len(n[4]) for n in nodes)]
    cells = [c for n in nodes for c in n[4]]
    names = pa.array([_utf8(c[0]) for c in cells], pa.string())
    values = pa.array([None if c[2] is None else _utf8(c[2]) for c in cells], pa.string())
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), names, pa.StructArray.from_arrays([pa.array([c[1] for c in cells], pa.string()), values], fields=list(_CELL)))


def _flatten(columns: list[str], tables: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = TableFlattener() if tables else Flattener()
        last_key: tuple | None = None
        seen: set[str] = set()
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in columns]))
            origin: list[int] = []
            nodes: list[tuple] = []

            def rows(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take = pa.array(origin, pa.int32())
                out = [batch.column(c).take(take) for c in columns]
                out += [pa.array([_utf8(n[0]) for n in nodes], pa.string()), pa.array([None if n[1] is None else _utf8(n[1]) for n in nodes], pa.string())]
                out.append(pa.array([n[2] for n in nodes], pa.int64()))
                if tables:
                    out += [pa.array([_utf8(n[3]) for n in nodes], pa.string()), _cells_array(nodes)]
                origin.clear()
                nodes.clear()
                return pa.RecordBatch.from_arrays(out, schema=schema)

            for row, (key, text) in enumerate(zip(keys, batch.column("record").to_pylist())):
                walker.nodes = found = []
                walker.record(text)
                if key == last_key:
                    found = [n for n in found if n[0] not in seen]
                    seen.update(n[0] for n in found)
                else:
                    last_key, seen = key, {n[0] for n in found}
                origin.extend([row] * len(found))
                nodes.extend(found)
                if len(nodes) >= _ROWS:
                    yield rows()
            yield rows()

    return run


KEYS = ("artifact_id", "root_path", "idx")


def _run(records: DataFrame, keys: tuple[str, ...], record: str, tables: bool) -> DataFrame:
    types = dict(records.dtypes)
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    rows = records.select(*keys, records[record].alias("record")).where("record is not null")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *(["record"] if tables else []))
    ddl = [f"{k} {types[k]}" for k in keys] + ["node_path string", "parent_path string", "variant bigint"] + ["place string", "fields map<string,struct<kind:string,value:string>>"] * tables
    schema = pa.schema([(k, arrow[types[k]]) for k in keys] + [("node_path", pa.string()), ("parent_path", pa.string()), ("variant", pa.int64())] + [("place", pa.string()), ("fields", pa.map_(pa.string(), _CELL))] * tables)
    return rows.mapInArrow(_flatten(list(keys), tables, schema), ", ".join(ddl))


def nested_objects(records: DataFrame, keys: tuple[str, ...] = KEYS, record: str = "record") -> DataFrame:
    """(keys, node_path, parent_path, variant): one row per object in an array.

    ``variant`` names the subtype table (objects of equal structure). Rows of one record key meet in
    one task, sorted, and stream through it: neither a record's copies nor its objects are collected.
    """
    return _run(records, keys, record, tables=False)


def flat_rows(records: DataFrame, keys: tuple[str, ...] = KEYS, record: str = "record") -> DataFrame:
    """The rows of all subtype tables: keys, node_path, parent_path, variant, place and fields.

    ``place`` is the supertype a row shares with other variants, ``fields`` its columns with the kind
    (string, integer, number, boolean, null, or array and object for empty ones) and text of each value.
    ``parent_path`` is that of the row of the object around it, null for the record's own row.
    """
    return _run(records, keys, record, tables=True)


def cells(rows: DataFrame) -> DataFrame:
    """``flat_rows`` in long form: one row per value, with its field, kind and text."""
    others = [c for c in rows.columns if c not in ("fields", "variant")]
    return rows.select(*others, F.explode("fields").alias("field", "cell")).select(*others, "field", "cell.kind", "cell.value")


_PATH = StructType([StructField(c, StringType()) for c in ("node_path", "parent_path", "field")])


@F.pandas_udf(_PATH)
def _nested_path(paths: pd.Series) -> pd.DataFrame:
    rows = []
    for path in paths:
        steps = normal_steps(path)
        # an element belongs to the object around its array
        inner = max((i + 1 for i, s in enumerate(steps[:-1]) if s == "[*]"), default=0)
        rows.append((show(steps), show(steps[:inner]), "".join(steps[inner:])))
    return pd.DataFrame(rows, columns=["node_path", "parent_path", "field"])


def nested_paths(fields: DataFrame, keys: tuple[str, ...], path: str) -> DataFrame:
    """(keys, node_path, parent_path, field): every path in normal form, the path of the object it belongs to and what is left below it.

    Like objects, paths belong to the innermost array element around them, or to the root ``$``. Both
    notations of a path are one row; null paths are none.
    """
    own = fields.where(F.col(path).isNotNull()).select(*keys, path).distinct()
    return own.select(*keys, _nested_path(path).alias("p")).select(*keys, "p.*").distinct()


def subtype_catalog(rows: DataFrame) -> DataFrame:
    """One row per subtype table: place (supertype), variant, its field names and its number of rows."""
    names = F.array_sort(F.map_keys("fields"))
    return rows.groupBy("place", "variant").agg(F.min(F.array_join(names, ",")).alias("scalar_fields"), F.count(F.lit(1)).alias("n"))


def column_types(rows: DataFrame, by: tuple[str, ...] = ("place", "variant")) -> DataFrame:
    """(by, field, type, n, nulls): the columns of each table and the narrowest type that holds all their values.

    Integers are bigint, decimal(38,0) or, beyond 38 digits, string; with other numbers among them
    double; booleans are boolean; mixed kinds, texts and nulls alone are string.
    """
    long = rows.select(*by, F.explode("fields").alias("field", "cell"))
    kind = F.col("cell.kind")
    seen = long.groupBy(*by, "field").agg(
        F.array_sort(F.collect_set(F.when(kind != "null", kind))).alias("kinds"),
        F.max(F.when(kind == "integer", F.length(F.ltrim(F.col("cell.value"), F.lit("-"))))).alias("digits"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(kind == "null", 1)).alias("nulls"),
    )
    only = lambda *k: F.col("kinds") == F.array(*map(F.lit, k))
    integers = F.when(F.col("digits") <= 18, "bigint").when(F.col("digits") <= 38, "decimal(38,0)").otherwise("string")
    of = F.when(only("integer"), integers).when(only("number") | only("integer", "number"), "double").when(only("boolean"), "boolean").otherwise("string")
    return seen.select(*by, "field", of.alias("type"), "n", "nulls")


def subtype_table(rows: DataFrame, place: str, fields: dict[str, str] | None = None, variant: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The typed table of the rows at ``place`` (of one ``variant``, if given): keys, link to the parent, one column per field.

    ``fields`` gives the Spark type of each column; without it the columns and types are those found in
    the rows (a pass over them; as many as the schema at that place is wide). Values that do not fit a
    given type are null; types found in the rows fit all values.
    """
    own = rows.where(F.col("place") == place)
    if variant is not None:
        own = own.where(F.col("variant") == variant)
    if fields is None:
        fields = {r.field: r.type for r in column_types(own, by=("place",)).orderBy("field").collect()}
    typed = [F.expr(f"try_cast(fields[{_quoted(n)}].value as {t})").alias(n) for n, t in fields.items()]
    return own.select(*keys, "node_path", "parent_path", "variant", *typed)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
