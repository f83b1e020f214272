"""Profiles of JSON records: paths, types, examples, top fields, root inventory, schema hash."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TYPE_ORDER
from tessera.functions.variants import members, type_name
from tessera.operators.nesting import Number, _utf8, parse_exact
from tessera.operators.paths import name_step

FIELDS_TOP_LIMIT = 50


_KINDS = {type(None): 1, bool: 2, Number: 4, str: 8, list: 16, dict: 32}  # bits in the order of TYPE_ORDER
_MOST_PATHS = 100_000  # paths a task holds before it passes them on
_COUNTS = "root_path string, path string, kinds int, n bigint, example struct<artifact_id:string,idx:int,value:string>, scalar struct<artifact_id:string,idx:int,value:string>"


def _preview(value: object) -> str:
    """A value as an example shows it: texts as they are, all else as JSON with sorted names; long ones cut."""
    text = value if isinstance(value, str) else _json(value)
    return _utf8(text if len(text) <= 30 else f"[{text[:30]}]({len(text) - 30} more chars truncated)")


def _json(value: object) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _paths(text: str) -> dict[str, list] | None:
    """The paths below a record's root with their kinds, first value and first scalar, names in sorted order; None if it is no valid JSON."""
    ok, value = parse_exact(text)
    if not ok:
        return None
    found: dict[str, list] = {}
    left: list[tuple[str, object]] = [("", value)]
    while left:
        path, x = left.pop()
        kind = type(x)
        if path:
            own = found.get(path)
            if own is None:
                own = found[path] = [0, x, _MISSING]
            own[0] |= _KINDS[kind]
            if own[2] is _MISSING and kind is not dict and kind is not list:
                own[2] = x
        if kind is dict:
            at = path or "$"
            left.extend([(at + name_step(k), x[k]) for k in sorted(x, reverse=True)])
        elif kind is list:
            at = (path or "$") + "[*]"
            left.extend([(at, v) for v in reversed(x)])
    return found


_MISSING = object()


def _count_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = pa.struct([("artifact_id", pa.string()), ("idx", pa.int32()), ("value", pa.string())])
    schema = pa.schema([("root_path", pa.string()), ("path", pa.string()), ("kinds", pa.int32()), ("n", pa.int64()), ("example", first), ("scalar", first)])
    counts: dict[tuple, list] = {}
    key: tuple | None = None
    record: dict[str, list] | None = None  # of all rows of one key

    def close() -> None:
        if record is None:
            return
        counts.setdefault((key[1], ""), [0, 0, None, None])[1] += 1
        at = {"artifact_id": key[0], "idx": key[2]}
        for path, (kinds, value, scalar) in record.items():
            own = counts.setdefault((key[1], path), [0, 0, None, None])
            own[0] |= kinds
            own[1] += 1
            # keys come in order, so the first of a task is its least
            if own[2] is None:
                own[2] = at | {"value": _preview(value)}
            if own[3] is None and scalar is not _MISSING:
                own[3] = at | {"value": _utf8(_json(scalar))}

    def flush() -> pa.RecordBatch:
        rows = [(r, _utf8(p), *own) for (r, p), own in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in ("artifact_id", "root_path", "idx")])
        for own, text in zip(keys, batch.column("record").to_pylist()):
            if own != key:
                close()
                key, record = own, None
            found = _paths(text)
            if found is None:
                continue
            if record is None:
                record = found
            else:
                for path, (kinds, value, scalar) in found.items():
                    known = record.setdefault(path, [0, value, scalar])
                    known[0] |= kinds
                    if known[2] is _MISSING:
                        known[2] = scalar
        if len(counts) > _MOST_PATHS:
            yield flush()
    close()
    yield flush()


def record_profile(records: DataFrame) -> DataFrame:
    """Per root_path and path: types, records that have it, nullable, required, example, distinct_values, cardinality.

    A record is what has one (artifact_id, root_path, idx), null parts equal each other; rows that repeat
    a key count once, with all their paths. Null records and texts that are no valid JSON count as none.
    ``example`` is the value seen first, by artifact, index and sorted names; ``distinct_values`` has the
    first scalar as JSON text and ``cardinality`` tells that there is one, as the catalog keeps them.
    Each task adds up its own records, so only counts are shuffled; there is no limit of depth but the
    parser's.
    """
    key = ["artifact_id", "root_path", "idx"]
    rows = records.where("record is not null").select(*key, "record").repartition(*key).sortWithinPartitions(*key, "record")
    counts = rows.mapInArrow(_count_paths, _COUNTS)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col(c)))["value"].alias(c)
    counts = counts.groupBy("root_path", "path").agg(F.bit_or("kinds").alias("kinds"), F.sum("n").alias("observed"), first("example"), first("scalar"))
    totals = counts.where("path = ''").select(F.col("root_path").alias("of"), F.col("observed").alias("total"))
    out = counts.where("path <> ''").join(totals, F.col("root_path").eqNullSafe(F.col("of")))
    kind = lambda i: F.col("kinds").bitwiseAND(1 << i) != 0
    types = F.filter(F.array(*[F.when(kind(i), t) for i, t in enumerate(TYPE_ORDER)]), lambda t: t.isNotNull())
    values = F.when(F.col("scalar").isNotNull(), F.concat(F.lit("["), F.col("scalar"), F.lit("]")))
    return out.select("root_path", "path", types.alias("types"), "observed", kind(0).alias("nullable"), (F.col("observed") == F.col("total")).alias("required"), "example", values.alias("distinct_values"), F.when(F.col("scalar").isNotNull(), 1).alias("cardinality"))


def merged_profile(profiles: DataFrame, group: list[str]) -> DataFrame:
    """Profiles of several roots as one per ``group`` and path: types united, counts added, nullable if one is, the first root's example.

    Rows have root_path, path, types, observed, nullable, example.
    """
    first = F.min(F.when(F.col("example").isNotNull(), F.struct("root_path", "example")))["example"]
    seen = profiles.groupBy(*group, "path").agg(F.array_distinct(F.flatten(F.collect_set("types"))).alias("kinds"), F.sum("observed").alias("observed"), F.max("nullable").alias("nullable"), first.alias("example"))
    types = F.filter(F.array(*[F.lit(t) for t in TYPE_ORDER]), lambda t: F.array_contains(F.col("kinds"), t))
    return seen.select(*group, "path", types.alias("types"), "observed", "nullable", "example")


def fields_top(records: DataFrame, group: list[str], index: str = "idx", value: str = "v", limit: int = FIELDS_TOP_LIMIT) -> DataFrame:
    """Per group, top-level field and type: how many of the first records have it."""
    first = records.where(F.col(index) < limit)
    return first.select(*group, F.explode(members(F.col(value))).alias("field", "x")).groupBy(*group, "field", type_name(F.col("x")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def schema_hash(fields: DataFrame, group: list[str], path: str, types: str) -> DataFrame:
    """Per group a hash of its paths and types, whatever their order (a profile is as wide as one schema)."""
    pairs = F.array_sort(F.collect_set(F.to_json(F.struct(F.col(path).alias("path"), F.col(types).alias("types")))))
    return fields.groupBy(*group).agg(F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")), 256)).alias("schema_hash"))

