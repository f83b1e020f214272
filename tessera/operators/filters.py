"""The filter language: predicates on JSON paths, joined by and, or and not, compiled to one column.

Values compare by storage class (numbers and booleans below text, no coercion between them);
comparisons with missing or null values are unknown and drop the row, also under ``not``.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.functions.variants import ascii_lower, elements, ordered, ordered_literal, text_of, type_name

MAX_DEPTH = 20
COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
OTHER = {"in", "contains", "array_contains", "exists", "not_exists"}


class FilterError(ValueError):
    pass


def check(raw: Any, depth: int = 0) -> dict:
    """A filter in normal form: checked, paths canonical; raises FilterError."""
    if depth > MAX_DEPTH:
        raise FilterError(f"filters nest at most {MAX_DEPTH} deep")
    if not isinstance(raw, dict):
        raise FilterError("a filter is an object")
    if "not" in raw:
        return {"not": check(raw["not"], depth + 1)}
    if "logic" in raw:
        logic, parts = str(raw["logic"]).lower(), raw.get("filters")
        if logic not in ("and", "or") or not isinstance(parts, list):
            raise FilterError("a group has logic (and, or) and a list of filters")
        return {"logic": logic, "filters": [check(p, depth + 1) for p in parts]}
    op = raw.get("op")
    if op not in COMPARE and op not in OTHER:
        raise FilterError(f"unknown operator {op!r}")
    try:
        path = jsonpath.reject_wildcards(jsonpath.canonical(raw.get("path", "")), "filter")
    except jsonpath.PathError as e:
        raise FilterError(str(e)) from e
    value = raw.get("value")
    if op in ("exists", "not_exists"):
        return {"path": path, "op": op}
    if op == "in":
        if not isinstance(value, list) or any(isinstance(x, (list, dict)) for x in value):
            raise FilterError("in takes a list of scalars")
    elif isinstance(value, (list, dict)):
        raise FilterError(f"{op} takes a scalar")
    if op == "contains" and not isinstance(value, str):
        raise FilterError("contains takes a string")
    if op in ("gt", "gte", "lt", "lte") and value is None:
        raise FilterError(f"{op} takes no null")
    return {"path": path, "op": op, "value": value}


def compile_filter(raw: dict, v: Column) -> Column:
    """The predicate of a filter on the VARIANT column ``v``."""
    return _compile(check(raw), v)


def _compile(f: dict, v: Column) -> Column:
    if "not" in f:
        return ~_compile(f["not"], v)
    if "logic" in f:
        parts = [_compile(p, v) for p in f["filters"]]
        if f["logic"] == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    x, op, value = jsonpath.get(v, f["path"]), f["op"], f.get("value")
    if op == "exists":
        return x.isNotNull()
    if op == "not_exists":
        return x.isNull()
    if op == "in":
        hit = reduce(lambda a, b: a | b, [_compare("eq", x, y) for y in value if y is not None], F.lit(False))
        # a null in the list makes what is not found unknown
        return F.when(hit, True).otherwise(F.lit(None).cast("boolean")) if None in value else hit
    if op == "contains":
        return F.contains(ascii_lower(text_of(x)), ascii_lower(F.lit(value)))
    if op == "array_contains":
        found = F.exists(elements(x), lambda e: e.isNull() | (type_name(e) == "null") if value is None else F.coalesce(_compare("eq", e, value), F.lit(False)))
        return F.coalesce(found, F.lit(False))
    if value is None:
        absent = x.isNull() | F.is_variant_null(x)
        return absent if op == "eq" else ~absent
    return _compare(op, x, value)


#: Whole numbers that a double holds exactly, and no other number rounds to.
_EXACT = 2**53 - 1


def _compare(op: str, x: Column, value: Any) -> Column:
    """Storage-class comparison with one literal; every class is decided by one plain comparison."""
    kind = F.schema_of_variant(x)
    is_text = (kind == "STRING") | F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    is_number = (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    if isinstance(value, str):
        text = F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
        return F.when(is_text, COMPARE[op](text, F.lit(value))).when(is_number | (kind == "BOOLEAN"), F.lit(op in ("ne", "lt", "lte")))
    if abs(value) > _EXACT:
        return COMPARE[op](ordered(x), _literal(value))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).otherwise(F.try_variant_get(x, "$", "double"))
    return F.when(is_number | (kind == "BOOLEAN"), COMPARE[op](number, F.lit(float(value)))).when(is_text, F.lit(op in ("ne", "gt", "gte")))


def _literal(value: Any) -> Column:
    return ordered_literal(float(value) if isinstance(value, Decimal) else value)


def _canonical(f: dict) -> Any:
    if "not" in f:
        return {"not": _canonical(f["not"])}
    if "logic" in f:
        return {"logic": f["logic"], "filters": sorted((_canonical(p) for p in f["filters"]), key=lambda p: json.dumps(p, sort_keys=True))}
    return f


def filter_hash(raw: dict) -> str:
    """A hash of what a filter means: the order inside groups and of keys does not matter."""
    text = json.dumps(_canonical(check(raw)), sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()
