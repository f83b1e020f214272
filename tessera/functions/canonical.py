"""Canonical JSON (RFC 8785), hashes over it, and other functions that recurse into JSON text.

Built-in expressions cannot recurse, so these run as Arrow batches in Python, one call a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators.nesting import STRING_LAYERS


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def loads_decimal(text: str) -> Any:
    """JSON with exact numbers; NaN and infinities are rejected."""
    return json.loads(text, parse_float=Decimal, parse_constant=_no_constant)


def canonical_number(value: int | Decimal) -> str:
    """The shortest form; exponents from 1e21 up and 1e-7 down."""
    if isinstance(value, int):
        if abs(value) < 10**21:
            return str(value)
        value = Decimal(value)
    if not value.is_finite():
        raise ValueError("numbers are finite")
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    kept = text.rstrip("0")
    if not kept:
        return "0"
    exponent += len(text) - len(kept)
    point = len(kept) + exponent  # the value is 0.kept * 10^point
    if 0 < point <= 21:
        body = kept + "0" * (point - len(kept)) if point >= len(kept) else f"{kept[:point]}.{kept[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + kept
    else:
        e = point - 1
        body = kept[0] + ("." + kept[1:] if len(kept) > 1 else "") + f"e{'+' if e > 0 else ''}{e}"
    return "-" * sign + body


def canonical_text(value: Any) -> str:
    """RFC 8785: names ordered by their UTF-16 units, no white space, canonical numbers; floats are rejected."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)):
        return canonical_number(value)
    if isinstance(value, float):
        raise TypeError("floats have no canonical form; parse numbers as decimals")
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    if isinstance(value, dict):
        names = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_text(value[k])}" for k in names) + "}"
    raise TypeError(f"{type(value).__name__} is no JSON")


def coerce_floats(value: Any) -> Any:
    """Floats as the decimals they are written as."""
    if isinstance(value, float):
        return Decimal(repr(value))
    if isinstance(value, list):
        return [coerce_floats(x) for x in value]
    return {k: coerce_floats(x) for k, x in value.items()} if isinstance(value, dict) else value


def resolve_strings(value: Any, layers: int = STRING_LAYERS) -> Any:
    """Strings that hold objects or arrays become them, at most ``layers`` deep along a path."""
    if isinstance(value, str):
        if not layers or value.lstrip()[:1] not in ("{", "["):
            return value
        try:
            held = loads_decimal(value)
        except (ValueError, RecursionError):
            return value
        return resolve_strings(held, layers - 1) if isinstance(held, (dict, list)) else value
    if isinstance(value, list):
        return [resolve_strings(x, layers) for x in value]
    return {k: resolve_strings(x, layers) for k, x in value.items()} if isinstance(value, dict) else value


def shape(value: Any) -> Any:
    """The structure of a value without its content; an array is the set of its elements' shapes."""
    if isinstance(value, dict):
        return {k: shape(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return sorted({json.dumps(shape(x), sort_keys=True) for x in value})
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "number"


def _on_json(f: Callable[[Any], str | None]) -> Callable[[Column], Column]:
    """A column function on JSON text; null for null and for text that is no JSON."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return f(loads_decimal(text))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)

    return run


canonical = _on_json(canonical_text)
resolved = _on_json(lambda v: canonical_text(resolve_strings(v)))
shape_of = _on_json(lambda v: json.dumps(shape(v), sort_keys=True))


def canonical_hash(text: Column) -> Column:
    """sha256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def _cut(value: Any) -> tuple[Any, bool]:
    if isinstance(value, str) and len(value) > 30:
        return f"[{value[:30]}]({len(value) - 30} more chars truncated)", True
    if isinstance(value, list):
        parts = [_cut(v) for v in value]
        return [v for v, _ in parts], any(t for _, t in parts)
    if isinstance(value, dict):
        own = {k: _cut(v) for k, v in value.items()}
        return {k: v for k, (v, _) in own.items()}, any(t for _, t in own.values())
    return value, False


def _sample(value: Any) -> str | None:
    if not isinstance(value, list) or not value:
        return None
    first = shape(value[0])
    if any(shape(v) != first for v in value[1:]):
        return None
    item, cut = _cut(value[0])
    out = {"sample_item": item, "sample_item_source_index": 0, "sample_item_count": len(value)} | ({"sample_item_text_truncated": True} if cut else {})
    return canonical_text(out)


#: The first of a list's items with long texts cut, as JSON, if all items have its structure; else null.
representative_sample = _on_json(_sample)
