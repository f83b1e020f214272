"""Redaction of secrets in text and in JSON trees."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "[REDACTED_SECRET]"
#: Strings of more bytes are not scanned.
SCAN_BYTES = 32_768
# What stands before a secret and stays, and the secret.
PATTERNS = (
    (r"(?i)([?&](?:access_token|api[_-]?key|client_secret|password)=)", r"([^&#\"\s]+)"),
    (r"(?i)(\bBearer\s+)", r"([A-Za-z0-9._~+/=-]{6,})"),
    (r"()", r"\b(sk_(?:live|test)_[A-Za-z0-9]{8,})\b"),
    (r"()", r"\b(gh[pousr]_[A-Za-z0-9]{20,})\b"),
    (r"()", r"\b(github_pat_[A-Za-z0-9_]{20,})\b"),
    (r"()", r"\b(xox[baprs]-[A-Za-z0-9-]{10,})\b"),
    (r"()", r"\b(EA[A-Za-z0-9]{20,})\b"),
)
_SHOWN = MARK.replace("[", "\\[").replace("]", "\\]")
_COMPILED = [re.compile(kept + secret) for kept, secret in PATTERNS]


_ANY = "|".join(f"(?i:{k[4:]}{x})" if k.startswith("(?i)") else f"{k}{x}" for k, x in PATTERNS)


def _looks(text: Column) -> Column:
    """Whether there is anything to replace: one search for most texts, which hold no secret."""
    return (F.octet_length(text) <= SCAN_BYTES) & F.rlike(text, F.lit(_ANY))


def redact(text: Column) -> Column:
    """Text with its secrets replaced, all inside the engine; text that is too long stays as it is."""
    out = text
    for kept, secret in PATTERNS:
        out = F.regexp_replace(out, kept + secret, F.lit("$1" + _SHOWN))
    return F.when(_looks(text), out).otherwise(text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counting(kept: str, secret: str) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        total = s["total"] + F.regexp_count(s["rest"], F.lit(kept + secret))
        if "^" in secret:  # only this one also matches the mark
            total = total - F.regexp_count(s["rest"], F.lit(kept + _SHOWN))
        return F.struct(F.regexp_replace(s["rest"], kept + secret, F.lit("$1" + _SHOWN)).alias("rest"), total.alias("total"))

    return step


def secrets(text: Column) -> Column:
    """How many secrets the text holds; values that are redacted already do not count."""
    state = F.struct(text.alias("rest"), F.lit(0).alias("total"))
    for kept, secret in PATTERNS:
        state = _let(state, _counting(kept, secret))
    return F.when(_looks(text), state["total"]).otherwise(0)


def redact_string(text: str) -> str:
    if len(text.encode("utf-8", "replace")) > SCAN_BYTES:
        return text
    for p in _COMPILED:
        text = p.sub(lambda m: m[1] + MARK, text)
    return text


def redact_tree(value: Any) -> Any:
    """A tree with its strings redacted, also inside strings that hold JSON (whose size is not limited, that of their leaves is)."""
    if isinstance(value, dict):
        return {k: redact_tree(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_tree(v) for v in value]
    if not isinstance(value, str):
        return value
    inner = value.strip()
    if inner[:1] in ("{", "["):
        try:
            held = json.loads(inner)
        except (ValueError, RecursionError):
            return redact_string(value)
        clean = redact_tree(held)
        if clean == held:
            return value
        begin = value.index(inner)
        return value[:begin] + json.dumps(clean, ensure_ascii=False, separators=(",", ":")) + value[begin + len(inner) :]
    return redact_string(value)


@F.pandas_udf(StringType())
def redact_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text with all strings of its tree redacted; other text as a string."""

    def one(text: str) -> str:
        try:
            return json.dumps(redact_tree(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return redact_string(text)

    for texts in batches:
        yield texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)
