"""Pages of one response after the other: their records, merging them, the roots they have."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import jsonpath
from tessera.functions.canonical import canonical_text, loads_decimal
from tessera.functions.variants import elements, members, type_name
from tessera.operators.nextpage import read

# Where responses have their records.
LISTS = ("$.data", "$.results", "$.items", "$.records", "$.entries", "$.nodes", "$.result.data", "$.result.items")
def is_true(x: Column) -> Column:
    """Truth of a configured has-more value: missing, null, false, blank and empty lists are not."""
    kind = type_name(x)
    return F.when(x.isNull() | (kind == "null"), False).when(kind == "boolean", x.cast("boolean")).when(kind == "string", F.trim(x.cast("string")) != "").when(kind == "array", F.size(elements(x)) > 0).otherwise(True)


def record_count(v: Column) -> Column:
    """The length of the response, or of its first usual list; null if there is none."""
    return F.size(F.coalesce(elements(v), *[elements(jsonpath.get(v, p)) for p in LISTS]))


_SIGNATURE = StructType([StructField("root_path", StringType()), StructField("dataset_hash", StringType()), StructField("records", IntegerType())])


def _signature(text: str | None) -> tuple[str | None, str | None, int | None]:
    try:
        value = loads_decimal(text) if text is not None else None
        lists = [(len(x), len(p), p, x) for p in ("$", *LISTS) if isinstance(x := read(value, p), list) and len(x) >= 2]
        if not lists:
            return None, None, None
        n, _, path, found = max(lists, key=lambda c: c[:3])
        return path, hashlib.sha256(canonical_text(found).encode("utf-8", "surrogatepass")).hexdigest(), n
    except (ValueError, RecursionError):
        return None, None, None


@F.pandas_udf(_SIGNATURE)
def collection_signature(texts: pd.Series) -> pd.DataFrame:
    """struct(root_path, dataset_hash, records) of a response's largest usual list of two records or more, by length, then the longer path; nulls without one.

    The hash is the same for all serialisations of the list.
    """
    return pd.DataFrame([_signature(t) for t in texts], columns=_SIGNATURE.names)


def merge_pages(pages: DataFrame, chain: str, order: list[str], value: str = "v") -> DataFrame:
    """(chain, pos, record): the records of a chain's pages one after the other.

    Records stay rows, so the merged page is never one value in one task; the wrapper's other fields
    are those of the latest page, see ``merged_wrapper``.
    """
    v = F.col(value)
    lists = F.coalesce(elements(v), *[elements(jsonpath.get(v, p)) for p in LISTS])
    return pages.select(chain, *order, F.posexplode(lists).alias("pos", "record"))


def merged_wrapper(pages: DataFrame, chain: str, order: list[str], value: str = "v") -> DataFrame:
    """(chain, wrapper): the latest page's fields without its lists, as JSON text."""
    rest = F.map_filter(members(F.col(value)), lambda k, x: type_name(x) != "array")
    return pages.groupBy(chain).agg(F.max_by(F.to_json(rest), F.struct(*order)).alias("wrapper"))


def leaf_roots(roots: DataFrame, group: list[str], path: str) -> DataFrame:
    """Roots that no other root of their group lies below; an equi-join on every prefix, not a comparison of all pairs."""
    steps = F.regexp_extract_all(path, F.lit(r"(\.[^.\[]+|\[[^\]]*\])"), 1)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.concat(F.lit("$"), F.array_join(F.slice(steps, F.lit(1), n), "")))
    distinct = roots.select(*group, path).distinct()
    above = distinct.where(F.size(steps) > 0).select(*group, F.explode(prefixes).alias(path)).distinct()
    return distinct.join(above, [*group, path], "left_anti")

