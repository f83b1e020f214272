"""The select operator: filter, project, distinct, order, offset and limit, byte budget, or a count."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.functions.variants import elements, ordered, text_of, type_name
from tessera.operators.filters import compile_filter

_ORDER = re.compile(r"^\s*(?:(?P<cast>to_number|to_string)\(\s*(?P<inner>[^()]+?)\s*\)|(?P<plain>[^()\s]+))(?:\s+(?P<dir>asc|desc))?\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class Order:
    """``field``, ``to_number(field)`` or ``to_string(field)``, each with an optional ASC or DESC."""

    path: str
    cast: str | None
    descending: bool

    @classmethod
    def parse(cls, raw: str) -> Order:
        m = _ORDER.match(raw)
        if not m:
            raise ValueError(f"no such order: {raw!r}")
        path = jsonpath.canonical(jsonpath.absolute(m["inner"] or m["plain"]))
        return cls(path, m["cast"] and m["cast"].lower(), (m["dir"] or "").lower() == "desc")

    def columns(self, v: Column) -> list[Column]:
        """Missing, null and unconvertible values come last in both directions."""
        x = jsonpath.get(v, self.path)
        if self.cast == "to_number":
            key = F.when(type_name(x).isin("number", "string"), F.try_variant_get(x, "$", "double")).when(type_name(x) == "boolean", x.cast("boolean").cast("double"))
        elif self.cast == "to_string":
            key = text_of(x)
        else:
            key = ordered(x)
        return [key.desc_nulls_last() if self.descending else key.asc_nulls_last()]


@dataclass(frozen=True)
class Select:
    paths: list[str] = field(default_factory=list)
    where: dict | None = None
    distinct: bool = False
    order_by: str | None = None
    limit: int | None = None
    offset: int = 0
    missing_as_null: bool = False
    max_bytes: int | None = None


def projection(v: Column, paths: list[str], missing_as_null: bool = False) -> Column:
    """JSON text of an object with one member per path (all of the record if there are none)."""
    if not paths:
        return F.to_json(v)
    names = jsonpath.select_paths(paths)
    values = [F.when(~F.is_variant_null(x), x) for x in (jsonpath.get(v, n) for n in names)]
    return F.to_json(F.struct(*[x.alias(n) for n, x in zip(names, values)]), {"ignoreNullFields": str(not missing_as_null).lower()})


def candidates(records: DataFrame, spec: Select, value: str = "v") -> DataFrame:
    rows = records.where(compile_filter(spec.where, F.col(value))) if spec.where else records
    return rows.withColumn("item", projection(F.col(value), spec.paths, spec.missing_as_null))


def select(records: DataFrame, spec: Select, position: list[str], value: str = "v") -> DataFrame:
    """The selected rows: position columns and ``item`` (JSON text).

    ``position`` orders the records (pages of a chain first, then the index); it breaks ties.
    Distinct keeps the first of equal items in that order. The plan sorts only for a limit or
    budget: with a limit alone it is a top-k, never a total sort.
    """
    rows = candidates(records, spec, value)
    order = [*(Order.parse(spec.order_by).columns(F.col(value)) if spec.order_by else []), *[F.col(c).asc_nulls_first() for c in position]]
    if spec.distinct:
        first = F.min_by(F.struct(*position, value), F.struct(*position)).alias("_first")
        rows = rows.groupBy("item").agg(first).select("item", "_first.*")
    if spec.offset or spec.limit is not None or spec.max_bytes is not None:
        rows = rows.orderBy(*order)
        rows = rows.offset(spec.offset) if spec.offset else rows
        # no item is shorter than {}, so a budget alone bounds the rows too
        most = min(n for n in (spec.limit, spec.max_bytes // 2 + 1 if spec.max_bytes is not None else None) if n is not None) if spec.limit is not None or spec.max_bytes is not None else None
        rows = rows.limit(most) if most is not None else rows
    if spec.max_bytes is not None:
        rows = byte_budget(rows, order, spec.max_bytes)
    return rows.select(*position, "item")


def byte_budget(rows: DataFrame, order: list[Column], max_bytes: int, item: str = "item") -> DataFrame:
    """The longest prefix of the ordered rows that fits ``max_bytes``; the first row always does.

    Its rows are those of a page (``select`` limits them first): it orders them in one task.
    """
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = rows.withColumn("_bytes", F.sum(F.octet_length(item)).over(so_far)).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return sized.where((F.col("_bytes") <= max_bytes) | (F.col("_n") == 1)).drop("_bytes", "_n")


def count(records: DataFrame, spec: Select, value: str = "v") -> DataFrame:
    """One row: the number of selected rows, or of different items."""
    rows = candidates(records, spec, value)
    return rows.agg((F.countDistinct("item") if spec.distinct else F.count(F.lit(1))).alias("n"))


def collected(rows: DataFrame, keys: list[str], column: str, path: str) -> DataFrame:
    """(keys, pos, item): what there is at a path of each row, the elements of a match that is alone and a list, else the matches.

    ``keys`` name a row; a row's own matches are looked at together, never those of several.
    """
    steps = jsonpath.parse(path)
    found = jsonpath.evaluate(rows.select(*keys, column), column, path).select(*keys, "match_pos", "match")
    alone = F.lit(True) if None not in steps else F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    found = found.withColumn("_list", F.when(alone, elements(F.col("match"))))
    inner = found.where("_list is not null").select(*keys, F.posexplode("_list").alias("pos", "item"))
    order = Window.partitionBy(*keys).orderBy("match_pos")
    own = found.where("_list is null").select(*keys, (F.lit(0) if None not in steps else F.row_number().over(order) - 1).alias("pos"), F.col("match").alias("item"))
    return inner.unionByName(own)
