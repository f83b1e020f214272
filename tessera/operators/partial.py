"""Mapping of payloads too large to be held as trees: one pass over the text within budgets.

The scanner walks objects down to the outermost arrays (the roots) and reads these element by element,
so no more than one element is ever held. It stops at a budget and says so; what it has seen by then
is counted exactly.

Defined results: null payloads give no roots; damaged text ends the pass with ``parse_error`` and keeps
what was read before; an element that is no object is counted but never sampled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TYPE_ORDER
from tessera.operators.paths import name_step

_BLANK = re.compile(r"[ \t\r\n]*")
_decode = json.JSONDecoder().raw_decode
ROOTS = "root_path string, elements bigint, objects bigint, oversize bigint, closed boolean, stop_reason string, indices array<int>, paths map<string,string>"


@dataclass(frozen=True)
class Budget:
    characters: int = 50_000_000
    elements: int = 5_000_000
    root_depth: int = 5
    record_bytes: int = 100_000


@dataclass
class Root:
    path: str
    elements: int = 0
    objects: int = 0
    oversize: int = 0
    closed: bool = False
    stop_reason: str | None = None
    indices: list[int] = field(default_factory=list)
    paths: dict[str, set[str]] = field(default_factory=dict)


class _Stop(Exception):
    pass


class Scanner:
    def __init__(self, text: str, budget: Budget) -> None:
        self.text, self.budget = text, budget
        self.roots: list[Root] = []
        self.seen = 0

    def run(self) -> list[Root]:
        reason = None
        try:
            self._value(self._skip(0), "$", 0)
        except _Stop as e:
            reason = str(e)
        except (ValueError, IndexError, RecursionError):
            reason = "parse_error"
        for root in self.roots:
            root.stop_reason = None if root.closed else reason
        return self.roots

    def _skip(self, at: int) -> int:
        at = _BLANK.match(self.text, at).end()
        if at > self.budget.characters:
            raise _Stop("max_bytes")
        return at

    def _value(self, at: int, path: str, depth: int) -> int:
        """Read the value that begins at a position; returns the position after it."""
        start = self.text[at]
        if start == "[" and depth <= self.budget.root_depth:
            return self._array(at, path)
        if start == "{" and depth < self.budget.root_depth:
            return self._object(at, path, depth)
        return _decode(self.text, at)[1]

    def _object(self, at: int, path: str, depth: int) -> int:
        at = self._skip(at + 1)
        if self.text[at] == "}":
            return at + 1
        while True:
            name, at = _decode(self.text, at)
            at = self._skip(at)
            if not isinstance(name, str) or self.text[at] != ":":
                raise ValueError("a name is expected")
            at = self._skip(self._value(self._skip(at + 1), path + name_step(name), depth + 1))
            if self.text[at] == "}":
                return at + 1
            if self.text[at] != ",":
                raise ValueError("a comma is expected")
            at = self._skip(at + 1)

    def _array(self, at: int, path: str) -> int:
        root = Root(path)
        self.roots.append(root)
        at = self._skip(at + 1)
        if self.text[at] == "]":
            root.closed = True
            return at + 1
        while True:
            if self.seen >= self.budget.elements:
                raise _Stop("max_elements")
            begin = at
            element, at = _decode(self.text, at)
            self._element(root, element, at - begin)
            at = self._skip(at)
            if self.text[at] == "]":
                root.closed = True
                return at + 1
            if self.text[at] != ",":
                raise ValueError("a comma is expected")
            at = self._skip(at + 1)

    def _element(self, root: Root, element: object, size: int) -> None:
        self.seen += 1
        root.elements += 1
        if isinstance(element, dict):
            root.objects += 1
            if size > self.budget.record_bytes:
                root.oversize += 1
            else:
                root.indices.append(root.elements - 1)
            self._paths(root, element, "$")

    def _paths(self, root: Root, value: object, path: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                step = path + name_step(k)
                root.paths.setdefault(step, set()).add(_kind(v))
                self._paths(root, v, step)
        elif isinstance(value, list):
            for v in value:
                step = path + "[*]"
                root.paths.setdefault(step, set()).add(_kind(v))
                self._paths(root, v, step)


def _kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def map_payloads(payloads: DataFrame, key: str, text: str, budget: Budget = Budget()) -> DataFrame:
    """One row per payload and root: counts, whether the array was read to its end, why not, paths with types.

    ``indices`` are those of the elements a sample may take.
    """
    fields = [pa.field(key, pa.string()), pa.field("root_path", pa.string()), *[pa.field(n, pa.int64()) for n in ("elements", "objects", "oversize")], pa.field("closed", pa.bool_()), pa.field("stop_reason", pa.string()), pa.field("indices", pa.list_(pa.int32())), pa.field("paths", pa.map_(pa.string(), pa.string()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None:
                    continue
                rows = [(k, r.path, r.elements, r.objects, r.oversize, r.closed, r.stop_reason, r.indices, [(p, ",".join(sorted(s, key=TYPE_ORDER.index))) for p, s in r.paths.items()]) for r in Scanner(t, budget).run()]
                columns = list(zip(*rows)) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return payloads.select(payloads[key].cast("string").alias(key), payloads[text].cast("string").alias(text)).mapInArrow(run, f"{key} string, {ROOTS}")


def collapsed(roots: DataFrame, key: str) -> DataFrame:
    """One row per payload as if its roots were one: counts summed, complete only if every root is, and where each root starts."""
    one = roots.groupBy(key).agg(F.sum("elements").alias("_n"), F.sum("oversize").alias("_o"), F.bool_and("closed").alias("complete"), F.min("stop_reason").alias("stop_reason"), F.array_sort(F.collect_list(F.struct("root_path", "elements"))).alias("_placed"))
    before = lambda i: F.aggregate(F.slice("_placed", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x["elements"])
    starts = F.transform("_placed", lambda r, i: F.struct(r["root_path"].alias("root_path"), before(i).alias("start")))
    return one.select(key, F.col("_n").alias("elements"), F.col("_o").alias("oversize"), "complete", "stop_reason", starts.alias("starts"))
