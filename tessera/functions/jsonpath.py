"""JSONPath subset: ``$``, ``.name``, ``['name']``, ``[n]``, ``[*]``; parsed on the driver, evaluated as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.variants import at, elements, members, type_name
from tessera.operators.paths import name_step

MAX_LENGTH, MAX_SEGMENTS = 4096, 64
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# What may stand behind a backslash in a quoted name.
_ESCAPES = {"\\": "\\", "'": "'", "n": "\n", "r": "\r", "t": "\t"}

_END = object()  # behind the last step; no field can be called so

Step = str | int | None  # a name, a position, or None for every element


class PathError(ValueError):
    pass


def parse(path: str, max_length: int = MAX_LENGTH, max_segments: int = MAX_SEGMENTS) -> list[Step]:
    """The steps of a path; raises PathError for anything outside the subset."""
    if not isinstance(path, str) or not path.startswith("$"):
        raise PathError("a path starts with $")
    if len(path) > max_length:
        raise PathError(f"a path has at most {max_length} characters")
    steps: list[Step] = []
    i = 1
    while i < len(path):
        if path[i] == ".":
            m = _NAME.match(path, i + 1)
            if not m:
                raise PathError(f"a name is expected at {i + 1}")
            steps.append(m[0])
            i = m.end()
        elif path.startswith("[*]", i):
            steps.append(None)
            i += 3
        elif path.startswith("['", i):
            name, i = _quoted(path, i + 2)
            steps.append(name)
        elif m := re.compile(r"\[(0|[1-9]\d*)\]").match(path, i):
            steps.append(int(m[1]))
            i = m.end()
        else:
            raise PathError(f"no step is possible at {i}")
        if len(steps) > max_segments:
            raise PathError(f"a path has at most {max_segments} steps")
    return steps


def _quoted(path: str, i: int) -> tuple[str, int]:
    out = []
    while i < len(path):
        c = path[i]
        if c == "'":
            if path[i + 1 : i + 2] != "]":
                raise PathError(f"] is expected at {i + 1}")
            return "".join(out), i + 2
        if c == "\\":
            i += 1
            if path[i : i + 1] not in _ESCAPES or i >= len(path):
                raise PathError(f"no such escape at {i}")
            c = _ESCAPES[path[i]]
        out.append(c)
        i += 1
    raise PathError("a quote is not closed")


def canonical(path: str | list[Step]) -> str:
    steps = parse(path) if isinstance(path, str) else path
    return "$" + "".join("[*]" if s is None else f"[{s}]" if isinstance(s, int) else name_step(s) for s in steps)


def absolute(path: str) -> str:
    """``a.b`` and ``[0]`` as paths from the record."""
    return path if path.startswith("$") else "$" + path if path.startswith("[") else "$." + path


def select_paths(paths: list[str]) -> list[str]:
    """Canonical, without repeats, sorted; wildcards are rejected."""
    return sorted({reject_wildcards(canonical(absolute(p.strip()))) for p in paths})


def reject_wildcards(path: str, context: str = "select") -> str:
    if None in parse(path):
        raise PathError(f"no wildcard is possible in {context}: {path}")
    return path


def engine_path(steps: list[Step]) -> str:
    """A path without wildcards as the VARIANT functions read it."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' if '"' not in s else f"['{s}']" for s in steps)


def get(v: Column, path: str) -> Column:
    """The first value at a path without wildcards."""
    return at(v, engine_path(parse(reject_wildcards(path, "get"))))


def evaluate(rows: DataFrame, column: str, path: str, max_matches: int | None = None) -> DataFrame:
    """One row per match: the row's columns, ``match_pos`` (array of positions, in document order) and ``match``.

    A wildcard goes over the elements of an array or the members of an object by name; a step that
    fits nothing ends without a match. With ``max_matches`` a row with more of them is an error.
    """
    steps = parse(path)
    out = rows.withColumn("match", F.col(column)).withColumn("match_pos", F.expr("cast(array() as array<int>)"))
    plain: list[Step] = []
    for step in [*steps, _END]:
        if step is not None and step is not _END:
            plain.append(step)
            continue
        if plain:
            out = out.withColumn("match", at(F.col("match"), engine_path(plain)))
            plain = []
        if step is None:
            values = F.coalesce(elements(F.col("match")), F.transform(F.array_sort(F.map_keys(members(F.col("match")))), lambda k: F.element_at(members(F.col("match")), k)))
            if max_matches is not None:
                values = F.when(F.size(values) > max_matches, F.raise_error(F.lit(f"more than {max_matches} matches of {path}"))).otherwise(values)
            out = out.select(*[c for c in out.columns if c != "match"], F.posexplode(values).alias("_at", "match")).withColumn("match_pos", F.concat("match_pos", F.array("_at"))).drop("_at")
    return out.where(F.col("match").isNotNull())


def is_container(v: Column) -> Column:
    return type_name(v).isin("object", "array")
