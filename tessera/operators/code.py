"""Code queries: a caller's table function over a set of records.

``run(data, schema, params)`` gets a list of records and returns a list (one row each) or one value.
The source is checked before anything runs: only listed imports, no dunder names, no builtins that
reach the system. This keeps mistakes away; it is no security boundary against hostile code.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What code may import, and what it may not call.
IMPORTS = frozenset(
    "array base64 bisect calendar cmath collections copy csv dataclasses datetime decimal difflib enum fnmatch fractions functools heapq html io itertools jmespath json math numbers numpy operator pandas pprint random re statistics string struct textwrap typing unicodedata urllib uuid".split()
)
ONLY = {"urllib": {"urllib.parse"}}
BLOCKED = frozenset("__import__ breakpoint compile delattr dir eval exec exit getattr globals help input locals memoryview open quit setattr super vars".split())
BLOCKED_ATTRIBUTES = frozenset("open open_code FileIO urlopen request read_csv read_json read_parquet read_pickle to_csv to_json to_parquet to_pickle fromfile tofile load save".split())
SIGNATURES = (("data", "schema", "params"), ("artifacts", "schemas", "params"))
MAX_RECORDS, MAX_BYTES = 100_000, 50_000_000


class CodeError(ValueError):
    def __init__(self, code: str, text: str) -> None:
        super().__init__(f"{code}: {text}")
        self.code = code


def check(source: str) -> tuple[str, ...]:
    """The parameters of the source's ``run``; raises CodeError for anything that is not allowed."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        raise CodeError("AST_REJECTED", str(e)) from e
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            _allow(*(a.name for a in node.names))
        elif isinstance(node, ast.ImportFrom):
            if node.level:
                raise CodeError("IMPORT_NOT_ALLOWED", "relative import")
            _allow(node.module or "")
            for a in node.names:
                if a.name in BLOCKED_ATTRIBUTES or (node.module in ONLY and f"{node.module}.{a.name}" not in ONLY[node.module]):
                    raise CodeError("IMPORT_NOT_ALLOWED", f"{node.module}.{a.name}")
        elif isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            raise CodeError("AST_REJECTED", f"attribute {node.attr}")
        elif isinstance(node, ast.Attribute) and node.attr in BLOCKED_ATTRIBUTES:
            raise CodeError("AST_REJECTED", f"attribute {node.attr}")
        elif isinstance(node, ast.Name) and (node.id in BLOCKED or node.id.startswith("__")):
            raise CodeError("AST_REJECTED", f"name {node.id}")
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            raise CodeError("AST_REJECTED", "global state")
    runs = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == "run"]
    if len(runs) != 1:
        raise CodeError("ENTRYPOINT_MISSING", "one function run is needed")
    args = runs[0].args
    names = tuple(a.arg for a in args.args)
    if names not in SIGNATURES or args.vararg or args.kwarg or args.kwonlyargs or args.posonlyargs:
        raise CodeError("ENTRYPOINT_MISSING", f"run takes {' or '.join(map(str, SIGNATURES))}")
    return names


def _allow(*modules: str) -> None:
    for m in modules:
        root = m.split(".")[0]
        if root not in IMPORTS or (root in ONLY and m != root and m not in ONLY[root]):
            raise CodeError("IMPORT_NOT_ALLOWED", m)


@lru_cache(maxsize=64)
def compiled(source: str) -> Callable[..., Any]:
    check(source)
    space: dict[str, Any] = {"__builtins__": {k: v for k, v in _builtins().items() if k not in BLOCKED} | {"__import__": _import}}
    exec(compile(source, "<code query>", "exec"), space)  # noqa: S102 - checked above
    return space["run"]


def _builtins() -> dict[str, Any]:
    import builtins

    return vars(builtins)


def _import(name: str, *rest: Any) -> Any:
    _allow(name)
    return __import__(name, *rest)


def rows_of(result: Any) -> list[Any]:
    """A list gives its elements, anything else one row."""
    return list(result) if isinstance(result, (list, tuple)) else [result]


def targets(records: DataFrame, roots: DataFrame) -> DataFrame:
    """The records of target roots; ``roots`` has artifact_id and, one for all or each its own, root_path."""
    wanted = roots.select(F.col("artifact_id").alias("_artifact"), F.col("root_path").alias("_root")).distinct()
    return records.join(wanted, records["artifact_id"].eqNullSafe(F.col("_artifact")) & records["root_path"].eqNullSafe(F.col("_root")), "left_semi")


def warnings(artifacts: DataFrame, roots: DataFrame) -> DataFrame:
    """(artifact_id, warning) for code over the artifacts of a session.

    SAMPLED: mapped in part; NO_ROOT: no root known; OVERLAPPING_DATASETS: another artifact has the same
    dataset; MIXED_SCHEMAS: its session has the root with several schemas. artifacts: artifact_id, map_kind, session_id.
    """
    own = roots.select("artifact_id", "root_path", "dataset_hash", "schema_hash").distinct()
    again = own.where("dataset_hash is not null").groupBy("dataset_hash").agg(F.countDistinct("artifact_id").alias("n")).where("n > 1")
    placed = own.join(artifacts.select("artifact_id", F.struct("session_id").alias("s")), "artifact_id")
    mixed = placed.groupBy("s", "root_path").agg(F.countDistinct("schema_hash").alias("n")).where("n > 1")
    found = [
        (artifacts.where("map_kind = 'partial'"), "SAMPLED"),
        (artifacts.join(own, "artifact_id", "left_anti"), "NO_ROOT"),
        (own.join(again, "dataset_hash", "left_semi"), "OVERLAPPING_DATASETS"),
        (placed.join(mixed, ["s", "root_path"], "left_semi"), "MIXED_SCHEMAS"),
    ]
    return reduce(DataFrame.unionByName, [df.select("artifact_id", F.lit(w).alias("warning")) for df, w in found]).distinct()


def run_grouped(
    records: DataFrame,
    source: str,
    group: list[str],
    params: dict | None = None,
    record: str = "record",
    order: tuple[str, ...] = ("idx",),
    max_records: int = MAX_RECORDS,
    max_bytes: int = MAX_BYTES,
    artifact: str = "artifact_id",
    schemas: dict | None = None,
) -> DataFrame:
    """(group, item, error): the code applied to each group's records, in order; items are JSON text.

    ``run(data, schema, params)`` gets the group's records as one list, ``run(artifacts, schemas, params)``
    as one list for each artifact. A group's input is limited as the language demands: one with more is
    a row with the error INPUT_TOO_LARGE and no code runs for it, one whose code fails a row with
    RUNTIME_EXCEPTION; the others are not touched by it. Generators of random numbers start the same.
    """
    many = check(source) == SIGNATURES[1]
    sizes = records.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length(record)).alias("_b"))
    large = sizes.where((F.col("_n") > max_records) | (F.col("_b") > max_bytes)).select(*[F.col(g).alias(f"_{g}") for g in group])
    types = dict(records.dtypes)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        import random

        frame = frame.sort_values(list(order), kind="stable")
        error = None
        random.seed(0)
        try:
            if many:
                data: Any = {}
                for a, x in zip(frame[artifact], frame[record]):
                    own = data.setdefault(a, [])
                    if x is not None:
                        own.append(json.loads(x))
            else:
                data = [json.loads(x) for x in frame[record] if x is not None]
            rows = [json.dumps(x, sort_keys=True, default=str) for x in rows_of(compiled(source)(data, schemas, params or {}))]
        except CodeError as e:
            rows, error = [None], str(e)
        except Exception as e:  # noqa: BLE001 - whatever the caller's code raises
            rows, error = [None], f"RUNTIME_EXCEPTION: {type(e).__name__}: {e}"
        return pd.DataFrame({g: pd.Series([frame[g].iloc[0]] * len(rows), dtype=object) for g in group} | {"item": pd.Series(rows, dtype=object), "error": pd.Series([error] * len(rows), dtype=object)})

    ddl = ", ".join([*(f"{g} {types[g]}" for g in group), "item string", "error string"])
    fits = records.join(large, reduce(lambda a, b: a & b, [records[g].eqNullSafe(F.col(f"_{g}")) for g in group]), "left_anti")
    errors = large.select(*[F.col(f"_{g}").alias(g) for g in group], F.lit(None).cast("string").alias("item"), F.lit(f"INPUT_TOO_LARGE: more than {max_records} records or {max_bytes} bytes").alias("error"))
    return fits.groupBy(*group).applyInPandas(one, ddl).unionByName(errors)


def run_rows(records: DataFrame, source: str, params: dict | None = None, record: str = "record") -> DataFrame:
    """(item) of code whose result for a list is that for its parts together: applied batch by batch, no shuffle."""
    check(source)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = compiled(source)
        for frame in frames:
            items = rows_of(call([json.loads(x) for x in frame[record] if x is not None], None, params or {}))
            # typed, as a batch without items would be a column of floats
            yield pd.DataFrame({"item": pd.Series([json.dumps(x, sort_keys=True, default=str) for x in items], dtype=object)})

    return records.select(record).mapInPandas(batches, "item string")


def apply_frame(records: DataFrame, function: Callable[[DataFrame, dict], DataFrame], params: dict | None = None) -> DataFrame:
    """A function of DataFrames: planned with the rest of the query, the way to prefer."""
    return records.transform(lambda df: function(df, params or {}))


def determinism(source: str, params: dict, schema_hashes: list[str], related_hash: str) -> dict[str, str]:
    """Hashes of all that a result depends on."""
    h = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()
    return {"code_hash": hashlib.sha256(source.encode()).hexdigest(), "params_hash": h(params), "schema_hash": h(sorted(schema_hashes)), "related_set_hash": related_hash}
