"""One text for two engines: questions over JSON records, written with placeholders for typed paths.

``n{path}``, ``t{path}``, ``b{path}`` are the number, text or boolean at a path (null for any other
type), ``len{path}`` the length of an array there; ``nx``, ``tx``, ``bx`` read the exploded element.
``[tool]`` is the table of a tool's records, ``[tool*path]`` the same with the elements of an array.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.variants import once
from tessera.operators.catalog import valid_rows
from tessera.session import table

_PATH = re.compile(r"\b(n|t|b|len)(x?)\{([^}]*)\}")
_FROM = re.compile(r"\[([a-z_.]+)(?:\*([^\]]+))?\]")
_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"


def _spark_path(m: re.Match) -> str:
    kind, x, path = m.groups()
    at = f"try_variant_get({'x' if x else 'v'}, '{path}', 'variant')"
    if kind == "n":
        return f"(case when schema_of_variant({at}) rlike '^(BIGINT|DOUBLE|DECIMAL)' then cast({at} as double) end)"
    if kind == "t":
        return f"(case when schema_of_variant({at}) = 'STRING' then cast({at} as string) end)"
    if kind == "b":
        return f"(case when schema_of_variant({at}) = 'BOOLEAN' then cast({at} as boolean) end)"
    return f"size(try_variant_get({'x' if x else 'v'}, '{path}', 'array<variant>'))"


def _duck_path(m: re.Match) -> str:
    kind, x, path = m.groups()
    j = "x" if x else "j"
    path = re.sub(r'\["([^"]*)"\]', r'."\1"', path)
    t = f"json_type({j}, '{path}')"
    if kind == "n":
        return f"(case when {t} in {_NUMBERS} then ({j}->>'{path}')::double end)"
    if kind == "t":
        return f"(case when {t} = 'VARCHAR' then {j}->>'{path}' end)"
    if kind == "b":
        return f"(case when {t} = 'BOOLEAN' then ({j}->>'{path}') = 'true' end)"
    return f"(case when {t} = 'ARRAY' then json_array_length({j}, '{path}') end)"


def to_duckdb(text: str) -> str:
    def source(m: re.Match) -> str:
        base = f"(select record::json j from (select distinct artifact_id, root_path, idx, record from artifact_records where json_valid(record)) r join (select artifact_id, arg_max(source_tool, (generation, ingested_at)) tool from artifacts group by 1) a using (artifact_id) where tool = '{m[1]}')"
        if m[2]:
            t, at = ("json_type(j)", "j") if m[2] == "$" else (f"json_type(j, '{m[2]}')", f"j->'{m[2]}'")
            base = f"(select j, unnest((case when {t} = 'ARRAY' then {at} else '[]'::json end)::json[]) x from {base})"
        return base

    return _FROM.sub(source, _PATH.sub(_duck_path, text))


def records_of(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """(v): the records of a tool's captures, repeated deliveries once."""
    rows = table(spark, sf_dir, "artifact_records").select("artifact_id", "root_path", "idx", "record")
    own = valid_rows(table(spark, sf_dir, "artifacts").select("artifact_id", "source_tool", "generation", "ingested_at")).where(F.col("source_tool") == tool)
    return rows.join(own.select("artifact_id"), "artifact_id", "left_semi").distinct().select(once(F.try_parse_json("record")).alias("v")).where("v is not null")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The question as one Spark plan."""
    frames: dict[str, DataFrame] = {}

    def source(m: re.Match) -> str:
        name = m[1].replace(".", "_")
        frames[name] = records_of(spark, sf_dir, m[1])
        if m[2]:
            return f"(select v, x from {{{name}}} lateral view explode(try_variant_get(v, '{m[2]}', 'array<variant>')) as x)"
        return f"{{{name}}}"

    braced = _PATH.sub(_spark_path, text)
    return spark.sql(_FROM.sub(source, braced), **frames)
