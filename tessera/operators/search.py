"""Catalog search: conditions on artifacts, full text with BM25 ranking, orders and pages."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.variants import ascii_lower, once
from tessera.session import cut_lineage

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
ORDERS = {
    "created_seq_desc": lambda: [F.col("created_seq").desc_nulls_last(), F.col("artifact_id")],
    "last_seen_desc": lambda: [F.col("last_referenced_at").desc_nulls_last(), F.col("artifact_id")],
    "chain_seq_asc": lambda: [F.col("chain_seq").asc_nulls_last(), F.col("created_seq"), F.col("artifact_id")],
}


def conditions(filters: dict[str, Any]) -> Column:
    """The predicate of catalog filters on artifact columns; unknown keys are an error.

    Deleted artifacts are left out unless ``include_deleted``; ``source_tool_prefix`` matches whole
    dotted parts, without ASCII case.
    """
    made = {
        "include_deleted": lambda v: F.lit(True),
        "status": lambda v: F.col("error_summary").isNull() if v == "ok" else F.col("error_summary").isNotNull(),
        "source_tool_prefix": lambda v: F.startswith(ascii_lower(F.col("source_tool")), ascii_lower(F.lit(v + "."))),
        "has_binary_refs": lambda v: (F.col("payload_binary_bytes_total") > 0) == v,
        "created_seq_min": lambda v: F.col("created_seq") >= v,
        "created_seq_max": lambda v: F.col("created_seq") <= v,
        "created_at_after": lambda v: F.col("created_at") > F.lit(v).cast("timestamp_ntz"),
        "created_at_before": lambda v: F.col("created_at") < F.lit(v).cast("timestamp_ntz"),
    }
    equal = ("source_tool", "kind", "upstream_instance_id", "request_key", "capture_kind", "capture_key", "payload_hash_full", "parent_artifact_id")
    parts = [] if filters.get("include_deleted") else [F.col("deleted_at").isNull()]
    for key, value in filters.items():
        if key in equal:
            parts.append(F.col(key) == value)
        elif key in made:
            parts.append(made[key](value))
        else:
            raise ValueError(f"no such filter: {key}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


Term = tuple[str | None, tuple[str, ...], bool]  # column, words of a phrase, whether the last is a prefix
_PIECE = re.compile(r'\s*(?:(\w+):)?(?:"([^"]*)"|(\w+)(\*)?)(?=\s|$)', re.UNICODE)


def parse_query(query: str, columns: list[str]) -> list[tuple[list[Term], list[Term]]]:
    """Alternatives, each with the terms it wants and those it must not have.

    Terms are words, ``prefix*`` or ``"phrases"``, in all columns or in one (``column:term``); terms side by
    side are and-ed, ``NOT`` goes before the one it rules out, ``OR`` binds least.
    """
    out: list[tuple[list[Term], list[Term]]] = []
    for part in re.split(r"\s+OR\s+", query.strip()) if query.strip() else []:
        wanted: list[Term] = []
        barred: list[Term] = []
        at, negate = 0, False
        while at < len(part):
            m = _PIECE.match(part, at)
            if not m:
                raise ValueError(f"no term is possible at {part[at:]!r}")
            at = m.end()
            column, phrase, word, star = m.groups()
            if word == "NOT" and column is None and not star:
                if negate or not wanted:
                    raise ValueError("NOT goes between terms")
                negate = True
                continue
            if column is not None and column not in columns:
                raise ValueError(f"no such column: {column}")
            words = tuple(w for w in re.split(r"[\W_]+", (phrase if phrase is not None else word).lower()) if w)
            if words:
                (barred if negate else wanted).append((column, words, bool(star)))
            negate = False
        if negate:
            raise ValueError("NOT goes between terms")
        if wanted:
            out.append((wanted, barred))
    return out


def _hits(words: Column, term: Term) -> Column:
    """How often a term occurs in an array of words."""
    _, phrase, prefix = term
    fits = lambda w, p, last: F.startswith(w, F.lit(p)) if prefix and last else w == p
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: fits(w, phrase[0], True)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1)))
    at = lambda i, k: F.try_element_at(words, i + k)
    whole = lambda i: reduce(lambda a, b: a & b, [F.coalesce(at(i, k) == p, F.lit(False)) for k, p in enumerate(phrase)])
    return F.when(F.size(words) >= len(phrase), F.size(F.filter(starts, whole))).otherwise(0)


def bm25(documents: DataFrame, key: str, columns: list[str], query: str) -> DataFrame:
    """(key, score) of the rows that match ``query`` (see ``parse_query``), best (lowest) score first by convention.

    Words of all rows are counted once and kept as numbers, in a written table; one aggregation of it
    gives the frequencies, and only matching rows leave the second reading.
    """
    groups = parse_query(query, columns)
    terms = sorted({t for wanted, barred in groups for t in (*wanted, *barred)}, key=repr)
    if not terms:
        return documents.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = documents.select(key, *[once(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>"))).alias(f"_w{i}") for i, c in enumerate(columns[:1])], *columns[1:])
    rows = rows.select(key, "_w0", *[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"_w{i}") for i, c in enumerate(columns[1:], 1)])
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    count = lambda t: total([_hits(F.col(f"_w{i}"), t) for i, c in enumerate(columns) if t[0] in (None, c)])
    counted = cut_lineage(rows.select(key, total([F.size(f"_w{i}") for i in range(len(columns))]).alias("_dl"), *[count(t).alias(f"_f{i}") for i, t in enumerate(terms)]))
    totals = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("bigint")).alias(f"_df{i}") for i in range(len(terms))])
    scored = counted.crossJoin(F.broadcast(totals))  # totals is one row

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(IDF_FLOOR))
        f = F.col(f"_f{i}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))

    has = lambda t: F.col(f"_f{terms.index(t)}") > 0
    hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [*map(has, wanted), *(~has(t) for t in barred)]) for wanted, barred in groups])
    asked = sorted({terms.index(t) for wanted, _ in groups for t in wanted})
    return scored.where(hit).select(key, (-total([part(i) for i in asked])).alias("score"))


def page(rows: DataFrame, order: str | list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows and one more, which tells that another page follows."""
    columns = ORDERS[order]() if isinstance(order, str) else order
    rows = rows.orderBy(*columns)
    return (rows.offset(offset) if offset else rows).limit(limit + 1)
