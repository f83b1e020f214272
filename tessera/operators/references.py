"""References to records that do not exist.

Parent keys and referencing keys are tagged and laid out in one long table; one aggregation by
(parent table, key) tells which keys lack a parent, gained it too late or lost it. Only the
references to such keys are then looked at one by one.

Defined results: a null key (or a null part of a composed key) is no reference; null parts of a row
key are shown as empty text; rows that repeat a row key count once, by their earliest time; a null
time of a reference sorts first, is never late or deleted and has a null period; empty tables give
no rows. Columns besides the declared ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
_KEY_PART = "\u0001"


def normal_hash(name: str | Column) -> Column:
    """A hash without outer blanks, case and a leading ``sha256:``."""
    col = F.col(name) if isinstance(name, str) else name
    return F.btrim(F.regexp_replace(F.lower(F.btrim(col, F.lit(BLANKS))), "^sha256:", ""), F.lit(BLANKS))


def composed(*names: str) -> Column:
    """A key of several columns; null if one of them is."""
    return F.concat_ws(_KEY_PART, *names) if len(names) == 1 else F.concat(F.col(names[0]), *[x for n in names[1:] for x in (F.lit(_KEY_PART), F.col(n))])


@dataclass(frozen=True)
class Target:
    """A parent table: key, time from which a row exists, and optionally what ends it.

    ``valid_by`` orders the rows of a key; the last one's ``removed_at`` holds.
    """

    name: str
    rows: DataFrame
    key: Column
    since: str = "ingested_at"
    removed_at: str | None = None
    valid_by: tuple[str, ...] = ()

    def long_form(self) -> DataFrame:
        rows = self.rows.select(self.key.alias("k"), F.col(self.since).alias("since"), *([F.col(self.removed_at).alias("removed_at"), F.struct(*self.valid_by).alias("rank")] if self.removed_at else [])).where("k is not null")
        if self.removed_at:
            # max_by skips no nulls of its value: a valid row that is not removed gives null
            rows = rows.groupBy("k").agg(F.min("since").alias("since"), F.max_by(F.struct("removed_at"), "rank")["removed_at"].alias("removed_at"))
        else:
            rows = rows.withColumn("removed_at", F.lit(None).cast("timestamp_ntz"))
        none = F.lit(None).cast("timestamp_ntz")
        return rows.select(F.lit(self.name).alias("parent"), "k", F.col("since").cast("timestamp_ntz").alias("since"), F.col("removed_at").cast("timestamp_ntz").alias("removed_at"), F.lit(True).alias("is_parent"), none.alias("first_ref"), none.alias("last_ref"))


@dataclass(frozen=True)
class Reference:
    """A referencing column: its rows, their key, and the key they point at in ``target``.

    ``key_fixes_target`` says that equal row keys always point at the same target key.
    """

    name: str
    rows: DataFrame
    row_key: tuple[str, ...]
    key: Column
    target: str
    seen: str = "ingested_at"
    key_fixes_target: bool = True
    check_removed: bool = False

    def children(self) -> DataFrame:
        row_key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.row_key])
        rows = self.rows.select(F.lit(self.target).alias("parent"), self.key.alias("k"), F.lit(self.name).alias("ref_table"), row_key.alias("row_key"), F.col(self.seen).cast("timestamp_ntz").alias("seen"), F.lit(self.check_removed).alias("check_removed"))
        if not self.key_fixes_target:
            first = F.min(F.struct("seen", "k")).alias("first")
            rows = rows.where("k is not null").groupBy("parent", "ref_table", "row_key", "check_removed").agg(first).select("parent", "first.k", "ref_table", "row_key", "first.seen", "check_removed")
        return rows.where("k is not null")


def dangling_references(references: list[Reference], targets: list[Target]) -> DataFrame:
    """(ref_table, row_key, reason, period) of every reference to an absent, late or removed record.

    reason: ``missing`` if the target occurs nowhere, else ``late`` if it exists only after the
    reference was seen, else (where asked for) ``deleted`` if it was removed by then. The first
    aggregation combines on the map side, so a key that holds a large part of all rows costs one row
    per task; the join against the suspicious keys is left to adaptive execution, which broadcasts
    them only if they are measured to be small and otherwise splits hot keys over several tasks.
    """
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    none = F.lit(None).cast("timestamp_ntz")
    children = union([r.children() for r in references])
    tagged = union([t.long_form() for t in targets] + [children.select("parent", "k", none.alias("since"), none.alias("removed_at"), F.lit(False).alias("is_parent"), F.col("seen").alias("first_ref"), F.col("seen").alias("last_ref"))])
    keys = tagged.groupBy("parent", "k").agg(F.max("is_parent").alias("is_parent"), F.min("since").alias("since"), F.max("removed_at").alias("removed_at"), F.min("first_ref").alias("first_ref"), F.max("last_ref").alias("last_ref"), F.count(F.when(~F.col("is_parent"), 1)).alias("refs"))
    suspects = keys.where((F.col("refs") > 0) & (~F.col("is_parent") | (F.col("first_ref") < F.col("since")) | (F.col("removed_at") <= F.col("last_ref")))).select("parent", "k", "is_parent", "since", "removed_at")
    judged = (
        children.join(suspects, ["parent", "k"])
        .groupBy("ref_table", "row_key", "check_removed", "is_parent", "since", "removed_at")
        .agg(F.min("seen").alias("seen"))
        .withColumn(
            "reason",
            F.when(~F.col("is_parent"), "missing").when(F.col("since") > F.col("seen"), "late").when(F.col("check_removed") & (F.col("removed_at") <= F.col("seen")), "deleted"),
        )
    )
    return judged.where("reason is not null").select("ref_table", "row_key", "reason", F.date_format("seen", "yyyy-MM").alias("period"))


def dangling_by_period(found: DataFrame) -> DataFrame:
    """Counts of dangling references per referencing table, reason and month."""
    return found.groupBy("ref_table", "reason", "period").agg(F.count(F.lit(1)).alias("n"))
