"""Looking back along ordered series whose size is not bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Sequence numbers per block; the sort of one task never holds more distinct positions of a series.
BLOCK = 65_536


def with_previous(rows: DataFrame, series: list[str], seq: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Add to each row the ``value`` of the row before it, by ``seq``, in its series.

    A series may hold any part of all rows, so no window spans one: rows are ordered within blocks of
    sequence numbers, and only one summary row a block is ordered along the whole series. Ties of seq
    are ordered by value. A null seq sorts first.
    """
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col(seq) / block), F.lit(-(2**62))).cast("long"))
    inner = Window.partitionBy(*series, "_block").orderBy(F.col(seq).asc_nulls_first(), value)
    within = rows.withColumn("_prev", F.lag(value).over(inner))
    last = rows.groupBy(*series, "_block").agg(F.max_by(value, F.struct(seq, value)).alias("_last"))
    carried = last.select(*series, "_block", F.lag("_last").over(Window.partitionBy(*series).orderBy("_block")).alias("_carry")).where("_carry is not null")
    on = [within[c].eqNullSafe(carried[c]) for c in series] + [within["_block"] == carried["_block"]]
    joined = within.join(carried, on, "left")
    return joined.select(*[within[c] for c in rows.columns if c != "_block"], F.coalesce(within["_prev"], carried["_carry"]).alias(out))


def as_of(rows: DataFrame, series: list[str], seq: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Add to each row the last ``value`` that is not null at or before it, by ``seq``, in its series.

    Laid out in blocks like ``with_previous``. Of rows with equal seq the ones with a value come first.
    """
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col(seq) / block), F.lit(-(2**62))).cast("long"))
    inner = Window.partitionBy(*series, "_block").orderBy(F.col(seq).asc_nulls_first(), F.col(value).isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_last", F.last(value, ignorenulls=True).over(inner))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*series, "_block").agg(F.max_by(value, F.struct(seq, value)).alias("_end"))
    starts = rows.select(*series, "_block").distinct().join(ends, [*series, "_block"], "left")
    before = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.select(*series, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carry")).where("_carry is not null")
    joined = within.join(carried, [*series, "_block"], "left")
    return joined.select(*[c for c in rows.columns if c != "_block"], F.coalesce("_last", "_carry").alias(out))


def numbered(rows: DataFrame, series: list[str], order: list[str | Column], out: str) -> DataFrame:
    """Add to each row its place, from 1, in its series by ``order`` (nulls first unless it says otherwise).

    Rows are dealt out by ranges of series and order, so a series of any length lies in many parts; rows
    are numbered within their part, and the sizes of a series' earlier parts (one row a part) are added.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(*[F.col(s).asc_nulls_first() for s in series], *keys).withColumn("_part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_part", *series).orderBy(*keys))
    placed = cut_lineage(ranged.withColumn("_in", within))
    before = Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part", *series).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("_part").alias("_p"), *[F.col(s).alias(f"_{i}") for i, s in enumerate(series)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = reduce(lambda a, b: a & b, [placed[s].eqNullSafe(starts[f"_{i}"]) for i, s in enumerate(series)], placed["_part"] == starts["_p"])
    return placed.join(starts, on).select(*[placed[c] for c in rows.columns], (F.col("_in") + F.col("_start")).alias(out))
