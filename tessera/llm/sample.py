"""Fixed-size sample of data whose size is not known in advance.

Every distinct key draws a pseudo-random number from its own text and the seed, so a key has one
draw however often, wherever and whenever it arrives, and any pieces of the data can be read in any
order. The k smallest draws are the sample. They are found without sorting: once the keys are
counted, two concentration bounds around the expected k-th draw accept the keys below and reject the
keys above outright; only the narrow waitlist between them is sorted. If the bounds miss (with a
probability under ``fail``), they are widened and the pass over the data is repeated.

Defined results: fewer than k keys are all returned; a null part of a key is a value like any other,
different from the empty text; equal draws (of different keys) are ordered by the key's full digest,
then by the key; k of 0 or an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Hexadecimal digits of the digest that make up a draw: 52 bits, exact in a double.
_DIGITS = 13
_SPAN = 16**_DIGITS
#: A probability of failure under which the bounds are 0 and 1.
_SURE = 1e-100


def digest(keys: list[str], seed: int) -> Column:
    parts = [x for k in keys for x in (F.lit("|"), F.when(F.col(k).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(k).cast("string"))))]
    return F.md5(F.concat(F.lit(str(seed)), *parts).cast("binary"))


def bounds(n: int, k: int, fail: float) -> tuple[float, float]:
    """Draws below the first are among the k smallest of n, those from the second on are not, each but for a probability of ``fail``."""
    if fail < _SURE:
        return 0.0, 1.0
    p, reach = k / n, -math.log(fail) / n
    # Chernoff: the number of draws below q exceeds k (falls short of it) with a probability of at most fail
    accept = p + 2 * reach / 3 - math.sqrt((2 * reach / 3) ** 2 + 2 * reach * p)
    reject = p + reach + math.sqrt(reach**2 + 2 * reach * p)
    return max(0.0, accept), min(1.0, reject)


def fixed_size_sample(pieces: list[DataFrame] | DataFrame, keys: list[str], k: int, seed: int = 0, fail: float = 1e-6, find_bounds: Callable[[int, int, float], tuple[float, float]] = bounds) -> DataFrame:
    """Exactly k distinct ``keys`` of the pieces (all, if fewer), each equally likely."""
    pieces = pieces if isinstance(pieces, list) else [pieces]
    rows = reduce(DataFrame.unionByName, [p.select(*keys) for p in pieces])
    n = rows.distinct().count()
    drawn = rows.withColumn("_digest", digest(keys, seed)).withColumn("_draw", F.conv(F.substring("_digest", 1, _DIGITS), 16, 10).cast("bigint"))
    if n <= k:
        return drawn.select(*keys).distinct()
    if k <= 0:
        return rows.limit(0)
    while True:
        accept, reject = find_bounds(n, k, fail)
        low, high = math.floor(accept * _SPAN), math.ceil(reject * _SPAN)
        near = cut_lineage(drawn.where(F.col("_draw") < high).distinct())
        sure = near.where(F.col("_draw") < low)
        taken, there = near.agg(F.count(F.when(F.col("_draw") < low, 1)), F.count(F.lit(1))).first()
        if taken <= k <= there:
            waitlist = near.where(F.col("_draw") >= low).orderBy("_draw", "_digest", *keys).limit(k - taken)
            return sure.unionByName(waitlist).select(*keys)
        fail = fail**4  # ends when the bounds are 0 and 1, which cannot miss
