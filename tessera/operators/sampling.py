"""Bounded samples per root: a reservoir with a fixed generator, and what it covers."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.series import numbered

MAX_RECORD_BYTES, MAX_RECORDS = 100_000, 100
_WORD = (1 << 64) - 1
#: Records of a root that one generator draws for in a row.
BLOCK = 65_536


def seed_of(payload_hash: str, root_path: str, fingerprint: str) -> bytes:
    return hashlib.sha256(f"{payload_hash}|{root_path}|{fingerprint}".encode()).digest()


class Generator:
    """xoshiro256** seeded by SplitMix64; both as published by their authors."""

    def __init__(self, seed: bytes) -> None:
        x = int.from_bytes(seed[:8].ljust(8, b"\0"), "little")
        self.state = []
        for _ in range(4):
            x = (x + 0x9E3779B97F4A7C15) & _WORD
            z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _WORD
            self.state.append(z ^ (z >> 31))
        if not any(self.state):
            self.state[0] = 1

    def random(self) -> float:
        a, b, c, d = self.state
        turn = lambda v, k: ((v << k) | (v >> (64 - k))) & _WORD
        out = turn(b * 5 & _WORD, 7) * 9 & _WORD
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, c ^ (b << 17 & _WORD), turn(d, 45)]
        return (out >> 11) / (1 << 53)


    def skip(self, n: int) -> None:
        """Move on by ``n`` draws at once: a draw is linear in the state's bits, so powers of two of it are tables."""
        state = sum(w << (64 * i) for i, w in enumerate(self.state))
        k = 0
        while n:
            if n & 1:
                state = _applied(_jump(k), state)
            n >>= 1
            k += 1
        self.state = [(state >> (64 * i)) & _WORD for i in range(4)]


@lru_cache(maxsize=64)
def _jump(k: int) -> tuple[int, ...]:
    """What each of the 256 bits of a state becomes after 2^k draws."""
    if k:
        half = _jump(k - 1)
        return tuple(_applied(half, column) for column in half)
    columns = []
    for bit in range(256):
        g = Generator.__new__(Generator)
        g.state = [(1 << bit) >> (64 * i) & _WORD for i in range(4)]
        g.random()
        columns.append(sum(w << (64 * i) for i, w in enumerate(g.state)))
    return tuple(columns)


def _applied(columns: tuple[int, ...], state: int) -> int:
    out = 0
    while state:
        low = state & -state
        out ^= columns[low.bit_length() - 1]
        state ^= low
    return out


def reservoir(records: DataFrame, root: list[str], index: str, size: str, seed: str, max_bytes: int = MAX_RECORD_BYTES, max_records: int = MAX_RECORDS, block: int = BLOCK) -> DataFrame:
    """(root, index) of the records with the smallest draws of each root.

    Draws are handed out in order of the index to the records within ``max_bytes``. A root's records
    are drawn for in blocks, whose generators skip the draws of the blocks before; each block
    keeps its smallest, and the smallest of these are the root's, so no task sees all of a large root.
    """
    types = dict(records.dtypes)
    keys = [*root, index]
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(k, arrow[types[k]]) for k in keys] + [("_draw", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap, draws = None, [], None

        def flush() -> list[tuple]:
            return [(*current[:-1], at, -draw) for draw, at in heap] if current is not None else []

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in (*root, "_block", index, seed)]):
                if row[: len(root) + 1] != current:
                    out += flush()
                    current, heap, draws = row[: len(root) + 1], [], Generator(bytes.fromhex(row[-1]))
                    draws.skip(current[-1] * block)
                entry = (-draws.random(), row[-2])
                if len(heap) < max_records:
                    heapq.heappush(heap, entry)
                elif entry[0] > heap[0][0]:
                    heapq.heapreplace(heap, entry)
            yield _batch(out, schema)
        yield _batch(flush(), schema)

    fit = numbered(records.where(F.col(size) <= max_bytes).select(*keys, seed), root, [F.col(index).asc_nulls_first()], "_place")
    rows = fit.withColumn("_block", F.floor((F.col("_place") - 1) / block).cast("bigint")).repartition(*root, "_block").sortWithinPartitions(*root, "_block", "_place")
    drawn = rows.select(*root, "_block", index, seed).mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "_draw double"]))
    best = F.row_number().over(Window.partitionBy(*root).orderBy("_draw", index))
    return drawn.withColumn("_n", best).where(F.col("_n") <= max_records).select(*keys)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def coverage(records: DataFrame, root: list[str], size: str, max_bytes: int = MAX_RECORD_BYTES, max_records: int = MAX_RECORDS) -> DataFrame:
    """Per root: records seen, too large ones, and the size its sample must have."""
    out = records.groupBy(*root).agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col(size) > max_bytes, 1)).alias("oversize"))
    return out.withColumn("sampled", F.least(F.col("seen") - F.col("oversize"), F.lit(max_records)))
