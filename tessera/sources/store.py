"""Tables in a folder that several writers append to.

A write goes to a folder of its own first and counts only once it is committed: the next number of the
table's log is created as a file, which fails if another writer was first. That writer's rows are
then looked at too and the number after it is tried, so no key is ever appended twice, and readers see
whole commits or nothing. Lost executors or drivers leave uncommitted folders, which nobody reads.

Defined results: rows that repeat a key within one write count once; null parts of a key equal each
other; an empty write commits nothing; a table without commits reads as empty with the given schema.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from tessera.functions.canonical import canonical


class Taken(RuntimeError):
    """The number of a commit is taken by another writer."""


class Table:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[dict]:
        """The commits in order; each names what it put there and what it replaced."""
        log = self._path("log")
        if not self._fs.exists(log):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._text(n)) for n in names]

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"log/{name}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def folders(self, commits: list[dict] | None = None) -> list[str]:
        out: list[str] = []
        for c in self.commits() if commits is None else commits:
            out = [f for f in out if f not in c["gone"]] + c["come"]
        return out

    def read(self, schema: StructType | str | None = None) -> DataFrame:
        """The rows of all commits."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, number: int, come: list[str], gone: list[str]) -> None:
        target = self._path(f"log/{number:012}.json")
        try:
            stream = self._fs.create(target, False)  # fails if the number is there
        except Exception as e:  # noqa: BLE001 - the file system's own kinds of errors
            raise Taken(str(target)) from e
        try:
            stream.write(json.dumps({"come": come, "gone": gone}).encode())
        finally:
            stream.close()

    def append_absent(self, rows: DataFrame, keys: list[str]) -> int:
        """Append the rows whose key the table lacks; returns the number of the commit, -1 if nothing was new."""
        rows = rows.dropDuplicates(keys)
        folder, seen = None, None
        while True:
            commits = self.commits()
            there = self.folders(commits)
            if folder is None or there != seen:
                fresh = rows
                if there:
                    old = self.spark.read.parquet(*[f"{self.path}/{f}" for f in there]).select(*[F.col(k).alias(f"_{k}") for k in keys])
                    fresh = rows.join(old, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(old[f"_{k}"]) for k in keys]), "left_anti")
                folder, seen = self._write(fresh), there
                if self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").limit(1).count() == 0:
                    return -1
            try:
                self._commit(len(commits), [folder], [])
                return len(commits)
            except Taken:
                continue

    def update(self, changed: Column, values: dict[str, Column], expected: int | None = None) -> int:
        """Set columns of the rows for which ``changed`` holds; with ``expected``, only if that many commits are all there are (else Taken)."""
        while True:
            commits = self.commits()
            if expected is not None and len(commits) != expected:
                raise Taken(f"{len(commits)} commits, not {expected}")
            there = self.folders(commits)
            if not there:
                return -1
            rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f in there])
            hit = F.coalesce(changed, F.lit(False))
            folder = self._write(rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]))
            try:
                self._commit(len(commits), [folder], there)
                return len(commits)
            except Taken:
                if expected is not None:
                    raise


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Text as gzip bytes, the same for the same text."""
    return texts.map(lambda t: gzip.compress(t.encode(), mtime=0), na_action="ignore")


@F.pandas_udf(StringType())
def unpacked(data: pd.Series) -> pd.Series:
    """The text of gzip bytes; null if they are damaged."""

    def one(b: bytes) -> str | None:
        try:
            return gzip.decompress(b).decode()
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    return data.map(one, na_action="ignore").astype(object)


def prepared(payloads: DataFrame, text: str, compression: str = "gzip") -> DataFrame:
    """Payloads in canonical form with their hash, size and stored bytes (gzip or none); those that are no JSON keep their text."""
    canon = F.coalesce(canonical(F.col(text)), F.col(text))
    rows = payloads.withColumn("canonical", canon).withColumn("payload_hash_full", F.sha2("canonical", 256)).withColumn("payload_json_bytes", F.octet_length("canonical"))
    return rows.withColumn("stored", packed(F.col("canonical")) if compression == "gzip" else F.col("canonical").cast("binary"))


def verified(stored: DataFrame, compression: str = "gzip") -> DataFrame:
    """Stored payloads read back: ``envelope`` and whether it still has its hash."""
    text = unpacked(F.col("stored")) if compression == "gzip" else F.col("stored").cast("string")
    return stored.withColumn("envelope", text).withColumn("intact", F.coalesce(F.sha2("envelope", 256) == F.col("payload_hash_full"), F.lit(False)))
