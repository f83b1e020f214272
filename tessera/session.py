"""Session helpers: factory, checkpoint folder, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_written: dict[str, SparkSession] = {}


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly work by row: a scan with fewer parts than the cluster has cores is dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """The same with the number of rows that meet a condition, counted as they are written."""
    seen = Observation()
    return cut_lineage(df.observe(seen, F.count(F.when(condition, 1)).alias("n"))), seen.get["n"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, so that lost executors cost no recomputation.

    A written table, not checkpoint(): what follows is planned by the table's real size. A checkpoint
    keeps the size estimated for its plan, and that estimate multiplies with each join of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _written[path] = spark
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path and (spark := _written.pop(path, None)) is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
