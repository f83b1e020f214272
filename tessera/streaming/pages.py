"""Pages that keep arriving: structured streaming from a folder of JSON files into the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.variants import elements

PAGE = "artifact_id string, session_id string, captured_at timestamp, page string"


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def new_pages(pages: DataFrame, delay: str = "2 days") -> DataFrame:
    """Pages without those delivered again within the delay; state older than the watermark is dropped."""
    hashed = pages.withWatermark("captured_at", delay).withColumn("page_hash", F.sha2("page", 256))
    return hashed.dropDuplicatesWithinWatermark(["session_id", "page_hash"])


def records_of(pages: DataFrame) -> DataFrame:
    v = F.try_parse_json("page")
    return pages.select("artifact_id", "captured_at", F.posexplode(F.coalesce(elements(v), F.array(v))).alias("idx", "x")).select("artifact_id", "captured_at", "idx", F.to_json("x").alias("record")).where("record is not null")


def counts_by_window(pages: DataFrame, width: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Pages per session and window of event time."""
    return pages.withWatermark("captured_at", delay).groupBy(F.window("captured_at", width), "session_id").agg(F.count(F.lit(1)).alias("pages"))


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the records of all new pages that are there, then stop; a restart goes on where it ended."""
    return records_of(new_pages(pages)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
