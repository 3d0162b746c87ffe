"""Structured Streaming over file-change events: coalescing into a snapshot, and watermarked alert windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.merge import coalesce_changes

#: What an event of the table stands for.
CHANGE = {"view": "modified", "click": "modified", "signup": "created", "purchase": "moved", "error": "deleted"}


def file_events(jobs: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in CHANGE.items() for x in kv))
    return jobs.select("event_id", F.col("user_id").alias("file"), "ts", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("modified")).alias("change"))


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_last_change(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Maintains the last change of every file under `target`, a folder of versions named by batch. A batch that is
    run again writes the same version anew from the version before it."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = coalesce_changes(batch, ["file"], "event_id")
        if number:
            new = coalesce_changes(new.unionByName(spark.read.parquet(f"{target}/version={number - 1}")), ["file"], "event_id")
        new.write.mode("overwrite").parquet(f"{target}/version={number}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        versions = spark.read.parquet(target)
    except AnalysisException:
        return None
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")


def alert_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window of event time; late rows beyond the watermark are dropped by Spark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("change") == "deleted").alias("deleted"))
    return w.select(F.col("w.start").alias("start"), "n", "deleted")
