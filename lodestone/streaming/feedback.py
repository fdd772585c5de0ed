"""Structured Streaming over feedback events: the same sums as the batch operators, kept up to date.

Only sums and latest times are state; the decay with time is computed when the result is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import learn


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Feedback events as they arrive in a folder of Parquet files, with event time as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = "10 days") -> DataFrame:
    """Events delivered twice count once; the memory of event ids ends with the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_feedback(events: DataFrame) -> DataFrame:
    """(mem_id, raw, uses, last): running sums of each memory's feedback."""
    own = events.where("mem_id IS NOT NULL")
    return own.groupBy("mem_id").agg(F.sum(learn.delta(F.col("user_action"), F.col("duration_ms"))).alias("raw"), F.count("*").alias("uses"), F.max("ts").alias("last"))


def session_clicks(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session_id, start, end, clicks): clicks of each session, ended by a gap; events have a watermark. An extension: the batch form knows no gaps."""
    clicks = events.where(F.lower("user_action") == "click")
    grouped = clicks.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("clicks"))
    return grouped.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "clicks")


def windowed_actions(events: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, user_action, n): numbers of actions in tumbling or sliding windows; events have a watermark. An extension."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = events.groupBy(w.alias("w"), F.lower("user_action").alias("user_action")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "user_action", "n")


def run_to_folder(result: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Keep the newest state in a folder by batch: of what a batch changed, or (mode complete) of everything."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def schedule(spark: SparkSession, run, every: str, checkpoint: str) -> StreamingQuery:
    """Call ``run`` at a fixed interval for as long as the query runs: pruning, consolidation, rebuilding an index."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, epoch: run(epoch)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
