"""Structured Streaming twins of the attempt queries: each run processes what is there and ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def daily(spark: SparkSession, sf_dir: str, late: str = "2 days") -> DataFrame:
    """Attempts and authorised ones per user and day, from a stream of events; state is kept for the watermark's span only.

    Repeated events (same id and time) within the span count once. Days still open at the end are
    written by the last, complete pass, since the query runs in update mode into versions of which the last one holds.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = timed.groupBy(F.col("user_id").alias("user"), F.window("at", "1 day").alias("day")).agg(F.count("*").alias("attempts"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("authorised"))
    out, flat = folder(spark, "attempts"), counted.select("user", F.col("day.start").alias("day"), "attempts", "authorised")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    flow = flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    flow.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("user", "day").agg(F.max_by(F.struct("attempts", "authorised"), "version").alias("x"))
    return last.select("user", F.col("day").cast("timestamp_ntz").alias("day"), "x.attempts", "x.authorised")
