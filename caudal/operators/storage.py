"""Tables in the shared folder, where lineage is cut or a frame is read several times, and numbers in order over many tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (in spark.checkpoint.dir); a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place (from 1) in the order of all rows, which must tell them apart.

    Rows are dealt in ranges and numbered within each; only the number of rows of each range (one row a partition) is summed in one
    place. The rows are written once, so that ranges and counts agree.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_part").withColumn(name, F.col("_before") + F.col("_local") + 1).drop("_at", "_part", "_local", "_before")


def numbered_within(rows: DataFrame, key: str, order: str, name: str = "number") -> DataFrame:
    """rows with their place (from 1) within their key by order (equal orders in any order); a key with many rows is dealt over many tasks."""
    placed = numbered(rows, [key, order], "_number")
    first = placed.groupBy(key).agg(F.min("_number").alias("_first")).withColumnRenamed(key, "_key")
    return placed.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, (F.col("_number") - F.col("_first") + 1).cast("int")).drop("_number", "_first", "_key")
