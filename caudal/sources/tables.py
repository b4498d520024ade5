"""The driver tables and the domain roles that they play; each reader selects only what the role needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAID = ("F", "O")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(text: str) -> Column:
    """A point in time without zone, as the tables hold it."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def sales(spark: SparkSession, sf_dir: str, paid: bool = True) -> DataFrame:
    """id, ts, amount, buyer, plan of paid (or of pending) sales."""
    state = F.col("o_orderstatus").isin(*PAID)
    return read(spark, sf_dir, "orders").filter(state if paid else ~state).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_custkey").alias("buyer"), F.col("o_orderpriority").alias("plan"))


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """buyer, school, channel (b2c, else b2b, null segments included)."""
    channel = F.when(F.col("c_mktsegment").eqNullSafe("HOUSEHOLD"), "b2c").otherwise("b2b")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("buyer"), F.col("c_nationkey").alias("school"), channel.alias("channel"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, user, topic, score of graded answers."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("topic"), F.col("value").alias("score"), "props")


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, start, end of validity intervals."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_shipdate").alias("start"), F.expr("l_shipdate + make_dt_interval(cast(l_quantity AS int))").alias("end"))
