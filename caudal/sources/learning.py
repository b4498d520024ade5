"""Exam attempts, their answers and enrolments as the driver tables play them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, student, name, school, course (null for some), kind, mode (null for some), day, created, finished (null while open)."""
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "completa").when(F.col("o_orderpriority") == "3-MEDIUM", "quiz").otherwise("parcial")
    mode = F.when(key % 11 == 0, None).when(F.col("o_orderstatus") == "F", "evaluacion").otherwise("practica")
    finished = F.when(F.col("o_orderstatus") != "P", F.expr("o_orderdate + make_dt_interval(0, 0, 0, cast(o_orderkey % 7200 AS int))"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), F.trim(F.coalesce("c_name", F.lit(""))).alias("name"), F.col("c_nationkey").alias("school"))
    rows = read(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("student"), F.when(key % 7 == 0, None).otherwise(key % 5).alias("course"), kind.alias("kind"), mode.alias("mode"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate").alias("created"), finished.alias("finished"),
    )
    return rows.join(people, "student", "left")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam, line, exercise, category, answer (a selection, null if none), correct."""
    letter = F.expr("substring('abcdef', cast(l_suppkey % 6 AS int) + 1, 1)")
    answer = F.when(F.col("l_returnflag") == "R", None).otherwise(letter)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("exercise"), (F.col("l_partkey") % 8).alias("category"), answer.alias("answer"), (F.col("l_linestatus") == "F").alias("correct"))
