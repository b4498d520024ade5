"""Learning facts: levels of the last answers, streaks, achievements, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .commerce import by_last, percent


def last_n_level(answers: DataFrame, n: int = 20, least: int = 5, passing: float = 50.0) -> DataFrame:
    """Hit rate and level of each user's last n answers of a topic; no level under so many answers."""
    out = by_last(answers, ["user", "topic"], "ts", n).groupBy("user", "topic").agg(F.count("*").alias("answers"), F.count(F.when(F.col("score") >= passing, 1)).alias("hits"))
    rate = percent(F.col("hits"), F.col("answers"))
    level = F.when(F.col("answers") < least, "none").when(rate >= 80, "high").when(rate >= 50, "middle").otherwise("low")
    return out.withColumn("rate", rate).withColumn("level", level)


def weakest_topic(levels: DataFrame) -> DataFrame:
    """Each user's topic with the least rate, ties by topic."""
    return levels.filter("level <> 'none'").groupBy("user").agg(F.min(F.struct("rate", "topic")).alias("x")).select("user", "x.topic", "x.rate")


def streaks(answers: DataFrame, today: Column) -> DataFrame:
    """Longest run of active days, and the run that still holds today (it reached today or yesterday)."""
    days = answers.select("user", F.col("ts").cast("date").alias("day")).distinct()
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(Window.partitionBy("user").orderBy("day"))))
    length = runs.groupBy("user", "run").agg(F.count("*").alias("days"), F.max("day").alias("last"))
    return length.groupBy("user").agg(F.max("days").alias("longest"), F.coalesce(F.max(F.when(F.col("last") >= F.date_sub(today, 1), F.col("days"))), F.lit(0)).cast("long").alias("current"))


def level_of(xp: Column) -> Column:
    """The greatest n with 50 n (n + 1) <= xp."""
    return F.floor((F.sqrt(1.0 + xp * 0.08) - 1.0) / 2.0).cast("long")


def achievements(answers: DataFrame, today: Column, xp_each: int = 10) -> DataFrame:
    """xp, level and flags by fixed thresholds on streak and level."""
    xp = answers.groupBy("user").agg((F.count("*") * xp_each).alias("xp")).withColumn("level", level_of(F.col("xp")))
    return xp.join(streaks(answers, today), "user").withColumn("week_streak", F.col("longest") >= 7).withColumn("level_five", F.col("level") >= 5)


def progress(viewed: DataFrame, lessons: DataFrame) -> DataFrame:
    """viewed: user, lesson; lessons: lesson. Share of the existing lessons that each user saw."""
    total = lessons.agg(F.countDistinct("lesson").alias("lessons"))
    seen = viewed.join(lessons.select("lesson").distinct(), "lesson", "left_semi").groupBy("user").agg(F.countDistinct("lesson").alias("seen"))
    return seen.crossJoin(F.broadcast(total)).withColumn("progress", percent(F.col("seen"), F.col("lessons")))
