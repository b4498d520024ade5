"""General operators: deduplication, intervals, as-of and capacity lookups, sampling, upserts, row scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole row with the greatest order of each key; an aggregate, so that hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def duplicates(rows: DataFrame, key: Column, id_: str) -> DataFrame:
    """Rows whose key an earlier row (smaller id) has too, with that row's id; the key is computed once, and only digests and ids move."""
    keyed = rows.select(F.col(id_), F.sha2(key, 256).alias("key")).filter("key IS NOT NULL")
    # An aggregate, so that a key that many rows share combines before the shuffle; a join's rows of one key can be split over tasks.
    first = keyed.groupBy("key").agg(F.min(id_).alias("first_id"), F.max(id_).alias("last_id")).filter("last_id > first_id").drop("last_id")
    return keyed.join(first, "key").filter(F.col(id_) > F.col("first_id")).select(id_, "first_id")


def merge_intervals(rows: DataFrame, key: str) -> DataFrame:
    """Touching or overlapping intervals (start, end) of a key made one."""
    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(by)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("island")


def asof(probes: DataFrame, facts: DataFrame, key: str, value: str) -> DataFrame:
    """probes (key, ts, ...) with the value of the last fact (key, ts, value) at or before each; one shuffle by key, no range join."""
    rest = [c for c in probes.columns if c not in (key, "ts")]
    sides = probes.withColumn("side", F.lit(1)).unionByName(facts.select(key, "ts", value).withColumn("side", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sides.withColumn(value, F.last(value, ignorenulls=True).over(by)).filter("side = 1").select(key, "ts", *rest, value)


def capacity(needs: DataFrame, need: str, sizes: DataFrame, size: str, ranges: int = 64) -> DataFrame:
    """Each need with the smallest size that holds it, by running minima over the distinct values of needs and sizes.

    The values are cut into ranges at approximate quantiles; what a range does not hold comes from the least size behind it, of
    which there is one for each range. Needs then look theirs up by an equal join.
    """
    asked = needs.select(F.col(need).cast("double").alias("x")).distinct().withColumn("asked", F.lit(1))
    held = sizes.select(F.col(size).cast("double").alias("x")).distinct().withColumn("asked", F.lit(0))
    both = asked.unionByName(held).filter("x IS NOT NULL")
    cuts = sorted(set(both.agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)])).first()[0] or []))
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c < F.col("x")))
    both = both.withColumn("part", part)
    least = {r.part: r.x for r in both.filter("asked = 0").groupBy("part").agg(F.min("x").alias("x")).collect()}
    behind = F.array(*(F.lit(min((x for p, x in least.items() if p > i), default=None)) for i in range(len(cuts) + 1))).cast("array<double>")
    by = Window.partitionBy("part").orderBy(F.desc("x"), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("fits", F.coalesce(F.min(F.when(F.col("asked") == 0, F.col("x"))).over(by), F.get(behind, F.col("part")))).filter("asked = 1").select("x", "fits")
    return needs.join(told, F.col(need).cast("double") == F.col("x"), "left").select(*needs.columns, "fits")


def round_robin(rows: DataFrame, group: str, id_: str, n: int) -> DataFrame:
    """n rows, one group after the other, each group in an order fixed by a hash of the id."""
    by = Window.partitionBy(group).orderBy(F.sha2(F.col(id_).cast("string"), 256))
    turns = rows.withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= n)
    return turns.orderBy("turn", group).limit(n)


def upsert_actions(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and create, update, delete or keep, by a full outer join."""
    both = old.select(key, F.col(value).alias("was"), F.lit(True).alias("old")).join(new.select(key, F.col(value).alias("is"), F.lit(True).alias("new")), key, "full")
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("is")), "keep").otherwise("update")
    return both.select(key, action.alias("action"))


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child row; an anti join, so nothing is counted first."""
    return parents.join(children.select(key), key, "left_anti").select(parents.columns)


def by_any_path(rows: DataFrame, key: str, *paths: DataFrame) -> DataFrame:
    """Rows whose key at least one of the paths reaches, each once."""
    reached = paths[0].select(key)
    for path in paths[1:]:
        reached = reached.unionByName(path.select(key))
    return rows.join(reached, key, "left_semi").select(rows.columns)


def contained(probes: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Probes (key, ts, ...) that lie in an interval (start, end) of their key, ends included.

    Intervals of a key are merged first; then the last one that starts before a probe decides, so no range join is needed.
    """
    islands = merge_intervals(intervals, key).select(key, F.col("start").alias("ts"), "end")
    return asof(probes, islands, key, "end").filter(F.col("ts") <= F.col("end")).select(probes.columns)


def systematic(rows: DataFrame, group: str, id_: str, step: int, most: int) -> DataFrame:
    """Every step-th row of each group by id, at most so many; the bound on the place lets tasks drop the rest before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(id_))
    numbered = rows.withColumn("place", place).filter(F.col("place") <= step * most)
    return numbered.filter((F.col("place") - 1) % step == 0)


def steps(facts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Facts whose value differs from the one before, with that one."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return facts.withColumn("previous", before).filter(~F.col(value).eqNullSafe(F.col("previous")))


def gapless(rows: DataFrame, key: str, place: str) -> DataFrame:
    """key, parts and whether its places run from 1 without gap or repetition; an aggregate, no order needed."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("parts"), F.countDistinct(place).alias("kinds"), F.min(place).alias("low"), F.max(place).alias("high"))
    whole = (F.col("low") == 1) & (F.col("high") == F.col("parts")) & (F.col("kinds") == F.col("parts"))
    return sizes.select(key, "parts", whole.alias("gapless"))


def next_larger(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Each distinct size of a key with the next larger one, null for the largest."""
    return rows.select(key, size).distinct().withColumn("larger", F.lead(size).over(Window.partitionBy(key).orderBy(size)))
