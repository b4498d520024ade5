"""Offline licences and seats, and small matchers of imported questions, titles and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import selling

# Cells that stand for nothing.
EMPTY_CELLS = ("NULL", "NONE", "N/A", "-", "—")


def device_slots(licences: DataFrame, keys: list[str], now: Column, days: int = 30, most: int = 2) -> DataFrame:
    """licences: keys, revoked, renewed. Those that hold a slot (not revoked, renewed in the last days) by key, and whether a new device still fits."""
    held = ~F.col("revoked") & (F.col("renewed") >= now - selling.days(days))
    return licences.groupBy(*keys).agg(F.count_if(held).alias("used")).withColumn("free", F.col("used") < most)


def renewals(requests: DataFrame, licences: DataFrame, access: DataFrame, now: Column) -> DataFrame:
    """requests: licence, user, device; licences: the same with course, revoked; access: user, course, until (null: without end).

    State of each request: unknown (no such licence of that user and device), revoked, no_access, or valid with the time until which it works offline.
    """
    own = requests.join(licences.withColumn("known", F.lit(True)), ["licence", "user", "device"], "left")
    rows = own.join(access.withColumn("open", F.lit(True)), ["user", "course"], "left")
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("revoked"), "revoked").when(F.col("open").isNull(), "no_access").otherwise("valid")
    return rows.withColumn("state", state).select("licence", "user", "device", "state", F.when(F.col("state") == "valid", selling.offline_until(F.col("until"), now)).alias("offline_until"))


def released_seats(seats: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """seats: school, student, released; subscriptions: school, end. Open seats of schools whose subscription ended, with its grace, are released now; others stay as they are."""
    ended = subscriptions.groupBy("school").agg(F.max("end").alias("end_"))
    over = F.col("released").isNull() & (F.col("end_") + selling.days(7) < now)
    return seats.join(ended, "school", "left").withColumn("changed", F.coalesce(over, F.lit(False))).withColumn("released", F.when(F.col("changed"), now).otherwise(F.col("released"))).drop("end_")


def cell(value: Column) -> Column:
    """A trimmed cell; null where it stands for nothing."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & ~F.upper(text).isin(*EMPTY_CELLS), text)


def page_cut(start: Column, end: Column, before: Column, after: Column) -> Column:
    """The page where a lesson is cut, by the words on both sides, half up; null if no page is known."""
    last = F.coalesce(F.nullif(end, F.lit(0)), start)
    return F.when(start > 0, F.floor(start + (last - start) * before / F.greatest(F.lit(1), before + after) + 0.5))


def titles_match(a: Column, b: Column) -> Column:
    """One begins with the other's first 18 characters, or they share two words and 0.6 of the shorter's; both normalised, never empty."""
    a, b = T.normalised(a), T.normalised(b)
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both = F.size(F.array_intersect(x, y))
    near = b.startswith(F.substring(a, 1, 18)) | a.startswith(F.substring(b, 1, 18)) | ((both >= 2) & (both >= 0.6 * F.least(F.size(x), F.size(y))))
    return F.coalesce((a != "") & (b != "") & near, F.lit(False))


def truncated_matches(new: DataFrame, old: DataFrame, statement: str, id_: str, least: int = 20) -> DataFrame:
    """new and old: id, statement, options (letter to text). New questions whose options begin with the cut ones of a single old row of the same statement.

    The join is on statement and letters, so only rows that can match meet.
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        options = F.map_filter(F.transform_values("options", lambda _, v: T.normalised(v)), lambda _, v: v.isNotNull() & (v != ""))
        rows = rows.select(F.col(id_).alias(name), T.normalised(F.col(statement)).alias("s_"), options.alias(f"{name}_o"))
        return rows.withColumn("k_", F.array_join(F.array_sort(F.map_keys(f"{name}_o")), ","))

    value = lambda o, k: F.element_at(F.col(o), k)
    fits = F.forall(F.map_keys("new_o"), lambda k: (value("new_o", k) == value("old_o", k)) | ((F.length(value("old_o", k)) >= least) & F.startswith(value("new_o", k), value("old_o", k))))
    differs = F.exists(F.map_keys("new_o"), lambda k: value("new_o", k) != value("old_o", k))
    pairs = side(new, "new").join(side(old, "old"), ["s_", "k_"]).filter(fits & differs)
    return pairs.groupBy("new").agg(F.min("old").alias("old"), F.count("*").alias("n")).filter("n = 1").drop("n")


def question_blocks(lines: DataFrame, key: str, size: int) -> DataFrame:
    """lines: key, place from 0, opens (a question starts here). Blocks of at least `size` lines that end before a question; only the places of questions are folded."""
    starts = lambda acc, x: F.when(x - F.element_at(acc, -1) >= size, F.concat(acc, F.array(x))).otherwise(acc)
    opened = F.array_sort(F.collect_list(F.when(F.col("opens"), F.col("place").cast("int"))))
    books = lines.groupBy(key).agg(opened.alias("q"), F.max("place").alias("end_"))
    rows = books.select(key, "end_", F.explode(F.aggregate("q", F.array(F.lit(0)), starts)).alias("first"))
    by = Window.partitionBy(key).orderBy("first")
    return rows.select(key, "first", F.coalesce(F.lead("first").over(by) - 1, F.col("end_")).alias("last"))
