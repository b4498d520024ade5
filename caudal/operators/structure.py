"""Sequences of lines, paragraphs and ranges: paragraphs, repairs, merges, batches, titles and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import numbered_within


def paragraphs(docs: DataFrame, id_: str) -> DataFrame:
    """id, place, text of each paragraph: blank lines and headings end one; a heading stands alone. A document's lines meet in one task."""
    lines = docs.select(id_, F.posexplode(T.clean_lines(F.col("text"))).alias("pos", "line"))
    marked = lines.withColumns({"blank": F.col("line") == "", "head": T.is_heading(F.col("line"))})
    by = Window.partitionBy(id_).orderBy("pos")
    before = lambda c: F.coalesce(F.lag(c).over(by), F.lit(True))
    opened = marked.withColumn("opens", (F.col("head") | before("blank") | before("head")).cast("int")).filter("NOT blank")
    numbered = opened.withColumn("place", F.sum("opens").over(by))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy(id_, "place").agg(joined.alias("text"), F.max("head").alias("head"))


def repaired(ranges: DataFrame, key: str, size: str) -> DataFrame:
    """ranges: key, start, end (inclusive), size. Ranges made contiguous from 0 to size - 1 in order of start: what earlier ones hold is dropped, the last is lengthened."""
    sound = ranges.filter((F.col("start") >= 0) & (F.col("start") <= F.col("end"))).withColumn("end", F.least("end", F.col(size) - 1))
    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    kept = sound.withColumn("reach", reach).filter("end > reach")
    last = F.lead("start").over(by).isNull()
    return kept.select(key, (F.col("reach") + 1).alias("start"), F.when(last, F.col(size) - 1).otherwise(F.col("end")).alias("end"))


def range_errors(ranges: DataFrame, key: str, size: str) -> DataFrame:
    """The first fault of each key's ranges in their given order (place): gap, bad (empty or beyond size) or short; keys without fault are left out."""
    by = Window.partitionBy(key).orderBy("place")
    expected = F.coalesce(F.lag("end").over(by) + 1, F.lit(0))
    last = F.lead("place").over(by).isNull()
    fault = F.when(F.col("start") != expected, "gap").when((F.col("end") < F.col("start")) | (F.col("end") >= F.col(size)), "bad").when(last & (F.col("end") + 1 != F.col(size)), "short")
    return ranges.withColumn("fault", fault).filter("fault IS NOT NULL").groupBy(key).agg(F.min_by("fault", "place").alias("fault"), F.min("place").alias("place"))


def chapter_ends(starts: DataFrame, key: str, last: str) -> DataFrame:
    """A chapter ends on the page before the next one's start, the last one on the book's last page; never before it starts."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return starts.withColumn("end", F.greatest(F.col("start"), F.coalesce(following - 1, F.col(last)))).drop(last)


def without_repeats(rows: DataFrame, key: str, place: str, name: Column) -> DataFrame:
    """Rows whose name differs from the one before of their key."""
    by = Window.partitionBy(key).orderBy(place)
    named = rows.withColumn("name_", name)
    return named.withColumn("before_", F.lag("name_").over(by)).filter(~F.col("name_").eqNullSafe(F.col("before_"))).drop("name_", "before_")


def batches(rows: DataFrame, key: str, place: str, size: int) -> DataFrame:
    """rows with their number from 1 in the key and the batch of so many rows that they fall into."""
    return numbered_within(rows, key, place).withColumn("batch", F.floor((F.col("number") - 1) / size).cast("int"))


def lessons(paras: DataFrame, key: str, target: int, most: int) -> DataFrame:
    """paras: key, place, words. Consecutive paragraphs in lessons: one ends when it has `target` words, or when the next would pass `most`.

    A key's paragraphs are folded as one array, which holds two numbers each; texts do not move.
    """
    def step(acc: Column, x: Column) -> Column:
        full = (acc["words"] >= target) | ((acc["words"] > 0) & (acc["words"] + x["words"] > most))
        number = acc["number"] + full.cast("int")
        words = F.when(full, x["words"]).otherwise(acc["words"] + x["words"])
        return F.struct(number.alias("number"), words.alias("words"), F.concat(acc["out"], F.array(number)).alias("out"))

    whole = paras.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("words").cast("long").alias("words")))).alias("p"))
    start = F.struct(F.lit(0).alias("number"), F.lit(0).cast("long").alias("words"), F.array().cast("array<int>").alias("out"))
    numbered = whole.withColumn("n", F.aggregate("p", start, step, lambda a: a["out"]))
    rows = numbered.select(key, F.explode(F.arrays_zip("p", "n")).alias("x")).select(key, "x.p.place", "x.p.words", F.col("x.n").alias("lesson"))
    return rows.groupBy(key, "lesson").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum("words").alias("words"))


def replaced_once(rows: DataFrame, text: str, find: str, new: str) -> DataFrame:
    """rows with the edit done where the sought text stands exactly once, and what became of it: done, missing or ambiguous."""
    n = T.occurrences(F.col(text), F.col(find))
    status = F.when(n == 1, "done").when(n > 1, "ambiguous").otherwise("missing")
    return rows.withColumn("status", status).withColumn(text, F.when(n == 1, F.replace(F.col(text), F.col(find), F.col(new))).otherwise(F.col(text)))


def unsupported(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """claims and sources: key, value, unit. Claims whose value the sources of their key don't hold, or hold with other units only."""
    held = sources.groupBy(key, "value").agg(F.collect_set("unit").alias("units"))
    rows = claims.distinct().join(held, [key, "value"], "left")
    reason = F.when(F.col("units").isNull(), "value").when(~F.array_contains("units", F.col("unit")), "unit")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select(key, "value", "unit", "reason")


def figures(text: Column, units: str) -> Column:
    """(number, unit) of each number that a unit of the pattern follows."""
    found = F.regexp_extract_all(text, F.lit(rf"(\d+(?:[.,]\d+)*\s*(?:{units}))(?![a-z])"), 1)
    return F.transform(found, lambda x: F.struct(T.number_core(F.regexp_extract(x, r"^(\d+(?:[.,]\d+)*)", 1)).alias("value"), F.regexp_extract(x, r"([^\d\s.,]+)$", 1).alias("unit")))


def sample(rows: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """n rows by the smallest salted hash of their id: uniform, without replacement, the same at every run."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256)).limit(n)


def one_each(rows: DataFrame, group: str, id_: str, seed: int) -> DataFrame:
    """One row of each group, drawn by the smallest salted hash of the id; an aggregate."""
    return rows.groupBy(group).agg(F.min_by(id_, F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256)).alias(id_))


def votes(rows: DataFrame, key: str, choice: str) -> DataFrame:
    """The most voted choice of each key, ties by the least, and its votes; counted before the second step."""
    counted = rows.groupBy(key, choice).agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("n"), choice)).alias("x")
    return counted.groupBy(key).agg(best).select(key, f"x.{choice}", (-F.col("x.n")).alias("votes"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
