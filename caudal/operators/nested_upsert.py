"""Import of courses with units and lessons by natural key: what is created, changed, kept and pruned, level by level, and relinking of targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import numbered, written

PROTECTED_UNIT = 0  # Fixed value: the order of the unit that is kept by other means and never pruned


def level(incoming: DataFrame, stored: DataFrame, id_: str, keys: list[str], fields: list[str]) -> DataFrame:
    """One level: id_, keys, fields as they are after the import, and action: create, update, keep, or absent (stored rows that nothing came for).

    incoming has keys, fields and seq; of rows with equal keys the last by seq counts. stored has id_, keys and fields; of equal keys the
    smallest id is meant, the others are absent. New ids follow the greatest stored one in the order of the keys. Null keys are left out.
    What is stored and what it meets are written, so that neither side is worked out more than once.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    old = written(stored.select(id_, *keys, F.struct(*fields).alias("old")), f"stored_{id_}")
    came = incoming.filter(known).groupBy(*keys).agg(F.max_by(F.struct(*fields), "seq").alias("new"))
    meant = old.filter(known).groupBy(*keys).agg(F.min(id_).alias(id_))
    matched = written(came.join(meant, keys, "left"), f"matched_{id_}")
    fresh = matched.filter(F.col(id_).isNull()).drop(id_)
    top = old.agg(F.coalesce(F.max(id_), F.lit(0)).cast("long").alias("_top"))
    created = numbered(fresh, keys).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("number")).alias(id_), *keys, F.col("new").alias("row"), F.lit("create").alias("action"))
    there = old.join(matched.filter(F.col(id_).isNotNull()).select(id_, "new"), id_, "left")
    action = F.when(F.col("new").isNull(), "absent").when(F.col("new").eqNullSafe(F.col("old")), "keep").otherwise("update")
    rest = there.select(id_, *keys, F.coalesce("new", "old").alias("row"), action.alias("action"))
    return written(created.unionByName(rest).select(id_, *keys, "row.*", "action"), id_)


def pruned(rows: DataFrame, courses: DataFrame, safe: Column, prune: bool) -> DataFrame:
    """Absent rows of imported courses are to be deleted where prune asks for it and nothing keeps them safe; all other absent rows stay as they are."""
    touched = courses.filter("action <> 'absent'").select("course_id", F.lit(True).alias("_touched"))
    gone = (F.col("action") == "absent") & F.col("_touched").isNotNull() & ~F.coalesce(safe, F.lit(False)) & F.lit(prune)
    return rows.join(touched, "course_id", "left").withColumn("action", F.when(gone, "delete").otherwise(F.col("action"))).drop("_touched")


def import_courses(incoming: dict[str, DataFrame], stored: dict[str, DataFrame], prune: bool) -> dict[str, DataFrame]:
    """courses, units and lessons after the import, each with its action; each level hands the ids it assigned to the next.

    incoming: courses (code, name, seq), units (code, unit_order, unit_name, seq), lessons (code, unit_order, position, lesson_name, body,
    seq); stored: the same with course_id, unit_id and lesson_id in place of code and unit. A second import of the same rows keeps all.
    Lessons and units whose parent is not among what came are refused (import_actions tells them).
    """
    courses = level(incoming["courses"], stored["courses"], "course_id", ["code"], ["name"])
    ids = courses.filter("action <> 'absent'").select("code", "course_id")
    units = level(incoming["units"].join(ids, "code"), stored["units"], "unit_id", ["course_id", "unit_order"], ["unit_name"])
    came = units.filter("action <> 'absent'").select("course_id", "unit_order", "unit_id")
    lessons = level(incoming["lessons"].join(ids, "code").join(came, ["course_id", "unit_order"]), stored["lessons"], "lesson_id", ["course_id", "unit_id", "position", "lesson_name"], ["body"])
    shielded = units.filter(F.col("unit_order") == PROTECTED_UNIT).select("unit_id", F.lit(True).alias("_safe"))
    lessons = pruned(lessons.join(shielded, "unit_id", "left"), courses, F.col("_safe"), prune).drop("_safe")
    return {"courses": courses, "units": pruned(units, courses, F.col("unit_order") == PROTECTED_UNIT, prune), "lessons": lessons}


def import_actions(result: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> DataFrame:
    """level, id, action of every row that was touched, and the refused ones (id null) by their number."""
    rows = [result[name].filter("action <> 'absent'").select(F.lit(name).alias("level"), F.col(id_).cast("long").alias("id"), "action", F.lit(1).cast("long").alias("n")) for name, id_ in (("courses", "course_id"), ("units", "unit_id"), ("lessons", "lesson_id"))]
    ids = result["courses"].filter("action <> 'absent'").select("code", "course_id")
    known = {"units": ids.select("code"), "lessons": result["units"].filter("action not in ('absent', 'delete')").join(ids, "course_id").select("code", "unit_order")}
    for name, parents in known.items():
        refused = incoming[name].join(parents, parents.columns, "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
        rows.append(refused.select(F.lit(name).alias("level"), F.lit(None).cast("long").alias("id"), F.lit("refuse").alias("action"), "n"))
    return reduce(DataFrame.unionByName, rows)


def relinked(targets: DataFrame, lessons: DataFrame) -> DataFrame:
    """targets with the lesson they mean: the first one with their plan id, else the first with their key, unless that has another name.

    targets: target, plan_id, key, name; lessons: lesson, at (their order), plan_id, key, name, was_named (the name before a rename).
    A match by key holds where the target tells no name, or the lesson has it or had it; otherwise the problem is `renamed`, and
    `missing` where no lesson fits. The first lesson is an aggregate by id and by key, so hot keys combine before the shuffle.
    """
    first = lambda by: lessons.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min_by(F.struct("lesson", "name", "was_named"), "at").alias(f"by_{by}"))
    found = targets.join(first("plan_id"), "plan_id", "left").join(first("key"), "key", "left")
    keyed = F.col("by_key.lesson")
    same = F.col("name").isNull() | F.col("by_key.name").eqNullSafe(F.col("name")) | F.col("by_key.was_named").eqNullSafe(F.col("name"))
    by_id = F.col("by_plan_id").isNotNull()
    lesson = F.when(by_id, F.col("by_plan_id.lesson")).when(same, keyed)
    problem = F.when(by_id | (F.col("by_key").isNotNull() & same), None).when(F.col("by_key").isNotNull(), "renamed").otherwise("missing")
    return found.select("target", lesson.alias("lesson"), F.when(by_id, "id").when(lesson.isNotNull(), "key").alias("by"), problem.alias("problem"))
