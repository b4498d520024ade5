"""Exam attempts: filters, flat rows, scoring of answer sets, experience, eligibility and option order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .commerce import whole

# Pass marks in per cent and experience points.
PASS_FINAL, PASS_QUIZ, PASS = 80, 80, 70
XP_PRACTICE, XP_EVALUATION, XP_PASSED = 5, 10, 50
LETTERS = "abcdef"


def final_exam(prefix: str = "") -> Column:
    """The course's final exam: a whole exam, evaluated, of a course. Never null, so that its negation keeps rows with nulls."""
    c = lambda name: F.col(prefix + name)
    return F.coalesce((c("kind") == "completa") & (c("mode") == "evaluacion") & c("course").isNotNull(), F.lit(False))


def filtered(rows: DataFrame, since: Column | None = None, until: Column | None = None, school: int | None = None, course: int | None = None, student: int | None = None, scope: str = "all", delivered: bool = True, prefix: str = "") -> DataFrame:
    """rows that meet every condition that is given; days are inclusive; scope: all, final or practice."""
    asked = [
        (since, lambda c: c(f"{prefix}day") >= since),
        (until, lambda c: c(f"{prefix}day") <= until),
        (school, lambda c: c(f"{prefix}school") == school),
        (course, lambda c: c(f"{prefix}course") == course),
        (student, lambda c: c(f"{prefix}student") == student),
        (delivered or None, lambda c: c(f"{prefix}finished").isNotNull()),
        ({"final": True, "practice": False}.get(scope), lambda c: final_exam(prefix) == F.lit(scope == "final")),
    ]
    for value, condition in asked:
        if value is not None:
            rows = rows.filter(condition(F.col))
    return rows


def seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two points in time, cut towards zero; null if either is missing."""
    return F.timestamp_diff("SECOND", start, end)


def iso(point: Column, kind: str = "timestamp") -> Column:
    return F.date_format(point, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss")


def flat_attempts(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """One flat row an attempt, with its number of questions; items are reduced to one row an attempt before the join."""
    counts = items.groupBy("exam").agg(F.count("*").alias("questions"), F.count(F.when(F.col("correct"), 1)).alias("hits"))
    rows = attempts.join(counts, attempts.id == counts.exam, "left")
    n = F.coalesce("questions", F.lit(0))
    return rows.select(
        F.col("id").alias("exam"), "student", "name", "school", "course", "kind", "mode", final_exam().alias("is_final"),
        iso(F.col("day"), "date").alias("day"), iso(F.col("created")).alias("created"), iso(F.col("finished")).alias("finished"), seconds(F.col("created"), F.col("finished")).alias("seconds"),
        n.alias("questions"), F.coalesce("hits", F.lit(0)).alias("hits"), score(F.col("hits"), F.col("questions")).alias("score"), passed(F.col("hits"), F.col("questions")).alias("passed"),
    )


def flat_answers(attempts: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(attempts, items.exam == attempts.id).select("exam", "line", "student", "school", "course", "kind", "mode", final_exam().alias("is_final"), "exercise", "category", "answer", "correct", iso(F.col("finished")).alias("finished"))


def selection(text: Column) -> Column:
    """The set of option letters in a selection, whatever parts them, as a sorted array; other signs are left out."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,;/]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p.isin(*LETTERS))))


def correct_letters(listed: Column, answer: Column, options: Column) -> Column:
    """The listed letters if there are some, else the one answer as a letter, else the option that has the answer's text. options: map of letter to text."""
    by_letter = F.when(F.lower(F.trim(answer)).isin(*LETTERS), F.array(F.lower(F.trim(answer))))
    by_text = F.array_sort(F.map_keys(F.map_filter(options, lambda k, v: F.lower(F.trim(v)) == F.lower(F.trim(answer)))))
    one = F.coalesce(by_letter, F.slice(by_text, 1, 1))
    return F.coalesce(F.when(F.size(listed) > 0, F.array_sort(F.array_distinct(F.filter(F.transform(listed, lambda x: F.lower(F.trim(x))), lambda x: x.isin(*LETTERS))))), one, F.array().cast("array<string>"))


def options_map(*columns: str) -> Column:
    """Option columns a to f as a map without empty options."""
    pairs = F.map_from_arrays(F.array(*(F.lit(x) for x in LETTERS[: len(columns)])), F.array(*(F.col(c) for c in columns)))
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def score(hits: Column, total: Column) -> Column:
    """Per cent to two places, half even; null without questions."""
    return F.when(total > 0, F.bround(F.lit(100.0) * hits / total, 2))


def mark(final: Column, kind: Column) -> Column:
    return F.when(final, PASS_FINAL).when(kind == "quiz", PASS_QUIZ).otherwise(PASS)


def passed(hits: Column, total: Column) -> Column:
    whole_exam = (F.col("kind") == "completa") & F.coalesce(F.col("mode") == "evaluacion", F.lit(False))
    return score(hits, total) >= mark(whole_exam, F.col("kind"))


def scored(answers: DataFrame) -> DataFrame:
    """answers: exam, kind, mode, chosen and right (sorted letters). One row an exam: hits, total, score, mark, passed, experience."""
    out = answers.groupBy("exam", "kind", "mode").agg(F.count(F.when(F.col("chosen") == F.col("right"), 1)).alias("hits"), F.count("*").alias("total"))
    good = passed(F.col("hits"), F.col("total"))
    evaluated = F.coalesce(F.col("mode") == "evaluacion", F.lit(False))
    xp = F.when(evaluated, F.col("hits") * XP_EVALUATION + F.when(good, XP_PASSED).otherwise(0)).otherwise(F.col("hits") * XP_PRACTICE)
    return out.withColumns({"score": score(F.col("hits"), F.col("total")), "passed": good, "xp": xp})


def level_range(xp: Column) -> dict[str, Column]:
    """Level (50 n (n + 1) points make n, 1 at least), its first point, the next level's, and the whole per cent between."""
    n = F.greatest(F.lit(1), F.floor((F.sqrt(F.lit(1.0) + xp * 0.08) - 1) / 2)).cast("long")
    none = xp <= 0
    start, end = 50 * n * (n - 1), 50 * n * (n + 1)
    share = F.least(F.lit(100), F.greatest(F.lit(0), F.floor((xp - start) * 100 / (end - start)))).cast("long")
    return {"level": F.when(none, 1).otherwise(n), "from_xp": F.when(none, 0).otherwise(start), "to_xp": F.when(none, 100).otherwise(end), "share": F.when(none, 0).otherwise(share)}


def next_streak(current: Column, last: Column, frozen_until: Column, today: Column) -> Column:
    """The run of days after an activity today: kept on the same day, longer after yesterday or while frozen, else 1."""
    gap = F.datediff(today, last)
    return F.when(gap == 0, current).when((gap == 1) | ((gap > 1) & (frozen_until >= today)), current + 1).otherwise(1)


def eligibility(enrolments: DataFrame, lessons: DataFrame, seen: DataFrame, certificates: DataFrame, now: Column) -> DataFrame:
    """student, course and why the final exam may be taken or not, by the first rule that fits.

    enrolments: student, course, until; lessons: course, lesson; seen: student, course, lesson; certificates: student, course.
    """
    total = lessons.groupBy("course").agg(F.countDistinct("lesson").alias("lessons"))
    done = seen.groupBy("student", "course").agg(F.countDistinct("lesson").alias("done"))
    have = certificates.select("student", "course").distinct().withColumn("certified", F.lit(True))
    rows = enrolments.join(total, "course", "left").join(done, ["student", "course"], "left").join(have, ["student", "course"], "left")
    missing = F.coalesce("done", F.lit(0)) < F.coalesce("lessons", F.lit(0))
    reason = F.when(F.col("certified"), "completed").when(now > F.col("until"), "expired").when(missing, "lessons").otherwise("ok")
    return rows.select("student", "course", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("lessons", F.lit(0)).alias("lessons"), reason.alias("reason"))


def latest_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order, ties by the greatest id; an aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.filter(F.col(order).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "id")).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def shuffled(options: Column, seed: Column) -> Column:
    """Options in an order fixed by a SHA-256 of seed and option: everyone who has the seed sees the same."""
    keyed = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws("|", seed, o), 256).alias("k"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def completed_all(seen: DataFrame, lessons: DataFrame) -> DataFrame:
    """student, course where all lessons of the course were seen, by counts."""
    total = lessons.groupBy("course").agg(F.countDistinct("lesson").alias("lessons"))
    done = seen.groupBy("student", "course").agg(F.countDistinct("lesson").alias("done"))
    return done.join(total, "course").filter("done >= lessons").select("student", "course", "done")


def merged_mean(parts: DataFrame, key: str) -> DataFrame:
    """Mean of partial means (n, mean), weighted by their sizes."""
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"))


def inconsistent(keys: DataFrame) -> DataFrame:
    """question and number of different keys where one question is keyed in two ways."""
    return keys.groupBy("question").agg(F.countDistinct("key").alias("keys")).filter("keys > 1")


def rounded_share(part: Column, total: Column) -> Column:
    return whole(F.when(total > 0, F.lit(100.0) * part / total))


def exam_quotas(counts: DataFrame, n: int) -> DataFrame:
    """course, category, quota: how many of n questions each category gives, from counts (course, category, available).

    The level of water poured over the counts: a category gives all it has where that is less than its even share, and what it lacks is
    shared among the others; the rest that does not part evenly goes to the first of those in the order of a hash. The quotas of a
    course add up to n, or to all it has. Only counts are looked at, one row a category.
    """
    turn = F.sha2(F.col("category").cast("string"), 256)
    rising = Window.partitionBy("course").orderBy("available", turn)
    whole_course = Window.partitionBy("course")
    ranked = counts.withColumns({"before": F.sum("available").over(rising.rowsBetween(Window.unboundedPreceding, -1)), "place": F.row_number().over(rising), "categories": F.count("*").over(whole_course)})
    left, sharers = F.lit(n) - F.coalesce("before", F.lit(0)), F.col("categories") - F.col("place") + 1
    even = F.greatest(F.lit(0), F.floor(left / sharers))
    levelled = ranked.withColumns({"short": F.col("available") <= even, "level": F.when(F.col("available") > even, even), "rest": F.when(F.col("available") > even, left - even * sharers)})
    # The first category that is not short sets level and rest for all that follow.
    first = levelled.withColumns({c: F.min_by(c, F.when(~F.col("short"), F.col("place"))).over(whole_course) for c in ("level", "rest")})
    order = F.row_number().over(Window.partitionBy("course", "short").orderBy(turn))
    given = F.when(F.col("short"), F.col("available")).otherwise(F.col("level") + F.when(order <= F.col("rest"), 1).otherwise(0))
    return first.withColumn("quota", given.cast("int")).filter("quota > 0").select("course", "category", "quota")


def exam_sample(questions: DataFrame, n: int) -> DataFrame:
    """course, id, category, place: n questions of each course (all where it has fewer), balanced over its categories, in an order fixed by hashes.

    questions: course, category, id. Each task keeps n questions a category before anything moves.
    """
    counts = questions.groupBy("course", "category").agg(F.count("*").alias("available"))
    by = Window.partitionBy("course", "category").orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    best = questions.select("course", "category", "id").withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= n)
    quotas = exam_quotas(counts, n).select(F.col("course").alias("_course"), F.col("category").alias("_category"), "quota")
    chosen = best.join(quotas, F.col("course").eqNullSafe(F.col("_course")) & F.col("category").eqNullSafe(F.col("_category"))).filter("turn <= quota")
    place = F.row_number().over(Window.partitionBy("course").orderBy("turn", F.sha2(F.col("category").cast("string"), 256)))
    return chosen.withColumn("place", place).select("course", "id", "category", "place")
