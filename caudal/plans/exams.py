"""Queries on exams and learning, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exams
from ..sources.learning import attempts, items
from ..sources.tables import moment, read
from .registry import query

ATTEMPTS = (
    "a AS (SELECT o_orderkey AS id, o_custkey AS student, trim(coalesce(c_name, '')) AS name, c_nationkey AS school, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 END AS course, "
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'completa' WHEN o_orderpriority = '3-MEDIUM' THEN 'quiz' ELSE 'parcial' END AS kind, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'evaluacion' ELSE 'practica' END AS mode, o_orderdate::DATE AS day, o_orderdate AS created, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey % 7200) END AS finished FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
)
ITEMS = "i AS (SELECT l_orderkey AS exam, l_linenumber AS line, l_partkey AS exercise, l_partkey % 8 AS category, CASE WHEN l_returnflag <> 'R' THEN substring('abcdef', (l_suppkey % 6 + 1)::INT, 1) END AS answer, l_linestatus = 'F' AS correct FROM lineitem)"
FINAL = "coalesce(kind = 'completa' AND mode = 'evaluacion' AND course IS NOT NULL, false)"
STAMP = "'%Y-%m-%dT%H:%M:%S'"
MARK = "CASE WHEN kind = 'completa' AND coalesce(mode = 'evaluacion', false) THEN 80 WHEN kind = 'quiz' THEN 80 ELSE 70 END"
FLAT = (
    f"{ATTEMPTS}, {ITEMS}, n AS (SELECT exam, count(*) AS questions, count(*) FILTER (correct) AS hits FROM i GROUP BY 1), "
    f"f AS (SELECT id AS exam, student, name, school, course, kind, mode, {FINAL} AS is_final, strftime(day, '%Y-%m-%d') AS day, strftime(created, {STAMP}) AS created, strftime(finished, {STAMP}) AS finished, "
    f"date_sub('second', created, finished) AS seconds, coalesce(questions, 0) AS questions, coalesce(hits, 0) AS hits, round_even(100.0::DOUBLE * hits / questions, 2) AS score, round_even(100.0::DOUBLE * hits / questions, 2) >= {MARK} AS passed FROM a LEFT JOIN n ON a.id = n.exam "
)


@query(f"WITH {FLAT} WHERE finished IS NOT NULL AND day BETWEEN DATE '2000-01-01' AND DATE '2000-06-30') SELECT * FROM f")
def exam_rows(spark, sf):
    return exams.flat_attempts(exams.filtered(attempts(spark, sf), F.lit("2000-01-01").cast("date"), F.lit("2000-06-30").cast("date")), items(spark, sf))


@query(f"WITH {FLAT} WHERE finished IS NOT NULL AND {FINAL} AND school = 3) SELECT * FROM f")
def exam_rows_final(spark, sf):
    return exams.flat_attempts(exams.filtered(attempts(spark, sf), school=3, scope="final"), items(spark, sf))


@query(f"WITH {FLAT} WHERE NOT {FINAL} AND course = 2) SELECT * FROM f")
def exam_rows_practice(spark, sf):
    return exams.flat_attempts(exams.filtered(attempts(spark, sf), course=2, scope="practice", delivered=False), items(spark, sf))


@query(f"WITH {ATTEMPTS}, {ITEMS} SELECT exam, line, student, school, course, kind, mode, {FINAL} AS is_final, exercise, category, answer, correct, strftime(finished, {STAMP}) AS finished FROM i JOIN a ON i.exam = a.id WHERE finished IS NOT NULL AND day >= DATE '2001-01-01'")
def answer_rows(spark, sf):
    return exams.flat_answers(exams.filtered(attempts(spark, sf), F.lit("2001-01-01").cast("date")), items(spark, sf))


RIGHT = "CASE WHEN l_partkey % 10 = 0 THEN list_sort(list_distinct(['a', substring('abcdef', (l_partkey % 6 + 1)::INT, 1)])) ELSE [substring('abcdef', (l_partkey % 6 + 1)::INT, 1)] END"
CHOSEN = "CASE l_linenumber % 4 WHEN 0 THEN upper(x) WHEN 1 THEN x || ', a' WHEN 2 THEN '  ' || x || ' / z' ELSE x || ';' || x END"


@query(
    f"WITH {ATTEMPTS}, q AS (SELECT l_orderkey AS exam, l_linenumber, {RIGHT} AS r, substring('abcdef', ((l_partkey + (l_suppkey % 2)) % 6 + 1)::INT, 1) AS x FROM lineitem), w AS (SELECT exam, r, {CHOSEN} AS said FROM q), "
    "s AS (SELECT exam, r, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(said), '[\\s,;/]+'), lambda p: p IN ('a','b','c','d','e','f')))) AS c FROM w), "
    f"t AS (SELECT exam, kind, mode, count(*) FILTER (c = r) AS hits, count(*) AS total FROM s JOIN a ON s.exam = a.id GROUP BY ALL), u AS (SELECT *, round_even(100.0::DOUBLE * hits / total, 2) AS score FROM t) "
    f"SELECT *, score >= {MARK} AS passed, (CASE WHEN coalesce(mode = 'evaluacion', false) THEN hits * 10 + CASE WHEN score >= {MARK} THEN 50 ELSE 0 END ELSE hits * 5 END)::BIGINT AS xp FROM u"
)
def answer_scoring(spark, sf):
    lines = read(spark, sf, "lineitem")
    letter = lambda n: F.expr(f"substring('abcdef', cast(({n}) % 6 AS int) + 1, 1)")
    listed = F.when(F.col("l_partkey") % 10 == 0, F.array(F.lit(" A "), letter("l_partkey"))).otherwise(F.array().cast("array<string>"))
    options = exams.options_map("oa", "ob", "oc", "od", "oe", "of")
    x, turn = letter("l_partkey + l_suppkey % 2"), F.col("l_linenumber") % 4
    said = F.when(turn == 0, F.upper(x)).when(turn == 1, F.concat(x, F.lit(", a"))).when(turn == 2, F.concat(F.lit("  "), x, F.lit(" / z"))).otherwise(F.concat_ws(";", x, x))
    lines = lines.withColumns({f"o{c}": F.lit(f"Option {c}") for c in exams.LETTERS})
    # the key is the letter, or for odd exercises the option's text
    answer = F.when(F.col("l_partkey") % 2 == 0, letter("l_partkey")).otherwise(F.concat(F.lit("option "), letter("l_partkey")))
    rows = lines.select(F.col("l_orderkey").alias("exam"), exams.correct_letters(listed, answer, options).alias("right"), exams.selection(said).alias("chosen"))
    return exams.scored(rows.join(attempts(spark, sf).select(F.col("id").alias("exam"), "kind", "mode"), "exam"))


@query(f"WITH {ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY student, course ORDER BY finished DESC, id DESC) AS n FROM a WHERE finished IS NOT NULL AND {FINAL}) SELECT student, course, id, finished FROM r WHERE n = 1")
def latest_final_exam(spark, sf):
    return exams.latest_of(exams.filtered(attempts(spark, sf), scope="final").select("student", "course", "id", "finished"), ["student", "course"], "finished")


@query("SELECT user_id AS \"user\", xp, CASE WHEN xp <= 0 THEN 1 ELSE n END AS level, CASE WHEN xp <= 0 THEN 0 ELSE 50 * n * (n - 1) END AS from_xp, CASE WHEN xp <= 0 THEN 100 ELSE 50 * n * (n + 1) END AS to_xp, CASE WHEN xp <= 0 THEN 0 ELSE least(100, greatest(0, (xp - 50 * n * (n - 1)) * 100 // (100 * n))) END AS share FROM (SELECT user_id, xp, greatest(1, (SELECT max(k) FROM range(0, 1000) t(k) WHERE 50 * k * (k + 1) <= xp))::BIGINT AS n FROM (SELECT user_id, (count(*) FILTER (event_type <> 'error') * 7)::BIGINT AS xp FROM events GROUP BY 1))")
def level_ranges(spark, sf):
    xp = read(spark, sf, "events").groupBy(F.col("user_id").alias("user")).agg((F.count(F.when(F.col("event_type") != "error", 1)) * 7).alias("xp"))
    return xp.withColumns(exams.level_range(F.col("xp")))


@query("WITH u AS (SELECT user_id AS \"user\", max(ts)::DATE AS last, count(*) % 9 AS current, CASE WHEN user_id % 3 = 0 THEN DATE '2024-02-05' END AS frozen FROM events GROUP BY 1) SELECT *, CASE WHEN last = DATE '2024-01-31' THEN current WHEN DATE '2024-01-31' - last = 1 OR (DATE '2024-01-31' - last > 1 AND coalesce(frozen >= DATE '2024-01-31', false)) THEN current + 1 ELSE 1 END AS following FROM u")
def streak_transition(spark, sf):
    today = F.lit("2024-01-31").cast("date")
    rows = read(spark, sf, "events").groupBy(F.col("user_id").alias("user")).agg(F.max("ts").cast("date").alias("last"), (F.count("*") % 9).alias("current"))
    rows = rows.withColumn("frozen", F.when(F.col("user") % 3 == 0, F.lit("2024-02-05").cast("date")))
    return rows.withColumn("following", exams.next_streak(F.col("current"), F.col("last"), F.col("frozen"), today))


SEEN = "e AS (SELECT o_custkey AS student, o_orderkey % 5 AS course, max(o_orderdate) + INTERVAL 90 DAY AS until FROM orders GROUP BY 1, 2), s AS (SELECT DISTINCT o_custkey AS student, o_orderkey % 5 AS course, l_partkey % 6 AS lesson FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 6 < 4 OR l_returnflag = 'R'), c AS (SELECT DISTINCT o_custkey AS student, o_orderkey % 5 AS course FROM orders WHERE o_totalprice > 400000)"


def _seen(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student"), (F.col("o_orderkey") % 5).alias("course"), "o_orderdate", "o_totalprice")
    lines = read(spark, sf, "lineitem").filter("l_partkey % 6 < 4 OR l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 6).alias("lesson"))
    lessons = spark.range(5).select(F.col("id").alias("course")).withColumn("lesson", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return orders, orders.join(lines, "id").select("student", "course", "lesson"), lessons


@query(f"WITH {SEEN}, d AS (SELECT student, course, count(*) AS done FROM s GROUP BY 1, 2) SELECT e.student, e.course, coalesce(done, 0) AS done, 6::BIGINT AS lessons, CASE WHEN c.student IS NOT NULL THEN 'completed' WHEN TIMESTAMP '2001-08-01' > until THEN 'expired' WHEN coalesce(done, 0) < 6 THEN 'lessons' ELSE 'ok' END AS reason FROM e LEFT JOIN d ON e.student = d.student AND e.course = d.course LEFT JOIN c ON e.student = c.student AND e.course = c.course")
def exam_eligibility(spark, sf):
    orders, seen, lessons = _seen(spark, sf)
    enrolled = orders.groupBy("student", "course").agg((F.max("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("until"))
    return exams.eligibility(enrolled, lessons, seen, orders.filter("o_totalprice > 400000"), moment("2001-08-01"))


@query(f"WITH {SEEN} SELECT student, course, count(*) AS done FROM s GROUP BY 1, 2 HAVING count(*) >= 6")
def completed_courses(spark, sf):
    _, seen, lessons = _seen(spark, sf)
    return exams.completed_all(seen, lessons)


@query(f"WITH {SEEN}, x AS (SELECT * FROM e WHERE until < TIMESTAMP '2001-08-01' AND until >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY) SELECT student, course, until, date_sub('day', until, TIMESTAMP '2001-08-01') AS days FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.student = x.student AND c.course = x.course)")
def rule_expired(spark, sf):
    orders, _, _ = _seen(spark, sf)
    now = moment("2001-08-01")
    ended = orders.groupBy("student", "course").agg((F.max("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("until")).filter((F.col("until") < now) & (F.col("until") >= now - F.make_dt_interval(F.lit(60))))
    days = F.timestamp_diff("DAY", F.col("until"), now)
    return ended.join(orders.filter("o_totalprice > 400000"), ["student", "course"], "left_anti").select("student", "course", "until", days.alias("days"))


@query("WITH p AS (SELECT o_custkey AS student, o_orderkey % 4 AS part, count(*) AS n, avg(o_orderkey % 100) AS mean FROM orders GROUP BY 1, 2) SELECT student, sum(n)::BIGINT AS n, round(sum(mean * n) / sum(n), 6) AS mean FROM p GROUP BY 1")
def merged_means(spark, sf):
    parts = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("student"), (F.col("o_orderkey") % 4).alias("part")).agg(F.count("*").alias("n"), F.avg(F.col("o_orderkey") % 100).alias("mean"))
    return exams.merged_mean(parts, "student")


@query("SELECT l_partkey AS question, count(DISTINCT l_returnflag) AS keys FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def inconsistent_keys(spark, sf):
    return exams.inconsistent(read(spark, sf, "lineitem").select(F.col("l_partkey").alias("question"), F.col("l_returnflag").alias("key")))


@query("SELECT p_partkey AS question, list_transform(list_sort(list_transform([p_name, p_brand, p_type, p_size::VARCHAR], lambda o: {'k': sha256(p_partkey::VARCHAR || '|' || o), 'o': o})), lambda x: x.o) AS options FROM part")
def option_shuffle(spark, sf):
    options = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("question"), exams.shuffled(options, F.col("p_partkey").cast("string")).alias("options"))


@query("SELECT o_custkey AS student, list_sort(list_distinct(list(o_orderpriority))) AS kinds, count(*) AS attempts, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def attempts_by_student(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("student")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"), F.count("*").alias("attempts"), F.max("o_orderdate").alias("last_at"))
