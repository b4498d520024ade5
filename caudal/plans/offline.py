"""Queries on offline licences, seats and imported questions, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import offline as L
from ..operators.selling import days
from ..sources.tables import moment, read
from .catalogue import NOW
from .registry import query

MIDNIGHT = f"TIMESTAMP '{NOW}'"


@query(f"SELECT o_custkey AS user, o_orderkey % 3 AS course, count(*) FILTER (o_orderstatus <> 'P' AND o_orderdate >= {MIDNIGHT} - INTERVAL 30 DAY) AS used, count(*) FILTER (o_orderstatus <> 'P' AND o_orderdate >= {MIDNIGHT} - INTERVAL 30 DAY) < 2 AS free FROM orders GROUP BY 1, 2")
def device_slots(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("user"), (F.col("o_orderkey") % 3).alias("course"), (F.col("o_orderstatus") == "P").alias("revoked"), F.col("o_orderdate").alias("renewed"))
    return L.device_slots(rows, ["user", "course"], moment(NOW))


@query(
    f"WITH l AS (SELECT o_orderkey AS licence, o_custkey AS user, o_orderkey % 2 AS device, o_orderkey % 3 AS course, o_orderstatus = 'P' AS revoked FROM orders), r AS (SELECT licence + CASE WHEN licence % 11 = 0 THEN 1000000000 ELSE 0 END AS licence, user, CASE WHEN licence % 13 = 0 THEN 5 ELSE device END AS device FROM l), a AS (SELECT c_custkey AS user, c_custkey % 3 AS course, CASE WHEN c_nationkey > 5 THEN {MIDNIGHT} + to_days(c_nationkey - 6) END AS until FROM customer WHERE c_acctbal > 0) "
    f"SELECT r.licence, r.user, r.device, CASE WHEN l.licence IS NULL THEN 'unknown' WHEN revoked THEN 'revoked' WHEN a.user IS NULL THEN 'no_access' ELSE 'valid' END AS state, CASE WHEN l.licence IS NOT NULL AND NOT revoked AND a.user IS NOT NULL THEN least(a.until, {MIDNIGHT} + INTERVAL 7 DAY) END AS offline_until FROM r LEFT JOIN l ON l.licence = r.licence AND l.user = r.user AND l.device = r.device LEFT JOIN a ON a.user = l.user AND a.course = l.course"
)
def licence_renewals(spark, sf):
    key = F.col("o_orderkey")
    held = read(spark, sf, "orders").select(key.alias("licence"), F.col("o_custkey").alias("user"), (key % 2).alias("device"), (key % 3).alias("course"), (F.col("o_orderstatus") == "P").alias("revoked"))
    asked = held.select((F.col("licence") + F.when(F.col("licence") % 11 == 0, 1000000000).otherwise(0)).alias("licence"), "user", F.when(F.col("licence") % 13 == 0, 5).otherwise(F.col("device")).alias("device"))
    until = F.when(F.col("c_nationkey") > 5, moment(NOW) + F.expr("make_dt_interval(c_nationkey - 6)"))
    access = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user"), (F.col("c_custkey") % 3).alias("course"), until.alias("until"))
    return L.renewals(asked, held, access, moment(NOW))


@query(f"WITH s AS (SELECT s_nationkey AS school, max(l_shipdate) - INTERVAL 60 DAY AS z FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 3 = 0 AND l_shipdate < {MIDNIGHT} + to_days(l_suppkey::INT) GROUP BY 1) SELECT c_custkey AS student, school_ AS school, coalesce(was IS NULL AND z + INTERVAL 7 DAY < {MIDNIGHT}, false) AS changed, CASE WHEN was IS NULL AND z + INTERVAL 7 DAY < {MIDNIGHT} THEN {MIDNIGHT} ELSE was END AS released FROM (SELECT c_custkey, c_nationkey AS school_, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2000-01-01' END AS was FROM customer) LEFT JOIN s ON school = school_")
def released_seats(spark, sf):
    seats = read(spark, sf, "customer").select(F.col("c_custkey").alias("student"), F.col("c_nationkey").alias("school"), F.when(F.col("c_custkey") % 4 == 0, moment("2000-01-01")).alias("released"))
    lines = read(spark, sf, "lineitem").filter((F.col("l_suppkey") % 3 == 0) & (F.col("l_shipdate") < moment(NOW) + F.expr("make_dt_interval(cast(l_suppkey AS int))")))
    ends = lines.join(read(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("school"), (F.col("l_shipdate") - days(60)).alias("end"))
    return L.released_seats(seats, ends, moment(NOW))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 > 0 THEN floor(a + (coalesce(nullif(z, 0), a) - a) * w / greatest(1, w + v) + 0.5)::BIGINT END AS page FROM (SELECT o_orderkey, o_orderkey % 6 AS a, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 6 + o_orderkey % 9 END AS z, o_custkey % 40 AS w, o_orderkey % 30 AS v FROM orders)")
def lesson_cuts(spark, sf):
    key = F.col("o_orderkey")
    end = F.when(key % 5 == 0, 0).otherwise(key % 6 + key % 9)
    return read(spark, sf, "orders").select(key.alias("id"), L.page_cut(key % 6, end, F.col("o_custkey") % 40, key % 30).alias("page"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 3 THEN trim(p_name) END AS name FROM part")
def clean_cells(spark, sf):
    key = F.col("p_partkey") % 7
    given = F.when(key == 0, "  n/a ").when(key == 1, "").when(key == 2, " - ").when(key == 3, None).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), L.cell(given).alias("name"))


@query()
def question_blocks(spark, sf):
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), place.alias("place"), (F.col("l_orderkey") % 4 == 0).alias("opens"))
    return L.question_blocks(lines, "book", 70)


@query()
def truncated_questions(spark, sf):
    part = read(spark, sf, "part")
    new = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("statement"), F.create_map(F.lit("a"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name"), F.lit("b"), F.col("p_brand")).alias("options"))
    cut = F.transform_values("options", lambda k, v: F.when((F.col("id") % 3 == 0) & (k == "a"), F.substring(v, 1, 24)).otherwise(v))
    return L.truncated_matches(new, new.withColumn("options", cut), "statement", "id")
