"""Operators on literal rows: nulls, ties, bounds and half-even rounding."""

import datetime as dt

from pyspark.sql import functions as F

from caudal.operators import commerce, learning, relational
from caudal.sources.tables import moment

DAY = lambda n: dt.datetime(2024, 1, n)
SALES = "id long, ts timestamp_ntz, amount double, buyer long, plan string"


def rows(spark, data, shape):
    return spark.createDataFrame(data, shape)


def test_kpis_of_no_rows_and_null_buyers(spark):
    none = commerce.kpis(rows(spark, [], SALES)).first()
    assert (none.revenue, none.sales, none.ticket, none.buyers) == (0.0, 0, 0, 0)
    some = commerce.kpis(rows(spark, [(1, DAY(1), 1.0, None, "a"), (2, DAY(1), 4.0, 7, "a")], SALES)).first()
    assert (some.revenue, some.ticket, some.buyers) == (5.0, 2, 1)


def test_variation_is_null_without_previous_revenue(spark):
    sales = rows(spark, [(1, DAY(9), 5.0, 1, "a")], SALES)
    assert commerce.variation(sales, moment("2024-01-01"), moment("2024-01-05"), moment("2024-01-10")).first().variation is None


def test_contract_state_at_its_bounds(spark):
    ends = rows(spark, [(DAY(1),)], "end timestamp_ntz")
    for now, state in (("2024-01-01", "active"), ("2024-01-08", "grace"), ("2024-02-07", "suspended"), ("2024-02-08", "ended")):
        assert ends.select(commerce.contract_state(F.col("end"), moment(now)).alias("s")).first().s == state


def test_merge_intervals_touching_and_apart(spark):
    found = relational.merge_intervals(rows(spark, [("a", 1, 3), ("a", 3, 5), ("a", 2, 4), ("a", 7, 8)], "k string, start int, end int"), "k")
    assert sorted((r.start, r.end, r.parts) for r in found.collect()) == [(1, 5, 3), (7, 8, 1)]


def test_asof_before_first_fact_is_null(spark):
    probes = rows(spark, [("a", 1, 10), ("a", 5, 11)], "k string, ts int, id int")
    facts = rows(spark, [("a", 3, 2.5), ("a", 5, 3.5)], "k string, ts int, price double")
    assert sorted((r.id, r.price) for r in relational.asof(probes, facts, "k", "price").collect()) == [(10, None), (11, 3.5)]


def test_duplicates_name_the_first(spark):
    found = relational.duplicates(rows(spark, [(3, "x"), (1, "x"), (2, "y"), (4, None)], "id int, t string"), F.col("t"), "id")
    assert [tuple(r) for r in found.collect()] == [(3, 1)]


def test_upsert_actions(spark):
    old, new = rows(spark, [(1, "a"), (2, "b"), (3, None)], "k int, v string"), rows(spark, [(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.action for r in relational.upsert_actions(old, new, "k", "v").collect()} == {1: "delete", 2: "update", 3: "keep", 4: "create"}


def test_streak_breaks_on_a_missing_day(spark):
    data = [(1, DAY(d)) for d in (1, 2, 3, 5, 6)]
    found = learning.streaks(rows(spark, data, "user int, ts timestamp_ntz"), F.lit("2024-01-07").cast("date")).first()
    assert (found.longest, found.current) == (3, 2)


def test_level_thresholds(spark):
    assert [spark.range(1).select(learning.level_of(F.lit(x)).alias("l")).first().l for x in (0, 99, 100, 299, 300)] == [0, 0, 1, 1, 2]
