"""Empty tables, nulls and ties for child counts, steps, gaps and packs."""

from caudal.operators import commerce, relational


def test_packs(spark):
    needs = spark.createDataFrame([(0,), (1,), (6,), (None,)], "need long")
    found = {r.need: (r.cost, r.units) for r in commerce.cheapest_packs(needs, "need", {1: 30, 5: 130}).collect()}
    assert found == {0: (None, None), 1: (30, 1), 6: (160, 6), None: (None, None)}
    assert commerce.cheapest_packs(needs.limit(0), "need", {1: 30}).count() == 0
    assert {r.need: r.cost for r in commerce.cheapest_packs(needs, "need", {1: 30}, most=5).collect()} == {0: None, 1: 30, 6: None, None: None}
    # least cost, then fewest purchases, then fewest units
    ties = {r.need: (r.cost, r.purchases, r.units) for r in commerce.cheapest_packs(needs.filter("need = 6"), "need", {1: 10, 2: 20, 7: 60, 8: 60}).collect()}
    assert ties == {6: (60, 1, 7)}


def test_steps_and_gaps(spark):
    facts = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 1, None)], "k string, at int, v int")
    assert sorted((r.k, r["at"]) for r in relational.steps(facts, "k", "at", "v").collect()) == [("a", 1), ("a", 3)]
    assert {r.k: r.gapless for r in relational.gapless(facts, "k", "at").collect()} == {"a": True, "b": True}
    assert relational.gapless(facts.limit(0), "k", "at").count() == 0


def test_childless_keeps_null_keys(spark):
    parents, children = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {r.k for r in relational.childless(parents, children, "k").collect()} == {2, None}
