"""Pairs of nodes meet with their values at one place: against brute force, and with one move of the whole sets."""

import random

import pytest

from caudal.llm import ngram_join as N


@pytest.mark.parametrize("block, most", [(2048, 500_000), (2, 0)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "MAX_BROADCAST", most)
    rng = random.Random(5)
    values = {n: bytes([rng.randrange(4)]) for n in range(-20, 20)}
    pairs = {tuple(sorted(rng.sample(sorted(values), 2))) for _ in range(150)} | {(-20, n) for n in range(-19, 20)}
    held = spark.createDataFrame([(n, bytearray(v)) for n, v in values.items()] * 2, "node long, value binary")
    found = N.compared(spark.createDataFrame(sorted(pairs), "x long, y long"), held, lambda a, b: a == b).collect()
    assert sorted((r.x, r.y) for r in found) == sorted(p for p in pairs if values[p[0]] == values[p[1]])


def test_whole_sets_move_once(spark, monkeypatch):
    """They moved to be told apart, to each end of their pairs, and once more with the other end's set."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    found = N.nodes(docs, *N.frequent_shingles(docs)).collect()
    node = {r.doc_id: r.node for r in found}
    pairs = spark.createDataFrame([tuple(sorted((node[1], node[d]))) for d in (2, 3)], N.PAIRS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = N.verified(docs, pairs, spark.createDataFrame([(n, d) for d, n in node.items()], "node long, rep long"))
        assert linked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert [(r.x, r.y) for r in linked.collect()] == [tuple(sorted((node[1], node[2])))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucket_parts_where_sizes_are_too_far_apart(spark):
    """Sets of 10, 12 and 20 shingles share one: it made a bucket of three; 10 and 12 may be linked, 20 with neither."""
    found = spark.createDataFrame([(1, 10, [7]), (2, 12, [7]), (3, 20, [7]), (4, 25, [8]), (5, 20, [8])], "node long, n_shingles long, prefix array<long>")
    assert sorted((r.node, r.size, r.lead) for r in N.buckets(found).collect()) == [(1, 2, 1), (2, 2, 1), (4, 2, 4), (5, 2, 4)]
