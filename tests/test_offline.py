"""Licences, seats and matchers of imports on small rows with known results, and against brute force."""

import random

from pyspark.sql import functions as F

from caudal.operators import offline as L


def test_question_blocks_by_brute_force(spark):
    rng = random.Random(3)
    books = {k: [rng.random() < 0.3 for _ in range(rng.randint(1, 40))] for k in range(30)}
    expected = set()
    for k, opens in books.items():
        blocks, now = [], []
        for i, o in enumerate(opens):
            if len(now) >= 5 and o:
                blocks.append(now)
                now = []
            now.append(i)
        expected |= {(k, b[0], b[-1]) for b in [*blocks, now]}
    lines = spark.createDataFrame([(k, i, o) for k, opens in books.items() for i, o in enumerate(opens)], "book int, place int, opens boolean")
    assert {tuple(r) for r in L.question_blocks(lines.repartition(4), "book", 5).collect()} == expected
    assert L.question_blocks(lines.limit(0), "book", 5).count() == 0


def test_titles_and_cells(spark):
    pairs = [("Normas de circulación en la vía", "NORMAS DE CIRCULACION y otras"), ("el motor y el freno", "freno motor"), ("el motor", "motor"), (None, "a"), ("", "a"), ("?", "?")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in rows.select(L.titles_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False, False]
    cells = spark.createDataFrame([(" x ",), ("null",), ("—",), ("",), (None,)], "c string")
    assert [r[0] for r in cells.select(L.cell(F.col("c"))).collect()] == ["x", None, None, None, None]


def test_truncated_options(spark):
    kind = "id int, statement string, options map<string,string>"
    whole = "the driver must stop before the line"
    new = spark.createDataFrame([(1, "What now?", {"a": whole, "b": "no"}), (2, "And then?", {"a": whole, "b": "no"}), (3, "Same?", {"a": whole}), (4, None, None)], kind)
    old = spark.createDataFrame([(10, "what now", {"a": whole[:22], "b": "no", "c": " "}), (20, "And then?", {"a": whole[:22], "b": "no"}), (21, "And then?", {"a": whole[:25], "b": "no"}), (30, "Same?", {"a": whole}), (31, "Same?", {"a": whole[:9]}), (40, None, None)], kind)
    assert [tuple(r) for r in L.truncated_matches(new, old, "statement", "id").collect()] == [(1, 10)]
