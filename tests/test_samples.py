"""Exam samples, rectangles, numbers within keys and first copies against plain loops."""

import random

from pyspark.sql import functions as F

from caudal.operators import exams, rectangles, relational, storage, structure


def slow_union(boxes, gap):
    out = list(boxes)
    while True:
        pair = next(((i, j) for i in range(len(out)) for j in range(i + 1, len(out)) if out[i][0] - gap < out[j][2] and out[j][0] < out[i][2] + gap and out[i][1] - gap < out[j][3] and out[j][1] < out[i][3] + gap), None)
        if pair is None:
            return sorted(out)
        a, b = out[pair[0]], out.pop(pair[1])
        out[pair[0]] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def test_rectangles_by_the_quadratic_loop(spark):
    rng, rows, expected = random.Random(5), [], set()
    for page in range(150):
        boxes = []
        for _ in range(rng.randint(1, 40)):
            x, y = rng.randint(0, 120), rng.randint(0, 120)
            boxes.append((float(x), float(y), float(x + rng.randint(0, 12)), float(y + rng.randint(0, 12))))
        rows += [(page, *b) for b in boxes]
        expected |= {(page, *b) for b in slow_union(boxes, 3.0)}
    rows += [(None, 0.0, 0.0, 1.0, 1.0), (None, 1.0, 1.0, 2.0, 2.0), (7, None, 0.0, 1.0, 1.0)]
    expected.add((None, 0.0, 0.0, 2.0, 2.0))
    found = rectangles.merged(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double"), "page", 3.0).collect()
    assert {(r.page, r.x0, r.y0, r.x1, r.y1) for r in found} == expected and len(found) == len(expected)


def test_many_boxes_on_one_page_are_swept_quickly():
    boxes = [(float(20 * (i % 200)), float(20 * (i // 200)), float(20 * (i % 200) + 5), float(20 * (i // 200) + 5)) for i in range(40_000)]
    assert len(rectangles.united(boxes)) == 40_000 and len(rectangles.united(boxes, 16.0)) == 1


def test_exam_quotas_are_those_of_taking_turns(spark):
    import hashlib

    rng = random.Random(9)
    counts = [(c, f"k{k}", rng.choice([1, 1, 2, 3, 8, 50])) for c in range(60) for k in range(rng.randint(1, 9))] + [(None, None, 4)]
    turn = lambda k: hashlib.sha256(k.encode()).hexdigest()
    frame = spark.createDataFrame(counts, "course int, category string, available int")
    for n in (1, 7, 20):
        expected = {}
        for c in range(60):
            left, taken = {k: a for d, k, a in counts if d == c}, {}
            while sum(taken.values()) < n and any(left.values()):
                for k in sorted(left, key=turn):
                    if left[k] and sum(taken.values()) < n:
                        left[k] -= 1
                        taken[k] = taken.get(k, 0) + 1
            expected |= {(c, k): q for k, q in taken.items()}
        expected[None, None] = min(4, n)
        assert {(r.course, r.category): r.quota for r in exams.exam_quotas(frame, n).collect()} == expected
    rows = spark.createDataFrame([(1, None, i) for i in range(5)] + [(1, "a", 9), (None, "b", 7)], "course int, category string, id int")
    assert sorted((r.course or 0, r.category or "", r.place) for r in exams.exam_sample(rows, 4).collect()) == [(0, "b", 1), (1, "", 1), (1, "", 3), (1, "", 4), (1, "a", 2)]
    assert exams.exam_sample(rows.limit(0), 4).collect() == []


def test_numbers_within_a_key_of_most_rows_take_several_tasks(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id"))).alias("key"), F.col("id").alias("place"))
    found = storage.numbered_within(rows, "key", "place").collect()
    expected, seen = {}, {}
    for r in rows.orderBy("place").collect():
        seen[r.key] = seen.get(r.key, 0) + 1
        expected[r.key, r.place] = seen[r.key]
    assert {(r.key, r.place): r.number for r in found} == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables, write = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: tables.append(write(df, name)) or tables[-1])
    storage.numbered(rows, ["key", "place"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tables[0].filter("key = 'hot'").select(F.input_file_name()).distinct().count() > 3  # each task writes a file of its own
    assert {r.batch for r in structure.batches(rows, "key", "place", 100).filter("key = 'hot'").collect()} == set(range(20))


def test_first_copies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None), (6, None), (7, "c")], "id int, text string")
    assert sorted(map(tuple, relational.duplicates(rows, F.col("text"), "id").collect())) == [(3, 1), (4, 1)]
