"""Nested imports: idempotence, plain replay on random courses, pruning, and relinking."""

import random

from caudal.operators import nested_upsert as N

INCOMING = {"courses": "code string, name string, seq int", "units": "code string, unit_order int, unit_name string, seq int", "lessons": "code string, unit_order int, position int, lesson_name string, body string, seq int"}
STORED = {"courses": "course_id long, code string, name string", "units": "unit_id long, course_id long, unit_order int, unit_name string", "lessons": "lesson_id long, course_id long, unit_id long, position int, lesson_name string, body string"}


def random_import(rng):
    courses = [(rng.choice("ABCD"), rng.choice("xy"), i) for i in range(rng.randint(0, 4))]
    units = [(rng.choice("ABCDE"), rng.randint(0, 3), rng.choice("uv"), i) for i in range(rng.randint(0, 10))]
    lessons = [(rng.choice("ABCDE"), rng.randint(0, 4), rng.randint(1, 2), rng.choice("lm"), rng.choice("pq"), i) for i in range(rng.randint(0, 25))]
    return {"courses": courses, "units": units, "lessons": lessons}


def plain(state, came, prune):
    """The import row by row on dicts of natural keys; ids are left out."""
    courses, units, lessons = (dict(x) for x in state)
    log, refused = {}, 0
    new = {c[0]: c[1] for c in came["courses"]}

    def put(table, key, value, level):
        log[level, key] = "create" if key not in table else "keep" if table[key] == value else "update"
        table[key] = value

    for code, name in new.items():
        put(courses, code, name, "courses")
    mine = {(c, o): n for c, o, n, _ in came["units"] if c in new}
    refused += sum(u[0] not in new for u in came["units"])
    for key, name in mine.items():
        put(units, key, name, "units")
    kept = {(c, o, p, n): b for c, o, p, n, b, _ in came["lessons"] if (c, o) in mine}
    refused += sum((x[0], x[1]) not in mine for x in came["lessons"])
    for key, body in kept.items():
        put(lessons, key, body, "lessons")
    if prune:
        for key in [k for k in lessons if k[0] in new and k not in kept and k[1] != 0]:
            del lessons[key]
            log["lessons", key] = "delete"
        for key in [k for k in units if k[0] in new and k not in mine and k[1] != 0]:
            del units[key]
            log["units", key] = "delete"
    return (courses, units, lessons), log, refused


def test_imports_in_a_row_against_plain_dicts(spark):
    rng, state, stored = random.Random(4), ({}, {}, {}), {k: spark.createDataFrame([], s) for k, s in STORED.items()}
    for turn in range(5):
        came, prune = random_import(rng), turn % 2 == 1
        frames = {k: spark.createDataFrame(came[k], s) for k, s in INCOMING.items()}
        state, log, refused = plain(state, came, prune)
        result = N.import_courses(frames, stored, prune)
        rows = {k: v.collect() for k, v in result.items()}
        code = {r.course_id: r.code for r in rows["courses"]}
        order = {r.unit_id: (code[r.course_id], r.unit_order) for r in rows["units"]}
        found = {("courses", r.code): r.action for r in rows["courses"]} | {("units", order[r.unit_id]): r.action for r in rows["units"]}
        found |= {("lessons", (*order[r.unit_id], r.position, r.lesson_name)): r.action for r in rows["lessons"]}
        assert {k: v for k, v in found.items() if v != "absent"} == log
        assert sum(r.n for r in N.import_actions(result, frames).collect() if r.action == "refuse") == refused
        live = {k: [r for r in v if r.action != "delete"] for k, v in rows.items()}
        assert len({r.lesson_id for r in rows["lessons"]}) == len(rows["lessons"])
        assert {(*order[r.unit_id], r.position, r.lesson_name): r.body for r in live["lessons"]} == state[2]
        stored = {k: result[k].filter("action <> 'delete'").select(*[f.split()[0] for f in s.split(", ")]) for k, s in STORED.items()}
        again = N.import_courses(frames, stored, prune)
        assert all({r.action for r in v.collect()} <= {"keep", "absent"} for v in again.values())


def test_numbers_are_dense_in_order(spark):
    rows = spark.createDataFrame([(x, y) for x in range(300) for y in "ab"], "k int, t string").repartition(7)
    found = {(r.k, r.t): r.number for r in N.numbered(rows, ["k", "t"]).collect()}
    assert [found[k] for k in sorted(found)] == list(range(1, 601))
    assert N.numbered(rows.limit(0), ["k"]).collect() == []


def test_relinking_by_id_then_key_with_the_rename_guard(spark):
    lessons = spark.createDataFrame([("a", 1, "P1", "1.1", "One", None), ("b", 2, None, "1.2", "Two", "Old"), ("c", 3, "P1", "1.2", "Copy", None), ("d", 4, None, None, "None", None)], "lesson string, at int, plan_id string, key string, name string, was_named string")
    targets = [(1, "P1", "9.9", "x"), (2, "P9", "1.1", "One"), (3, None, "1.1", None), (4, None, "1.2", "Old"), (5, None, "1.2", "Other"), (6, "P8", "7.7", "x"), (7, None, None, None)]
    found = N.relinked(spark.createDataFrame(targets, "target int, plan_id string, key string, name string"), lessons).collect()
    assert sorted(map(tuple, found), key=str) == [(1, "a", "id", None), (2, "a", "key", None), (3, "a", "key", None), (4, "b", "key", None), (5, None, None, "renamed"), (6, None, None, "missing"), (7, None, None, "missing")]


def test_a_level_works_out_both_sides_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(rows, schema, count):
        def run(batches):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, schema).mapInArrow(run, schema)

    incoming, stored = [(f"C{n}", "x", n) for n in range(40)], [(n, f"C{n}", "xy"[n % 2]) for n in range(20, 50)]
    found = N.level(counted(incoming, INCOMING["courses"], seen[0]), counted(stored, STORED["courses"], seen[1]), "course_id", ["code"], ["name"]).collect()
    assert len(found) == 50 and [count.value for count in seen] == [40, 30]
