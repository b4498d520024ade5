"""Contracts: the decision table on known cases and against the fold, histories against a restarted stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caudal.operators import contracts as C
from caudal.streaming import contracts as stream

PLANS = {"a": C.Plan(5, {1: 10000, 6: 54000, 12: 96000}), "b": C.Plan(20, {1: 30000, 6: 162000, 12: 288000}), "c": C.Plan(50, {1: 70000, 6: 378000, 12: 672000})}
DAY = timedelta(days=1)


def play(*events):
    contract, out = C.Contract(PLANS), []
    for at, *event in events:
        contract = C.Contract(PLANS, contract.saved())  # as after a restart
        out += [(at, *row) for row in contract.step(*event, at)]
    return contract, out


def test_purchases_and_notices_of_one_contract():
    begin = datetime(2024, 1, 31, 10)
    end = datetime(2024, 2, 29, 10)
    ticks = [(begin + i * DAY / 2, "tick", None, None, 3) for i in range(1, 160)]
    _, out = play((begin, "buy", "a", 1, 0), *ticks)
    assert out[0] == (begin, "bought", "new", "a", 10000, begin, end)
    days = [(2, 22, "ends_7"), (2, 26, "ends_3"), (2, 28, "ends_1"), (2, 29, "grace"), (3, 7, "suspended"), (4, 6, "released")]
    assert [(at.month, at.day, key) for at, _, key, *_ in out[1:]] == [(m, d, f"{name}_20240229") for m, d, name in days]


def test_renewals_upgrades_and_changes():
    begin = datetime(2024, 3, 1)
    contract, out = play((begin, "buy", "b", 1, 0), (begin + 10 * DAY, "buy", "b", 1, 4), (begin + 11 * DAY, "buy", "c", 1, 4), (begin + 12 * DAY, "buy", "a", 6, 4), (begin + 13 * DAY, "buy", "a", 6, 4), (begin + 14 * DAY, "cancel", None, None, 4), (begin + 70 * DAY, "tick", None, None, 4))
    assert [(w, d) for _, w, d, *_ in out] == [("bought", "new"), ("bought", "renewal"), ("bought", "upgrade"), ("bought", "downgrade"), ("refused", "pending"), ("refused", "pending")]
    left, whole, paid_for = (datetime(2024, 5, 1) - begin - 11 * DAY).total_seconds(), 31 * 86400, 61 * 86400
    assert out[2][4] % 10 == 0 and 0 <= out[2][4] - (70000 / whole - 60000 / paid_for) * left < 10
    assert out[3][5:] == (datetime(2024, 5, 1), datetime(2024, 11, 1))
    assert (contract.plan, contract.months, contract.period_start, contract.paid, contract.change_at) == ("a", 6, datetime(2024, 5, 1), 54000, None)
    _, out = play((begin, "buy", "b", 1, 0), (begin, "buy", "a", 1, 6), (begin, "buy", "a", 2, 0), (begin, "buy", "z", 1, 0), (begin + DAY, "schedule", "a", 1, 0), (begin + DAY, "schedule", "c", 1, 0), (begin + DAY, "schedule", "b", 1, 0), (begin + 33 * DAY, "buy", "a", 1, 0), (begin + 34 * DAY, "cancel", None, None, 0), (begin + 100 * DAY, "schedule", "a", 1, 0), (begin + 101 * DAY, "buy", "a", 1, 99))
    assert [(w, d) for _, w, d, *_ in out] == [("bought", "new"), ("refused", "seats"), ("refused", "period"), ("refused", "plan"), ("scheduled", None), ("refused", "upgrade"), ("refused", "same"), ("bought", "renewal"), ("refused", "none"), ("refused", "none"), ("bought", "new")]
    _, out = play((begin, "buy", "a", 1, 0), (begin + DAY, "leave", None, None, 0), (begin + 30 * DAY, "tick", None, None, 0))
    assert len(out) == 1


def log(seed, schools=9, n=60):
    rng, rows = random.Random(seed), []
    for school in range(schools):
        at = datetime(2023, 1, rng.randint(1, 28), rng.randint(0, 23))
        for seq in range(n):
            at += timedelta(hours=rng.choice([0, 5, 24, 24, 72, 200]))
            kind = rng.choice(["buy"] * 3 + ["tick"] * 8 + ["schedule", "cancel", "leave"])
            rows.append((school, at, seq, kind, rng.choice(["a", "b", "c", "z", None]) if kind in ("buy", "schedule") else None, rng.choice([1, 1, 6, 12, 2, None]), rng.choice([0, 3, 6, 30, None])))
    return rows


SHAPE = "school int, at timestamp_ntz, seq int, kind string, plan string, months int, used int"


def test_batch_and_restarted_stream_tell_the_same(spark, tmp_path):
    rows = log(5)
    expected = set()
    for school in range(9):
        contract = C.Contract(PLANS)
        expected |= set(C.told(contract, school, [r[1:] for r in rows if r[0] == school]))
    events = spark.createDataFrame(rows, SHAPE)
    assert {tuple(r) for r in C.history(events, PLANS).collect()} == expected and len(expected) > 100
    middle = sorted(r[1] for r in rows)[len(rows) // 2]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (events.filter(F.col("at") < F.lit(middle)), events.filter(F.col("at") >= F.lit(middle))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream.append_history(spark.readStream.schema(events.schema).parquet(source), PLANS, out, state).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == expected
    assert spark.read.parquet(out).count() == len(expected)
    stream.append_history(spark.readStream.schema(events.schema).parquet(source), PLANS, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == len(expected)


def test_quotes_are_the_folds_decisions(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        now = datetime(2024, 5, 10) + timedelta(hours=rng.randint(0, 2000))
        contract = C.Contract(PLANS)
        for seq in range(rng.randint(0, 4)):
            at = now - timedelta(hours=(5 - seq) * rng.randint(1, 500))
            list(contract.step("buy", rng.choice("abc"), rng.choice([1, 1, 6]), 0, at))
        asked = rng.choice(["a", "b", "c", "z"]), rng.choice([1, 1, 6, 12, 5]), rng.choice([0, 4, 10, None])
        saved = [getattr(contract, f) for f in C.Contract.FIELDS[:9]]
        contract._come_into_force(now)
        rows.append((i, *asked, now, *saved, *contract.quote(*asked, now)))
    shape = "id int, asked_plan string, asked_months int, used int, now timestamp_ntz, plan string, months int, period_start timestamp_ntz, end timestamp_ntz, paid long, next_plan string, next_months int, next_paid long, change_at timestamp_ntz, k string, e string, a long"
    found = C.quotes(spark.createDataFrame(rows, shape), PLANS).collect()
    assert all((r.kind, r.error, r.amount) == (r.k, r.e, r.a) for r in found)
    assert {r.kind for r in found} == {"new", "renewal", "upgrade", "change", None} and {r.error for r in found} == {"period", "plan", "seats", "pending", None}


def test_defined_cases(spark):
    rows = [(None, datetime(2024, 1, 1), 1, "buy", "a", 1, None), (None, datetime(2024, 1, 1), 1, "buy", "a", 1, None), (1, datetime(2024, 1, 2), 1, None, None, None, None)]
    frame = spark.createDataFrame(rows, SHAPE)
    assert sorted((r.school, r.detail) for r in C.history(frame, PLANS).collect()) == [(None, "new"), (None, "renewal")]
    assert C.history(frame.limit(0), PLANS).collect() == []
    with pytest.raises(KeyError):
        C.Contract(PLANS)._price("z", 1)


def test_quiet_ticks_are_passed_over(spark):
    """Every tick went through the fold; those between two times at which one can tell anything need not."""
    steps = []
    for seed in (11, 12):
        rows = log(seed, 6, 120)
        expected = set()
        for school in range(6):
            contract, quiet = C.Contract(PLANS), None
            for row in (r[1:] for r in rows if r[0] == school):
                told = C.told(contract, school, [row])
                assert not (row[2] == "tick" and quiet and row[0] < quiet and told)
                steps.append(row[2] == "tick" and quiet is not None and row[0] < quiet)
                quiet = contract.quiet_until(row[0]) if row[2] == "tick" else None
                expected |= set(told)
        assert {tuple(r) for r in C.history(spark.createDataFrame(rows, SHAPE), PLANS).collect()} == expected
    assert sum(steps) > 100
