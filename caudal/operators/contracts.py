"""Subscription contracts: what a purchase is today and costs, and the history of contracts as an ordered fold over their events."""

from __future__ import annotations

import json
import math
from calendar import monthrange
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commerce import contract_state
from .selling import GRACE_DAYS, SUSPENDED_DAYS, proration

# Months that can be bought, days before the end at which a notice is due.
PERIODS, NOTICE_DAYS = (1, 6, 12), (1, 3, 7)


class Plan(NamedTuple):
    seats: int
    prices: dict[int, int]  # by months


def price(plan: Column, months: Column, plans: dict[str, Plan]) -> Column:
    """The price of a plan for so many months; null for an unknown plan or period. The catalogue is a short list, passed whole."""
    out = F.lit(None).cast("long")
    for name, p in plans.items():
        for n, amount in p.prices.items():
            out = F.when((plan == name) & (months == n), amount).otherwise(out)
    return out


def current(contract: DataFrame, now: Column) -> DataFrame:
    """Contracts after a change that was paid ahead has come into force (plan, months, period_start, paid, next_plan, next_months, next_paid, change_at)."""
    due = F.col("next_plan").isNotNull() & (now >= F.col("change_at"))
    swap = {"plan": F.col("next_plan"), "months": F.coalesce("next_months", "months"), "period_start": F.col("change_at"), "paid": F.coalesce("next_paid", F.lit(0))}
    gone = ("next_plan", "next_months", "next_paid", "change_at")
    values = {k: F.when(due, v).otherwise(F.col(k)) for k, v in swap.items()} | {k: F.when(~F.coalesce(due, F.lit(False)), F.col(k)) for k in gone}
    return contract.withColumns(values)


def quotes(rows: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """rows with `kind` (new, renewal, upgrade, change), `error`, `amount` and `days_left` (of an upgrade).

    rows has what is asked (asked_plan, asked_months, now) and the school's contract (see current(); all null without one), its end and
    used seats. Each row is decided by itself: no shuffle.
    """
    rows = current(rows, F.col("now"))
    state = F.when(F.col("end").isNotNull(), contract_state(F.col("end"), F.col("now")))
    ended = state.isNull() | (state == "ended")
    seats = F.lit(None).cast("int")
    for name, p in plans.items():
        seats = F.when(F.col("asked_plan") == name, p.seats).otherwise(seats)
    asked, now_costs = price(F.col("asked_plan"), F.col("asked_months"), plans), price(F.col("plan"), F.col("asked_months"), plans)
    same = (F.col("asked_plan") == F.col("plan")) & (F.col("asked_months") == F.col("months"))
    pending = F.col("change_at").isNotNull()
    error = F.when(~F.coalesce(F.col("asked_months").isin(*PERIODS), F.lit(False)), "period").when(seats.isNull(), "plan").when(ended, None).when(seats < F.coalesce("used", F.lit(0)), "seats").when((state == "active") & pending, "pending")
    dearer = (F.col("asked_months") == F.col("months")) & (F.col("asked_plan") != F.col("plan")) & (asked > now_costs)
    kind = F.when(error.isNotNull(), None).when(ended, "new").when((state != "active") | same, "renewal").when(dearer, "upgrade").otherwise("change")
    more = proration(F.col("paid"), F.col("period_start"), F.col("end"), asked, F.col("months"), F.col("now"))
    decided = rows.withColumns({"error": error, "kind": kind})
    return decided.withColumns({"amount": F.when(F.col("kind") == "upgrade", more["amount"]).when(F.col("kind").isNotNull(), asked), "days_left": F.when(F.col("kind") == "upgrade", more["days_left"])})


def months_later(point: datetime, months: int) -> datetime:
    year, month = divmod(point.year * 12 + point.month - 1 + months, 12)
    return point.replace(year=year, month=month + 1, day=min(point.day, monthrange(year, month + 1)[1]))


class Contract:
    """One school's contract, moved on by its events in order. Its state is small: the contract and the notices sent for its present end."""

    FIELDS = ("plan", "months", "period_start", "end", "paid", "next_plan", "next_months", "next_paid", "change_at", "leaving", "sent")
    DATES = ("period_start", "end", "change_at")

    def __init__(self, plans: dict[str, Plan], saved: str | None = None) -> None:
        self.plans = plans
        for name, value in (json.loads(saved) if saved else dict.fromkeys(self.FIELDS)).items():
            setattr(self, name, datetime.fromisoformat(value) if name in self.DATES and value else value)
        self.sent = list(self.sent or [])
        self._edges: tuple[datetime, list[datetime]] | None = None

    def saved(self) -> str:
        values = {name: getattr(self, name) for name in self.FIELDS}
        return json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in values.items()})

    def state(self, now: datetime) -> str:
        if self.end is None:
            return "none"
        late = [name for name, days in (("ended", GRACE_DAYS + SUSPENDED_DAYS), ("suspended", GRACE_DAYS), ("grace", 0)) if now > self.end + timedelta(days=days)]
        return late[0] if late else "active"

    def _come_into_force(self, now: datetime) -> None:
        if self.next_plan and self.change_at and now >= self.change_at:
            self.plan, self.months, self.period_start, self.paid = self.next_plan, self.next_months or self.months, self.change_at, self.next_paid or 0
            self.next_plan = self.next_months = self.next_paid = self.change_at = None

    def _price(self, plan: str, months: int) -> int:
        return self.plans[plan].prices[months]

    def _is_upgrade(self, plan: str, months: int) -> bool:
        return plan != self.plan and months == self.months and self._price(plan, months) > self._price(self.plan, months)

    def quote(self, plan: str | None, months: int | None, used: int | None, now: datetime) -> tuple[str | None, str | None, int | None]:
        """(kind, error, amount), the decision of quotes()."""
        state = self.state(now)
        if months not in PERIODS:
            return None, "period", None
        if plan not in self.plans:
            return None, "plan", None
        if state in ("none", "ended"):
            return "new", None, self._price(plan, months)
        if self.plans[plan].seats < (used or 0):
            return None, "seats", None
        if state == "active" and self.change_at:
            return None, "pending", None
        if state != "active" or (plan, months) == (self.plan, self.months):
            return "renewal", None, self._price(plan, months)
        if not self._is_upgrade(plan, months):
            return "change", None, self._price(plan, months)
        seconds = lambda a, b: max(0, int((b - a).total_seconds()))
        whole, paid_for = seconds(self.period_start, months_later(self.period_start, months)) or 1, seconds(self.period_start, self.end) or 1
        extra = max(0.0, (self._price(plan, months) / whole - self.paid / paid_for) * seconds(now, self.end))
        return "upgrade", None, math.ceil(round(extra, 6) / 10) * 10

    def _buy(self, plan: str | None, months: int | None, used: int | None, now: datetime) -> Iterator[tuple]:
        kind, error, amount = self.quote(plan, months, used, now)
        if error:
            yield "refused", error, plan, None, None, None
            return
        motive, start, fresh = kind, now, kind == "new" or kind == "renewal" and self.state(now) != "active"
        if fresh:
            self.plan, self.months, self.period_start, self.end, self.paid = plan, months, now, months_later(now, months), amount
            self.change_at = self.next_paid = None
        elif kind == "renewal":
            self.end, self.paid, start = months_later(self.end, months), self.paid + amount, self.period_start
        elif kind == "upgrade":
            self.plan, self.paid = plan, self.paid + amount
        else:
            motive = "downgrade" if amount < self._price(self.plan, months) else "renewal"
            self.next_plan, self.next_months, self.next_paid, self.change_at, start = plan, months, amount, self.end, self.end
            self.end = months_later(self.end, months)
        self.leaving = False
        if kind != "change" and not self.change_at and self.next_plan == plan:
            self.next_plan = self.next_months = None
        yield "bought", motive, plan, amount, start, self.end

    def _schedule(self, plan: str | None, months: int | None, now: datetime) -> Iterator[tuple]:
        checks = [
            ("period", lambda: months not in PERIODS),
            ("plan", lambda: plan not in self.plans),
            ("none", lambda: self.state(now) not in ("active", "grace")),
            ("pending", lambda: self.change_at),
            ("same", lambda: (plan, months) == (self.plan, self.months)),
            ("upgrade", lambda: self._is_upgrade(plan, months)),
        ]
        error = next((name for name, wrong in checks if wrong()), None)
        if not error:
            self.next_plan, self.next_months = plan, months
        yield "refused" if error else "scheduled", error, plan, None, None, None

    def _cancel(self) -> Iterator[tuple]:
        error = "none" if not self.next_plan else "pending" if self.change_at else None
        if not error:
            self.next_plan = self.next_months = None
        yield "refused" if error else "cancelled", error, None, None, None, None

    def _notices(self, used: int | None, now: datetime) -> Iterator[tuple]:
        state, name = self.state(now), None
        if state == "active" and not self.leaving and not self.change_at:
            left = (self.end.date() - now.date()).days
            name = next((f"ends_{d}" for d in NOTICE_DAYS if left <= d), None)
        elif state in ("grace", "suspended") or state == "ended" and used:
            name = "released" if state == "ended" else state
        if name:
            key = f"{name}_{self.end:%Y%m%d}"
            # Ends only grow, so notices for an earlier end are never due again.
            self.sent = [k for k in self.sent if k.endswith(key[-9:])]
            if key not in self.sent:
                self.sent.append(key)
                yield "notice", key, self.plan, None, None, self.end

    def quiet_until(self, now: datetime) -> datetime:
        """After a tick at `now`: until when (exclusive) no tick changes or tells anything, if no other event comes between; `now` if the next may."""
        if self.end is None:
            return datetime.max
        if self._edges is None or self._edges[0] != self.end:
            day = datetime.combine(self.end.date(), datetime.min.time())
            self._edges = self.end, sorted([day - timedelta(days=d) for d in NOTICE_DAYS] + [self.end + timedelta(days=d, microseconds=1) for d in (0, GRACE_DAYS, GRACE_DAYS + SUSPENDED_DAYS)])
        until = next((e for e in self._edges[1] if e > now), None)
        if until is None:
            if f"released_{self.end:%Y%m%d}" not in self.sent:
                return now  # a tick that tells of used seats is to come
            until = datetime.max
        return min(until, self.change_at) if self.next_plan and self.change_at and self.change_at > now else until

    def step(self, kind: str, plan: str | None, months: int | None, used: int | None, now: datetime) -> Iterator[tuple]:
        """Rows (what, detail, plan, amount, start, end) of one event: buy, schedule, cancel, leave or tick (the daily task)."""
        self._come_into_force(now)
        if kind == "buy":
            yield from self._buy(plan, months, used, now)
        elif kind == "schedule":
            yield from self._schedule(plan, months, now)
        elif kind == "cancel":
            yield from self._cancel()
        elif kind == "leave":
            self.leaving = self.end is not None
        elif kind == "tick" and self.end is not None:
            yield from self._notices(used, now)


EVENTS = ("school", "at", "seq", "kind", "plan", "months", "used")
HISTORY = "school long, at timestamp_ntz, seq long, what string, detail string, plan string, amount long, start timestamp_ntz, end timestamp_ntz"


def told(contract: Contract, school: int | None, events: Iterable[tuple]) -> list[tuple]:
    """HISTORY rows of one contract's events (at, seq, kind, plan, months, used) in order."""
    return [(school, at, seq, *row) for at, seq, kind, plan, months, used in events for row in contract.step(kind, plan, months, used, at)]


def history(events: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """HISTORY of all contracts from EVENTS: one ordered pass over each partition; of a school with many events only its state is held.

    Events at the same time go by seq. Null schools are one school; null months or plans are refused. Ticks carry their used seats only,
    and those within a contract's quiet time are passed over by their time alone.
    """
    time, epoch = pa.timestamp("us"), datetime(1970, 1, 1)
    micros = lambda point: (point - epoch) // timedelta(microseconds=1)
    schema = pa.schema([("school", pa.int64()), ("at", time), ("seq", pa.int64()), ("what", pa.string()), ("detail", pa.string()), ("plan", pa.string()), ("amount", pa.int64()), ("start", time), ("end", time)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        school, contract, quiet = object(), None, None
        for batch in batches:
            out, columns = [], [batch.column(0), batch.column(1).cast(pa.int64()), *batch.columns[2:]]
            for key, at, seq, kind, *rest in zip(*(c.to_pylist() for c in columns), strict=True):
                if key != school:
                    school, contract, quiet = key, Contract(plans), None
                elif quiet is not None and kind == "tick" and at is not None and at < quiet:
                    continue
                now = None if at is None else epoch + timedelta(microseconds=at)
                out += told(contract, key, [(now, seq, kind, *rest)])
                quiet = micros(contract.quiet_until(now)) if kind == "tick" and now is not None else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = events.select(F.col("school").cast("long").alias("school"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("seq").cast("long").alias("seq"), *EVENTS[3:])
    # What a tick does not read stays out of the shuffle.
    rows = rows.withColumns({c: F.when(F.col("kind").eqNullSafe("tick"), None).otherwise(F.col(c)) for c in ("plan", "months")})
    return rows.repartition("school").sortWithinPartitions("school", "at", "seq").mapInArrow(run, HISTORY)
