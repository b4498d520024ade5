"""Subscriptions, access, prices, opportunity rules, row scopes, pages and exports. The reference time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .commerce import percent, percent_change, whole

GRACE_DAYS, SUSPENDED_DAYS, OFFLINE_DAYS = 7, 30, 7
PAGE_MOST = 100


def days(n: int | Column) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def plus_months(point: Column, months: Column) -> Column:
    """The same time of day so many calendar months later, on the month's last day if it is shorter."""
    return F.add_months(point.cast("date"), months).cast("timestamp_ntz") + F.make_dt_interval(secs=F.timestamp_diff("SECOND", F.date_trunc("day", point).cast("timestamp_ntz"), point).cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, never negative."""
    return F.greatest(F.lit(0), F.timestamp_diff("SECOND", start, end))


def proration(paid: Column, paid_from: Column, end: Column, new_price: Column, months: Column, now: Column) -> dict[str, Column]:
    """What a change to a dearer plan costs for the days left, raised to the next ten, and these days."""
    one = lambda c: F.when(c == 0, 1).otherwise(c)
    left = seconds_between(now, end)
    rate = new_price / one(seconds_between(paid_from, plus_months(paid_from, months))) - paid / one(seconds_between(paid_from, end))
    # to a millionth, so that rounding noise does not raise the amount
    amount = F.round(F.greatest(F.lit(0.0), rate * left), 6)
    return {"amount": (F.ceil(amount / 10) * 10).cast("long"), "days_left": F.floor(left / 86400).cast("long")}


def code_state(redeemed: Column, cancelled: Column, until: Column, now: Column) -> Column:
    return F.when(redeemed, "redeemed").when(cancelled, "cancelled").when(until < now, "expired").otherwise("available")


def reminder(left: Column, thresholds: tuple[int, ...] = (1, 3, 7)) -> Column:
    """The least threshold that the days left do not exceed; null if none, or if the end has passed."""
    out = F.lit(None).cast("int")
    for t in sorted(thresholds, reverse=True):
        out = F.when(left <= t, t).otherwise(out)
    return F.when(left >= 0, out)


def offline_until(end: Column, now: Column) -> Column:
    """The end of access, but so many days from now at most; no end is no bound of its own."""
    return F.least(F.coalesce(end, now + days(OFFLINE_DAYS)), now + days(OFFLINE_DAYS))


def later_end(known_a: Column, a: Column, known_b: Column, b: Column) -> dict[str, Column]:
    """Whether either of two sources gives access, and its later end; a source without end is endless (null)."""
    endless = (known_a & a.isNull()) | (known_b & b.isNull())
    return {"has": known_a | known_b, "until": F.when(~endless, F.greatest(F.when(known_a, a), F.when(known_b, b)))}


def open_interval(now: Column, start: Column, end: Column) -> Column:
    """Whether now lies in an interval whose ends may be missing."""
    return (start.isNull() | (start <= now)) & (end.isNull() | (end >= now))


def dotted(amount: Column) -> Column:
    """A whole amount with dots between thousands."""
    return F.regexp_replace(F.format_number(amount, 0), ",", ".")


def item_label(plan: Column, months: Column, product: Column, course: Column) -> Column:
    """Plan and period, else product, else course, else a dash."""
    period = F.when(months == 1, "mensual").when(months == 6, "semestral").when(months == 12, "anual").otherwise("")
    return F.when(plan.isNotNull(), F.trim(F.concat(F.lit("Plan "), plan, F.lit(" "), period))).otherwise(F.coalesce(product, course, F.lit("—")))


def display_name(first: Column, last: Column, email: Column) -> Column:
    name = F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))))
    return F.when(name != "", name).otherwise(email)


def order_key(text: Column) -> dict[str, Column]:
    """Parts of order_item_user[_days]; days null if there are none."""
    part = F.split(text, "_")
    return {"order": F.get(part, F.lit(0)), "item": F.get(part, F.lit(1)).cast("long"), "who": F.get(part, F.lit(2)).cast("long"), "days": F.get(part, F.lit(3)).cast("int")}


def price_changes(facts: DataFrame, key: str, order: str, price: str) -> DataFrame:
    """Each change of a price with what it was and the change in whole per cent; the first price has neither."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(order))
    out = facts.withColumn("was", before).filter(~F.col(price).eqNullSafe(F.col("was")))
    return out.withColumn("change", percent_change(F.col(price), F.col("was")))


def weekly_prices(sales: DataFrame, start: str, end: str, most: int = 120) -> DataFrame:
    """Week (from Monday), revenue, sales and mean price (null without sales) of at most so many last weeks of the period."""
    facts = sales.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.sum("amount").cast("double").alias("revenue"), F.count("*").alias("sales"))
    spine = sales.sparkSession.sql(f"SELECT explode(slice(reverse(sequence(cast(date_trunc('week', DATE '{start}') AS date), date_sub(DATE '{end}', 1), INTERVAL 7 DAY)), 1, {most})) AS week")
    n = F.coalesce("sales", F.lit(0))
    return spine.join(facts, "week", "left").select("week", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), n.alias("sales"), F.when(n > 0, whole(F.col("revenue") / n)).alias("price"))


def subscription_kpis(contracts: DataFrame, state: Column) -> DataFrame:
    """contracts: tier, monthly, months, renewed. One row a tier: active, grace, suspended, ended, MRR of those with access, renewal and churn in per cent."""
    named = contracts.withColumn("state", state)
    n = {s: F.count(F.when(F.col("state") == s, 1)) for s in ("active", "grace", "suspended", "ended")}
    held = F.col("state").isin("active", "grace")
    mrr = F.sum(F.when(held, whole(F.col("price") / F.col("months"))).otherwise(0))
    out = named.groupBy("tier").agg(*(c.alias(s) for s, c in n.items()), mrr.alias("mrr"), F.count(F.when(F.col("renewed"), 1)).alias("renewed"), F.count("*").alias("contracts"))
    return out.withColumns({"renewal": percent(F.col("renewed"), F.col("contracts")), "churn": percent(F.col("ended"), F.col("contracts"))}).drop("contracts")


def low_balance(consumed: DataFrame, alert_weeks: float = 3.0, cover_weeks: int = 8) -> DataFrame:
    """Owners whose balance lasts less than so many weeks, and what covers the next ones (1 at least). consumed: consumption()."""
    missing = F.greatest(F.ceil(F.col("weekly") * cover_weeks - F.col("balance")), F.lit(1)).cast("long")
    return consumed.filter(F.col("weeks_left") < alert_weeks).select("owner", "balance", "weekly", "weeks_left", missing.alias("missing"))


def upsell(purchases: DataFrame, recommended: DataFrame) -> DataFrame:
    """purchases: owner, units, paid of each purchase. Owners of two or more who would have paid less by the recommended packs of their sum (units, cost)."""
    sums = purchases.groupBy("owner").agg(F.count("*").alias("purchases"), F.sum("units").alias("need"), F.sum("paid").alias("paid")).filter("purchases >= 2")
    return sums.join(recommended.select("need", "cost"), "need").filter("cost < paid").select("owner", "purchases", "need", "paid", (F.col("paid") - F.col("cost")).alias("saved"))


def subscription_candidates(schools: DataFrame, plans: DataFrame, key_price: Column, least: int) -> DataFrame:
    """schools: school, students, weekly; plans: seats, monthly. Schools with so many students, or whose keys cost as much as the least plan that holds them."""
    spend = whole(F.col("weekly") * 52 / 12 * key_price)
    fit = schools.join(F.broadcast(plans), F.col("seats") >= F.greatest(F.col("students"), F.lit(1)), "left")
    best = fit.groupBy("school", "students", "weekly").agg(F.min_by("monthly", "seats").alias("monthly"))
    return best.withColumn("spend", spend).filter((F.col("students") >= least) | F.coalesce(F.col("spend") >= F.col("monthly"), F.lit(False))).select("school", "students", "spend", "monthly")


def visible(rows: DataFrame, role: str, who: int | None = None, school: int | None = None) -> DataFrame:
    """Rows (student, school) that an actor sees: an admin all, a student their own, a director those of their school, others none."""
    rule = {"admin": F.lit(True), "student": F.col("student") == F.lit(who), "director": F.col("school") == F.lit(school)}
    return rows.filter(F.coalesce(rule.get(role, F.lit(False)), F.lit(False)))


def page(rows: DataFrame, sort: str, allowed: dict[str, list[Column]], number: int, size: int) -> DataFrame:
    """One page by a sort of the allowed ones (the first if it is not among them), with the count of all rows; size has a cap."""
    size = max(1, min(size, PAGE_MOST))
    order = allowed.get(sort) or next(iter(allowed.values()))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(size * (max(number, 1) - 1)).limit(size).crossJoin(F.broadcast(total))


def gaps(rows: DataFrame, key: str) -> DataFrame:
    """Days between each row (ts, id) and the one before of its key."""
    by = Window.partitionBy(key).orderBy("ts", "id")
    return rows.withColumn("days", F.datediff("ts", F.lag("ts").over(by))).filter("days IS NOT NULL")


def running_balance(moves: DataFrame) -> DataFrame:
    """moves: owner, ts, id, quantity. The balance after each."""
    by = Window.partitionBy("owner").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.withColumn("balance", F.sum("quantity").over(by))


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order; an aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def batch_status(batch: DataFrame, table: DataFrame, key: Column, order: str, valid: Column) -> DataFrame:
    """batch with `status` of each row: invalid, repeated (in the batch, after its first row), exists (in table, with column key), or new."""
    keyed = batch.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min(order).alias("first"))
    there = table.select("key").distinct().withColumn("there", F.lit(True))
    rows = keyed.join(first, "key", "left").join(there, "key", "left")
    status = F.when(~valid, "invalid").when(F.col(order) > F.col("first"), "repeated").when(F.col("there"), "exists").otherwise("new")
    return rows.withColumn("status", status).select(*batch.columns, "status")


def suffixed(rows: DataFrame, name: str, order: str, mark: str) -> DataFrame:
    """rows with `unique`: the name for the first of its kind, then name, mark and 2, 3, ..."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("unique", F.when(place == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(mark), place.cast("string"))))


def consolidated(rows: DataFrame, key: Column, id_: str) -> DataFrame:
    """Each id with the least id of its canonical key."""
    keyed = rows.select(F.col(id_), key.alias("key"))
    least = keyed.groupBy("key").agg(F.min(id_).alias("kept"))
    return keyed.join(least, "key").select(id_, "kept")


def pruned(actions: DataFrame, prune: bool) -> DataFrame:
    """Counts of actions; without prune what is gone stays and is not counted as deleted."""
    named = actions.withColumn("action", F.when((F.col("action") == "delete") & F.lit(not prune), "stale").otherwise(F.col("action")))
    return named.groupBy("action").agg(F.count("*").alias("rows"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """One CSV line a row; write_csv puts the header and byte order mark before them."""
    return rows.select(F.to_csv(F.struct(*rows.columns)).alias("line"))


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV parts with a header each (the first name after a byte order mark), written by the tasks."""
    rows.withColumnRenamed(rows.columns[0], f"﻿{rows.columns[0]}").write.option("header", True).csv(folder)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
