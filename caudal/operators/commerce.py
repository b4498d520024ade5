"""Commercial facts: KPIs, periods, dense series, states, portfolios and opportunity rules. The reference time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Half-even rounding to an integer, null kept."""
    return F.bround(x, 0).cast("long")


def percent(part: Column, total: Column) -> Column:
    return whole(F.when(total > 0, 100.0 * part / total).otherwise(F.lit(0.0)))


def percent_change(now: Column, before: Column) -> Column:
    """Whole per cent, half even; null without a base."""
    return F.when(before != 0, whole((now - before) * 100 / before))


def within(sales: DataFrame, start: Column, end: Column) -> DataFrame:
    return sales.filter((F.col("ts") >= start) & (F.col("ts") < end))


def kpis(sales: DataFrame, *by: str) -> DataFrame:
    """revenue, sales, ticket and buyers, in one pass with a partial aggregate before the shuffle."""
    total, count = F.coalesce(F.sum("amount"), F.lit(0)).cast("double"), F.count("*")
    return sales.groupBy(*by).agg(total.alias("revenue"), count.alias("sales"), whole(F.when(count > 0, total / count).otherwise(F.lit(0.0))).alias("ticket"), F.countDistinct("buyer").alias("buyers"))


def variation(sales: DataFrame, before: Column, start: Column, end: Column) -> DataFrame:
    """Revenue of [start, end) and of the period before it, and the change in per cent; one scan for both."""
    both = within(sales, before, end)
    now = F.coalesce(F.sum(F.when(F.col("ts") >= start, F.col("amount"))), F.lit(0)).cast("double")
    then = F.coalesce(F.sum(F.when(F.col("ts") < start, F.col("amount"))), F.lit(0)).cast("double")
    return both.agg(now.alias("revenue"), then.alias("previous")).withColumn("variation", percent_change(F.col("revenue"), F.col("previous")))


def repeat_buyers(sales: DataFrame, start: Column, end: Column) -> DataFrame:
    """Buyers in the period, and the share of them with a paid sale before it: one aggregate per buyer instead of a self join."""
    seen = sales.filter(F.col("buyer").isNotNull() & (F.col("ts") < end)).groupBy("buyer").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return seen.filter(F.col("last") >= start).agg(F.count("*").alias("buyers"), F.count(F.when(F.col("first") < start, 1)).alias("repeaters")).withColumn("repeat_share", percent(F.col("repeaters"), F.col("buyers")))


def dense_series(sales: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """One row per day or week (from Monday) of the period, zero-filled, with both channels as columns."""
    bucket = F.date_trunc(unit, F.col("ts")).cast("date")
    facts = sales.groupBy(bucket.alias("bucket")).agg(*(F.sum(F.when(F.col("channel") == c, F.col("amount"))).cast("double").alias(c) for c in ("b2c", "b2b")))
    spine = sales.sparkSession.sql(f"SELECT explode(sequence(cast(date_trunc('{unit}', DATE '{start}') AS date), date_sub(DATE '{end}', 1), INTERVAL {7 if unit == 'week' else 1} DAY)) AS bucket")
    return spine.join(facts, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("b2c", "b2b")))


def conversion(attempts: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Attempts by state; started ones count as abandoned after so many hours, and before that not at all."""
    late = F.col("ts") < now - F.make_dt_interval(F.lit(0), F.lit(hours))
    state = F.when(F.col("topic") == "purchase", "authorised").when(F.col("topic") == "error", "rejected").when((F.col("topic") == "click") & late, "abandoned").when(F.col("topic") == "click", "open")
    n = {s: F.count(F.when(F.col("state") == s, 1)) for s in ("authorised", "rejected", "abandoned", "open")}
    counted = attempts.withColumn("state", state).agg(*(c.alias(s) for s, c in n.items()))
    return counted.withColumn("conversion", percent(F.col("authorised"), F.col("authorised") + F.col("rejected") + F.col("abandoned")))


def contract_state(end: Column, now: Column) -> Column:
    """active to the end (included), then 7 days of grace, then 30 days suspended."""
    day = lambda n: F.make_dt_interval(F.lit(n))
    return F.when(now <= end, "active").when(now <= end + day(7), "grace").when(now <= end + day(37), "suspended").otherwise("ended")


def renewal(sales: DataFrame) -> DataFrame:
    """Buyers whose last sale is more than a day after their first."""
    spans = sales.groupBy("buyer").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return spans.agg(F.count("*").alias("buyers"), F.count(F.when(F.col("last") > F.col("first") + F.make_dt_interval(F.lit(1)), 1)).alias("renewed")).withColumn("rate", percent(F.col("renewed"), F.col("buyers")))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key, ties by what was seen first (ts, id); counted before the second step, so that hot keys arrive as a few rows."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min("ts").alias("ts"), F.min("id").alias("id"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "ts", "id")).alias(f"top_{value}"))


def portfolio(sales: DataFrame, key: str) -> DataFrame:
    """Per key: purchases, total of whole amounts, first and last day, mean gap in days between first and last, commonest plan."""
    base = sales.groupBy(key).agg(F.count("*").alias("purchases"), F.sum(whole(F.col("amount").cast("double"))).alias("total"), F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"), F.countDistinct("buyer").alias("buyers"))
    gap = F.when(F.col("purchases") > 1, whole(F.datediff("last_day", "first_day") / (F.col("purchases") - 1)))
    return base.join(most_frequent(sales, key, "plan"), key).withColumn("mean_gap_days", gap)


def consumption(moves: DataFrame, now: Column, weeks: int = 8) -> DataFrame:
    """moves: owner, ts, quantity (signed). Units used in the last weeks, their weekly mean, balance and weeks that it lasts."""
    recent = (F.col("ts") >= now - F.make_dt_interval(F.lit(7 * weeks))) & (F.col("ts") < now) & (F.col("quantity") < 0)
    out = moves.groupBy("owner").agg(F.coalesce(-F.sum(F.when(recent, F.col("quantity"))), F.lit(0)).cast("long").alias("used"), F.sum("quantity").cast("long").alias("balance"))
    return out.withColumn("weekly", F.round(F.col("used") / weeks, 1)).withColumn("weeks_left", F.when(F.col("used") > 0, F.round(F.col("balance") * weeks / F.col("used"), 1)))


def unpaid_without_later(unpaid: DataFrame, paid: DataFrame, *keys: str) -> DataFrame:
    """The most recent unpaid sale of each key (nulls are a key's values too), unless a paid one is as late; both sides are reduced to one row a key first."""
    last = paid.groupBy(*keys).agg(F.max("ts").alias("paid_at")).toDF(*(f"paid_{k}" for k in keys), "paid_at")
    latest = unpaid.groupBy(*keys).agg(F.max(F.struct("ts", "id")).alias("x")).select(*keys, "x.ts", "x.id")
    same = [F.col(k).eqNullSafe(F.col(f"paid_{k}")) for k in keys] + [F.col("paid_at") >= F.col("ts")]
    return latest.join(last, same, "left_anti").select(*keys, "id", "ts")


def top(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("amount").cast("double").alias("revenue"), F.count("*").alias("sales")).orderBy(F.desc("revenue"), key).limit(n)


def by_last(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("id")))).filter(F.col("place") <= n)


def cheapest_packs(needs: DataFrame, need: str, packs: dict[int, int], most: int = 100_000) -> DataFrame:
    """needs with the packs (size: price) that cover each: least cost, then fewest purchases, then fewest units. Null for none, or over `most`.

    The greatest need up to `most` bounds the table of costs, which one small helper fills and Spark broadcasts.
    """
    top = needs.filter(F.col(need) <= most).agg(F.max(need)).first()[0]
    best = [(0, 0, 0)]
    for total in range(1, int(top or 0) + 1):
        best.append(min((best[max(0, total - size)][0] + price, best[max(0, total - size)][1] + 1, best[max(0, total - size)][2] + size) for size, price in packs.items()))
    told = needs.sparkSession.createDataFrame([(n, *x) for n, x in enumerate(best) if n], f"{need} long, cost long, purchases long, units long")
    return needs.join(F.broadcast(told), need, "left").withColumn("surplus", F.col("units") - F.col(need))


def prices(rows: DataFrame, price: str, discount: str) -> DataFrame:
    """rows with the price after a discount in per cent, rounded half to even and half up, and raised to the next ten."""
    exact = F.round(F.col(price) * 100).cast("long") * (100 - F.col(discount)) / F.lit(10000.0)
    return rows.withColumns({"half_even": F.bround(exact).cast("long"), "half_up": F.round(exact).cast("long"), "tens": F.ceil(exact / 10) * 10})
