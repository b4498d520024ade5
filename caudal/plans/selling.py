"""Queries on subscriptions, access, prices, rules, scopes and exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commerce, relational
from ..operators import selling as S
from ..sources.tables import buyers, moment, read, sales, validity
from . import exams  # noqa: F401  its rules are part of the union
from .catalogue import INTERVALS, NOW, SALES
from .registry import ORACLES, QUERIES, query

MIDNIGHT = f"TIMESTAMP '{NOW}'"


@query(f"SELECT o_orderkey AS id, o_orderdate + to_months((o_orderkey % 14)::INT) AS later, date_sub('day', o_orderdate, {MIDNIGHT}) AS days, greatest(0, date_sub('second', TIMESTAMP '2001-01-01', o_orderdate)) AS seconds FROM orders")
def calendar_steps(spark, sf):
    ts = F.col("o_orderdate")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.plus_months(ts, (F.col("o_orderkey") % 14).cast("int")).alias("later"), F.timestamp_diff("DAY", ts, moment(NOW)).alias("days"), S.seconds_between(moment("2001-01-01"), ts).alias("seconds"))


@query(
    f"WITH p AS (SELECT o_orderkey AS id, o_totalprice AS paid, o_orderdate AS a, o_orderdate + to_months(3) AS z, o_totalprice * (1 + o_orderkey % 3) AS price FROM orders), q AS (SELECT id, greatest(0, date_sub('second', TIMESTAMP '2001-06-15', z)) AS left_, round(greatest(0, price / date_sub('second', a, a + to_months(1)) - paid / date_sub('second', a, z)) * greatest(0, date_sub('second', TIMESTAMP '2001-06-15', z)), 6) AS x FROM p) "
    "SELECT id, (ceil(x / 10) * 10)::BIGINT AS amount, (left_ // 86400)::BIGINT AS days_left FROM q"
)
def proration(spark, sf):
    rows = read(spark, sf, "orders").withColumn("end", S.plus_months(F.col("o_orderdate"), F.lit(3)))
    price = F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3)
    return rows.select(F.col("o_orderkey").alias("id"), *(c.alias(n) for n, c in S.proration(F.col("o_totalprice"), F.col("o_orderdate"), F.col("end"), price, F.lit(1), moment("2001-06-15")).items()))


@query(f"WITH {INTERVALS}, c AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag = 'R' AS redeemed, l_linestatus = 'F' AND l_returnflag = 'A' AS cancelled, l_shipdate + to_days(l_quantity::INT) AS until FROM lineitem) SELECT CASE WHEN redeemed THEN 'redeemed' WHEN cancelled THEN 'cancelled' WHEN until < {MIDNIGHT} THEN 'expired' ELSE 'available' END AS state, count(*) AS codes FROM c GROUP BY 1")
def code_states(spark, sf):
    end = F.expr("l_shipdate + make_dt_interval(cast(l_quantity AS int))")
    state = S.code_state(F.col("l_returnflag") == "R", (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), end, moment(NOW))
    return read(spark, sf, "lineitem").groupBy(state.alias("state")).agg(F.count("*").alias("codes"))


@query(f"WITH {INTERVALS}, d AS (SELECT owner, \"end\", date_diff('day', TIMESTAMP '2001-08-15'::DATE, \"end\"::DATE) AS days FROM i) SELECT owner, \"end\", days, CASE WHEN days <= 1 THEN 1 WHEN days <= 3 THEN 3 ELSE 7 END AS threshold, least(\"end\", TIMESTAMP '2001-08-15' + INTERVAL 7 DAY) AS offline_until FROM d WHERE days BETWEEN 0 AND 7")
def reminders(spark, sf):
    now = moment("2001-08-15")
    rows = validity(spark, sf).select("owner", "end", F.datediff("end", now).alias("days"))
    return rows.withColumn("threshold", S.reminder(F.col("days"))).filter("threshold IS NOT NULL").withColumn("offline_until", S.offline_until(F.col("end"), now))


@query("WITH a AS (SELECT o_custkey AS k, CASE WHEN max(o_orderkey % 50) = 49 THEN NULL ELSE max(o_orderdate) END AS u FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderdate) + INTERVAL 30 DAY AS u FROM orders WHERE o_orderstatus = 'P' AND o_orderdate > '2001-01-01' GROUP BY 1) SELECT c_custkey AS buyer, a.k IS NOT NULL OR b.k IS NOT NULL AS has, CASE WHEN NOT (a.k IS NOT NULL AND a.u IS NULL) THEN greatest(a.u, b.u) END AS until FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey")
def access_ends(spark, sf):
    orders = read(spark, sf, "orders")
    a = orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("buyer")).agg(F.when(F.max(F.col("o_orderkey") % 50) < 49, F.max("o_orderdate")).alias("a"), F.lit(True).alias("has_a"))
    b = orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") > moment("2001-01-01"))).groupBy(F.col("o_custkey").alias("buyer")).agg((F.max("o_orderdate") + S.days(30)).alias("b"), F.lit(True).alias("has_b"))
    rows = buyers(spark, sf).join(a, "buyer", "left").join(b, "buyer", "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("buyer", *(c.alias(n) for n, c in S.later_end(has(F.col("has_a")), F.col("a"), has(F.col("has_b")), F.col("b")).items()))


@query(f"WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS z FROM orders) SELECT id FROM k WHERE (a IS NULL OR a <= {MIDNIGHT}) AND (z IS NULL OR z >= {MIDNIGHT})")
def open_intervals(spark, sf):
    key = F.col("o_orderkey")
    start, end = F.when(key % 4 != 0, F.col("o_orderdate")), F.when(key % 5 != 0, F.col("o_orderdate") + S.days(365))
    return read(spark, sf, "orders").filter(S.open_interval(moment(NOW), start, end)).select(key.alias("id"))


@query(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN trim('Plan ' || o_orderpriority || ' ' || CASE o_orderkey % 13 WHEN 1 THEN 'mensual' WHEN 6 THEN 'semestral' WHEN 12 THEN 'anual' ELSE '' END) WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN c_mktsegment WHEN o_orderkey % 5 = 0 THEN c_name ELSE '—' END AS label, "
    "replace(format('{:,}', round_even(o_totalprice, 0)::BIGINT), ',', '.') AS amount, CASE WHEN o_orderkey % 4 = 0 THEN 'mail' || o_custkey::VARCHAR ELSE trim(c_name) END AS shown FROM orders JOIN customer ON o_custkey = c_custkey"
)
def sale_labels(spark, sf):
    key = F.col("o_orderkey")
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = S.item_label(F.when(key % 3 == 0, F.col("o_orderpriority")), key % 13, F.when((key % 3 == 1) & (key % 2 == 0), F.col("c_mktsegment")), F.when(key % 5 == 0, F.col("c_name")))
    shown = S.display_name(F.when(key % 4 != 0, F.col("c_name")), F.lit(None).cast("string"), F.concat(F.lit("mail"), F.col("o_custkey").cast("string")))
    return rows.select(key.alias("id"), label.alias("label"), S.dotted(commerce.whole(F.col("o_totalprice"))).alias("amount"), shown.alias("shown"))


@query("SELECT o_orderkey AS id, 'A' || o_orderkey AS \"order\", o_custkey % 7 AS item, o_custkey AS who, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 30)::INT END AS days FROM orders")
def order_keys(spark, sf):
    key = F.concat_ws("_", F.concat(F.lit("A"), F.col("o_orderkey")), F.col("o_custkey") % 7, F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 30).cast("string")))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *(c.alias(n) for n, c in S.order_key(key).items()))


@query("WITH f AS (SELECT l_partkey AS part, l_shipdate AS ts, max(round_even(l_extendedprice / l_quantity, 0))::BIGINT AS price FROM lineitem GROUP BY 1, 2), s AS (SELECT *, lag(price) OVER (PARTITION BY part ORDER BY ts) AS was FROM f) SELECT *, CASE WHEN was <> 0 THEN round_even((price - was) * 100 / was, 0)::BIGINT END AS change FROM s WHERE price IS DISTINCT FROM was")
def price_changes(spark, sf):
    price = F.max(commerce.whole(F.col("l_extendedprice") / F.col("l_quantity"))).alias("price")
    return S.price_changes(read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts")).agg(price), "part", "ts", "price")


@query(f"{SALES}, f AS (SELECT date_trunc('week', ts)::DATE AS week, sum(amount)::DOUBLE AS revenue, count(*) AS sales FROM sales WHERE buyer = 7 GROUP BY 1), d AS (SELECT unnest(generate_series(date_trunc('week', DATE '1997-01-01'), DATE '2001-07-31', INTERVAL 7 DAY))::DATE AS week ORDER BY 1 DESC LIMIT 120) SELECT week, coalesce(revenue, 0) AS revenue, coalesce(sales, 0) AS sales, CASE WHEN sales > 0 THEN round_even(revenue / sales, 0)::BIGINT END AS price FROM d LEFT JOIN f USING (week)")
def weekly_prices(spark, sf):
    return S.weekly_prices(sales(spark, sf).filter("buyer = 7"), "1997-01-01", "2001-08-01")


@query(
    f"WITH c AS (SELECT o_orderpriority AS tier, o_totalprice AS price, (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 12 END) AS months, o_orderkey % 4 = 0 AS renewed, o_orderdate + INTERVAL 400 DAY AS e FROM orders), s AS (SELECT *, CASE WHEN {MIDNIGHT} <= e THEN 'active' WHEN {MIDNIGHT} <= e + INTERVAL 7 DAY THEN 'grace' WHEN {MIDNIGHT} <= e + INTERVAL 37 DAY THEN 'suspended' ELSE 'ended' END AS st FROM c), "
    "t AS (SELECT tier, count(*) FILTER (st = 'active') AS active, count(*) FILTER (st = 'grace') AS grace, count(*) FILTER (st = 'suspended') AS suspended, count(*) FILTER (st = 'ended') AS ended, coalesce(sum(round_even(price / months, 0)::BIGINT) FILTER (st IN ('active', 'grace')), 0)::BIGINT AS mrr, count(*) FILTER (renewed) AS renewed, count(*) AS n FROM s GROUP BY 1) "
    "SELECT * EXCLUDE (n), round_even(100.0::DOUBLE * renewed / n, 0)::BIGINT AS renewal, round_even(100.0::DOUBLE * ended / n, 0)::BIGINT AS churn FROM t"
)
def subscription_kpis(spark, sf):
    months = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 6).otherwise(12)
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_totalprice").alias("price"), months.alias("months"), (F.col("o_orderkey") % 4 == 0).alias("renewed"), (F.col("o_orderdate") + S.days(400)).alias("end"))
    return S.subscription_kpis(rows, commerce.contract_state(F.col("end"), moment(NOW)))


@query(f"WITH l AS ({ORACLES['ledger_consumption']}) SELECT owner, balance, weekly, weeks_left, greatest(ceil(weekly * 8 - balance), 1)::BIGINT AS missing FROM l WHERE weeks_left < 3")
def rule_low_balance(spark, sf):
    return S.low_balance(QUERIES["ledger_consumption"](spark, sf))


@query(
    f"{SALES}, p AS (SELECT buyer AS owner, 3::BIGINT AS units, 90::BIGINT AS paid FROM sales WHERE ts >= {MIDNIGHT} - INTERVAL 240 DAY), s AS (SELECT owner, count(*) AS purchases, sum(units)::BIGINT AS need, sum(paid)::BIGINT AS paid FROM p GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT need, min(a * 30 + b * 130 + c * 400) AS cost FROM (SELECT DISTINCT need FROM s), range(0, 61) x(a), range(0, 14) y(b), range(0, 5) z(c) WHERE a + b * 5 + c * 20 >= need GROUP BY 1) "
    "SELECT owner, purchases, need, paid, (paid - cost)::BIGINT AS saved FROM s JOIN c USING (need) WHERE cost < paid"
)
def rule_upsell(spark, sf):
    recent = sales(spark, sf).filter(F.col("ts") >= moment(NOW) - S.days(240)).select(F.col("buyer").alias("owner"), F.lit(3).cast("long").alias("units"), F.lit(90).cast("long").alias("paid"))
    needs = recent.groupBy("owner").agg(F.sum("units").alias("need")).select("need").distinct()
    return S.upsell(recent, commerce.cheapest_packs(needs, "need", {1: 30, 5: 130, 20: 400}))


PLANS = [(30, 900), (60, 1500), (90, 2100)]


@query("WITH s AS (SELECT c_nationkey AS school, count(*) AS students, (count(*) * 0.25)::DOUBLE AS weekly FROM customer GROUP BY 1), p(seats, monthly) AS (VALUES (30::BIGINT, 900::BIGINT), (60, 1500), (90, 2100)), f AS (SELECT school, students, weekly, (SELECT arg_min(monthly, seats) FROM p WHERE seats >= greatest(students, 1)) AS monthly, round_even(weekly * 52 / 12 * 20, 0)::BIGINT AS spend FROM s) SELECT school, students, spend, monthly FROM f WHERE students >= 64 OR coalesce(spend >= monthly, false)")
def rule_subscription(spark, sf):
    schools = buyers(spark, sf).groupBy("school").agg(F.count("*").alias("students")).withColumn("weekly", F.col("students") * 0.25)
    packs = spark.createDataFrame([(1, 30), (5, 130), (20, 400)], "units long, price long")
    reference = packs.agg(F.min(F.col("price") / F.col("units"))).first()[0]
    return S.subscription_candidates(schools, spark.createDataFrame(PLANS, "seats long, monthly long"), F.lit(reference), 64)


RULES = {"rule_low_balance": "owner", "rule_upsell": "owner", "rule_inactive": "buyer", "rule_subscription": "school", "rule_expiring": "owner", "rule_expired": "student", "rule_unpaid": "buyer"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS cases, count(DISTINCT {who}) AS who FROM ({ORACLES[name]})" for name, who in RULES.items()))
def opportunities(spark, sf):
    cases = None
    for name, who in RULES.items():
        part = QUERIES[name](spark, sf).select(F.lit(name).alias("rule"), F.col(who).cast("long").alias("who"))
        cases = part if cases is None else cases.unionByName(part)
    empty = spark.createDataFrame([(n,) for n in RULES], "rule string")
    counts = cases.groupBy("rule").agg(F.count("*").alias("cases"), F.countDistinct("who").alias("who"))
    return empty.join(counts, "rule", "left").select("rule", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("who", F.lit(0)).alias("who"))


ACTORS = [("admin", None, None), ("student", 5, None), ("director", None, 3), ("guest", None, None)]


@query("WITH r AS (SELECT o_orderkey AS id, c_custkey AS student, c_nationkey AS school FROM orders JOIN customer ON o_custkey = c_custkey) SELECT 'admin' AS role, id FROM r UNION ALL SELECT 'student', id FROM r WHERE student = 5 UNION ALL SELECT 'director', id FROM r WHERE school = 3")
def scope_by_role(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer")).join(buyers(spark, sf), "buyer").select("id", F.col("buyer").alias("student"), "school")
    found = None
    for role, who, school in ACTORS:
        part = S.visible(rows, role, who, school).select(F.lit(role).alias("role"), "id")
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT o_orderkey AS id, o_totalprice AS amount, o_orderdate AS ts, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100 OFFSET 200")
def result_page(spark, sf):
    rows = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("ts"))
    sorts = {"-ts": [F.desc("ts"), F.desc("id")], "-amount": [F.desc("amount"), F.desc("id")], "amount": [F.asc("amount"), F.asc("id")]}
    return S.page(rows, "-amount", sorts, 3, 5000)


@query(f"{SALES}, g AS (SELECT buyer, id, ts, amount::DOUBLE AS amount, plan, ts::DATE - lag(ts) OVER (PARTITION BY buyer ORDER BY ts, id)::DATE AS days FROM sales) SELECT buyer, id, days::INT AS days FROM g WHERE days IS NOT NULL")
def purchase_gaps(spark, sf):
    return S.gaps(sales(spark, sf), "buyer").select("buyer", "id", "days")


@query(f"{SALES}, c AS (SELECT buyer, plan, count(*) - 1 AS again FROM sales GROUP BY 1, 2) SELECT buyer, sum(again)::BIGINT AS renewals FROM c GROUP BY 1")
def renewals_by_plan(spark, sf):
    each = sales(spark, sf).groupBy("buyer", "plan").agg((F.count("*") - 1).alias("again"))
    return each.groupBy("buyer").agg(F.sum("again").alias("renewals"))


MOVES = "m AS (SELECT l_suppkey AS owner, l_shipdate AS ts, ((l_orderkey * 100 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, CASE WHEN l_returnflag = 'R' THEN 3 * l_quantity ELSE -l_quantity END::BIGINT AS quantity FROM lineitem)"


def _moves(spark, sf):
    quantity = F.when(F.col("l_returnflag") == "R", 3 * F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long")
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_shipdate").alias("ts"), (((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("id"), quantity.alias("quantity"))


@query(f"WITH {MOVES} SELECT owner, ts, id, quantity, sum(quantity) OVER (PARTITION BY owner ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM m")
def running_balance(spark, sf):
    return S.running_balance(_moves(spark, sf))


@query(f"WITH {MOVES} SELECT owner, max(ts) FILTER (quantity < 0) AS last_use, coalesce(sum(quantity) FILTER (quantity > 0), 0)::BIGINT AS bought, coalesce(-sum(quantity) FILTER (quantity < 0), 0)::BIGINT AS used FROM m GROUP BY 1")
def last_use(spark, sf):
    q = F.col("quantity")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _moves(spark, sf).groupBy("owner").agg(F.max(F.when(q < 0, F.col("ts"))).alias("last_use"), total(F.when(q > 0, q)).alias("bought"), total(F.when(q < 0, -q)).alias("used"))


@query("SELECT part, ts, price FROM (SELECT l_partkey AS part, l_shipdate AS ts, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def price_snapshot(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return S.first_of(rows, ["part"], "ts", "l_orderkey", "l_linenumber", "price").select("part", "ts", "price")


BATCH = "b AS (SELECT o_orderkey AS line, lower(trim(' User' || (o_custkey * 3 % 2000) || '@' || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Mail.example' END || ' ')) AS key FROM orders WHERE o_orderkey < 4000), t AS (SELECT 'user' || c_custkey || '@mail.example' AS key FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {BATCH}, f AS (SELECT *, min(line) OVER (PARTITION BY key) AS first FROM b) SELECT line, CASE WHEN NOT regexp_full_match(key, '[^@ ]+@[^@ ]+\\.[^@ ]+') THEN 'invalid' WHEN line > first THEN 'repeated' WHEN key IN (SELECT key FROM t) THEN 'exists' ELSE 'new' END AS status FROM f")
def batch_status(spark, sf):
    key = F.col("o_orderkey")
    mail = F.concat(F.lit(" User"), F.col("o_custkey") * 3 % 2000, F.lit("@"), F.when(key % 17 == 0, "").otherwise("Mail.example"), F.lit(" "))
    batch = read(spark, sf, "orders").filter("o_orderkey < 4000").select(key.alias("line"), mail.alias("mail"))
    table = read(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("user"), "c_custkey", F.lit("@mail.example")).alias("key"))
    clean = F.lower(F.trim("mail"))
    return S.batch_status(batch, table, clean, "line", clean.rlike(r"^[^@ ]+@[^@ ]+\.[^@ ]+$")).select("line", "status")


@query("WITH s AS (SELECT p_partkey AS id, lower(replace(p_brand, '#', '-')) AS name FROM part) SELECT id, name, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS \"unique\" FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM s)")
def unique_slugs(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))).alias("name"))
    return S.suffixed(names, "name", "id", "-")


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(trim(p_type))) AS kept FROM part")
def consolidated_categories(spark, sf):
    return S.consolidated(read(spark, sf, "part"), F.lower(F.trim("p_type")), "p_partkey").withColumnRenamed("p_partkey", "id")


@query(f"SELECT CASE WHEN action = 'delete' THEN 'stale' ELSE action END AS action, count(*) AS rows FROM ({ORACLES['upsert_actions']}) GROUP BY 1")
def import_counters(spark, sf):
    return S.pruned(QUERIES["upsert_actions"](spark, sf), prune=False)


@query("SELECT n_nationkey || ',' || CASE WHEN contains(n_name, ',') THEN '\"' || n_name || '\"' ELSE n_name END || ',' || n_regionkey AS line FROM nation")
def csv_export(spark, sf):
    return S.csv_lines(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS line FROM nation")
def json_export(spark, sf):
    return S.json_lines(read(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@query(f"SELECT count(*) AS orders, count(*) FILTER (o_orderdate >= {MIDNIGHT} - INTERVAL 7 DAY) AS last_7, count(*) FILTER (o_orderdate >= {MIDNIGHT} - INTERVAL 30 DAY) AS last_30, count(*) FILTER (o_orderstatus = 'P') AS pending, count(DISTINCT o_custkey) FILTER (o_totalprice > 400000) AS certified FROM orders")
def dashboard(spark, sf):
    recent = lambda n: F.count(F.when(F.col("o_orderdate") >= moment(NOW) - S.days(n), 1))
    return read(spark, sf, "orders").agg(F.count("*").alias("orders"), recent(7).alias("last_7"), recent(30).alias("last_30"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("pending"), F.countDistinct(F.when(F.col("o_totalprice") > 400000, F.col("o_custkey"))).alias("certified"))


@query("WITH h AS (SELECT o_custkey AS buyer, list_distinct(list(o_orderpriority)) AS x FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY 1), w AS (SELECT o_custkey AS buyer, list_distinct(list(o_orderpriority)) AS x FROM orders WHERE o_orderdate >= '2001-01-01' GROUP BY 1) SELECT w.buyer, list_sort(list_filter(w.x, lambda p: NOT list_contains(coalesce(h.x, []), p))) AS added FROM w LEFT JOIN h USING (buyer)")
def set_difference(spark, sf):
    orders = read(spark, sf, "orders")
    kinds = lambda rows, name: rows.groupBy(F.col("o_custkey").alias("buyer")).agg(F.collect_set("o_orderpriority").alias(name))
    now, was = kinds(orders.filter(F.col("o_orderdate") >= moment("2001-01-01")), "x"), kinds(orders.filter(F.col("o_orderdate") < moment("1997-01-01")), "y")
    return now.join(was, "buyer", "left").select("buyer", F.array_sort(F.array_except("x", F.coalesce("y", F.array().cast("array<string>")))).alias("added"))


@query("WITH p AS (SELECT DISTINCT p_brand AS tier, p_size AS seats FROM part) SELECT tier, seats, lead(seats) OVER (PARTITION BY tier ORDER BY seats) AS larger FROM p")
def next_larger_plan(spark, sf):
    return relational.next_larger(read(spark, sf, "part").select(F.col("p_brand").alias("tier"), F.col("p_size").alias("seats")), "tier", "seats")
