"""All queries of the engine by name, each with its independent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import commerce, corpus, learning, relational
from ..streaming import attempts
from ..sources.tables import answers, buyers, moment, read, sales, validity
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "flagship"]

START, MIDDLE, END = "2000-01-01", "2000-07-01", "2001-01-01"
NOW, TODAY = "2001-08-01", "2024-01-31"

SALES = "WITH sales AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_totalprice::DECIMAL(18,2) AS amount, o_custkey AS buyer, o_orderpriority AS plan FROM orders WHERE o_orderstatus IN ('F','O'))"


@query(f"{SALES} SELECT coalesce(sum(amount), 0)::DOUBLE AS revenue, count(*) AS sales, round_even(coalesce(sum(amount)::DOUBLE / nullif(count(*), 0), 0), 0)::BIGINT AS ticket, count(DISTINCT buyer) AS buyers FROM sales WHERE ts >= '{START}' AND ts < '{END}'")
def panorama_kpis(spark, sf):
    return commerce.kpis(commerce.within(sales(spark, sf), moment(START), moment(END)))


@query(f"{SALES}, t AS (SELECT coalesce(sum(amount) FILTER (ts >= '{MIDDLE}'), 0)::DOUBLE AS revenue, coalesce(sum(amount) FILTER (ts < '{MIDDLE}'), 0)::DOUBLE AS previous FROM sales WHERE ts >= '{START}' AND ts < '{END}') SELECT *, CASE WHEN previous <> 0 THEN round_even((revenue - previous) * 100 / previous, 0)::BIGINT END AS variation FROM t")
def panorama_variation(spark, sf):
    return commerce.variation(sales(spark, sf), moment(START), moment(MIDDLE), moment(END))


@query(f"{SALES}, b AS (SELECT DISTINCT buyer FROM sales WHERE ts >= '{MIDDLE}' AND ts < '{END}') SELECT count(*) AS buyers, count(*) FILTER (EXISTS (SELECT 1 FROM sales s WHERE s.buyer = b.buyer AND s.ts < '{MIDDLE}')) AS repeaters, round_even(100.0::DOUBLE * count(*) FILTER (EXISTS (SELECT 1 FROM sales s WHERE s.buyer = b.buyer AND s.ts < '{MIDDLE}')) / count(*), 0)::BIGINT AS repeat_share FROM b")
def repeat_buyers(spark, sf):
    return commerce.repeat_buyers(sales(spark, sf), moment(MIDDLE), moment(END))


CHANNELS = "CASE WHEN c_mktsegment IS NOT DISTINCT FROM 'HOUSEHOLD' THEN 'b2c' ELSE 'b2b' END"


@query(f"{SALES} SELECT {CHANNELS} AS channel, sum(amount)::DOUBLE AS revenue, count(*) AS sales, round_even(sum(amount)::DOUBLE / count(*), 0)::BIGINT AS ticket, count(DISTINCT buyer) AS buyers FROM sales JOIN customer ON buyer = c_custkey GROUP BY 1")
def channel_kpis(spark, sf):
    return commerce.kpis(sales(spark, sf).join(buyers(spark, sf), "buyer"), "channel")


def _series_sql(unit: str) -> str:
    return f"{SALES}, f AS (SELECT date_trunc('{unit}', ts)::DATE AS bucket, {CHANNELS} AS channel, sum(amount)::DOUBLE AS x FROM sales JOIN customer ON buyer = c_custkey WHERE ts >= '{START}' AND ts < '{END}' GROUP BY 1, 2), d AS (SELECT unnest(generate_series(date_trunc('{unit}', DATE '{START}')::DATE, DATE '{END}' - 1, INTERVAL 1 {unit}))::DATE AS bucket) SELECT d.bucket, coalesce(max(x) FILTER (channel = 'b2c'), 0.0) AS b2c, coalesce(max(x) FILTER (channel = 'b2b'), 0.0) AS b2b FROM d LEFT JOIN f USING (bucket) GROUP BY 1"


@query(_series_sql("day"))
def daily_series(spark, sf):
    return commerce.dense_series(commerce.within(sales(spark, sf), moment(START), moment(END)).join(buyers(spark, sf), "buyer"), START, END, "day")


@query(_series_sql("week"))
def weekly_series(spark, sf):
    return commerce.dense_series(commerce.within(sales(spark, sf), moment(START), moment(END)).join(buyers(spark, sf), "buyer"), START, END, "week")


@query(f"{SALES} SELECT c_nationkey AS school, sum(amount)::DOUBLE AS revenue, count(*) AS sales FROM sales JOIN customer ON buyer = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_schools(spark, sf):
    return commerce.top(sales(spark, sf).join(buyers(spark, sf), "buyer"), "school", 5)


@query(f"{SALES} SELECT plan, sum(amount)::DOUBLE AS revenue, count(*) AS sales, round_even(sum(amount)::DOUBLE / count(*), 0)::BIGINT AS ticket, count(DISTINCT buyer) AS buyers FROM sales GROUP BY 1")
def plan_mix(spark, sf):
    return commerce.kpis(sales(spark, sf), "plan")


@query("WITH s AS (SELECT CASE WHEN event_type = 'purchase' THEN 'a' WHEN event_type = 'error' THEN 'r' WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 HOUR THEN 'x' WHEN event_type = 'click' THEN 'o' END AS st FROM events), n AS (SELECT count(*) FILTER (st = 'a') AS authorised, count(*) FILTER (st = 'r') AS rejected, count(*) FILTER (st = 'x') AS abandoned, count(*) FILTER (st = 'o') AS open FROM s) SELECT *, round_even(100.0::DOUBLE * authorised / (authorised + rejected + abandoned), 0)::BIGINT AS conversion FROM n")
def attempt_conversion(spark, sf):
    return commerce.conversion(answers(spark, sf), moment("2024-01-30 12:00:00"))


INTERVALS = "i AS (SELECT l_suppkey AS owner, l_shipdate AS start, l_shipdate + to_days(l_quantity::INT) AS \"end\" FROM lineitem)"


@query(f"WITH {INTERVALS} SELECT CASE WHEN TIMESTAMP '{NOW}' <= \"end\" THEN 'active' WHEN TIMESTAMP '{NOW}' <= \"end\" + INTERVAL 7 DAY THEN 'grace' WHEN TIMESTAMP '{NOW}' <= \"end\" + INTERVAL 37 DAY THEN 'suspended' ELSE 'ended' END AS state, count(*) AS contracts FROM i GROUP BY 1")
def contract_states(spark, sf):
    return validity(spark, sf).groupBy(commerce.contract_state(F.col("end"), moment(NOW)).alias("state")).agg(F.count("*").alias("contracts"))


@query(f"{SALES} SELECT plan, sum(round_even(amount::DOUBLE / (1 + id % 12), 0)::BIGINT)::BIGINT AS mrr FROM sales GROUP BY 1")
def mrr_by_tier(spark, sf):
    return sales(spark, sf).groupBy("plan").agg(F.sum(commerce.whole(F.col("amount").cast("double") / (1 + F.col("id") % 12))).alias("mrr"))


@query(f"{SALES}, b AS (SELECT min(ts) AS a, max(ts) AS z FROM sales GROUP BY buyer) SELECT count(*) AS buyers, count(*) FILTER (z > a + INTERVAL 1 DAY) AS renewed, round_even(100.0::DOUBLE * count(*) FILTER (z > a + INTERVAL 1 DAY) / count(*), 0)::BIGINT AS rate FROM b")
def renewal_rate(spark, sf):
    return commerce.renewal(sales(spark, sf))


def _portfolio_sql(key: str, join: str) -> str:
    return f"{SALES}, s AS (SELECT {key} AS k, sales.* FROM sales {join}), m AS (SELECT k, plan, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(ts), min(id)) AS r FROM s GROUP BY 1, 2), b AS (SELECT k, count(*) AS purchases, sum(round_even(amount::DOUBLE, 0)::BIGINT)::BIGINT AS total, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, count(DISTINCT buyer) AS buyers FROM s GROUP BY 1) SELECT b.k AS {'school' if join else 'buyer'}, purchases, total, first_day, last_day, {'buyers, ' if join else ''}plan AS top_plan, CASE WHEN purchases > 1 THEN round_even((last_day - first_day)::DOUBLE / (purchases - 1), 0)::BIGINT END AS mean_gap_days FROM b JOIN m ON b.k = m.k AND r = 1"


@query(_portfolio_sql("c_nationkey", "JOIN customer ON buyer = c_custkey"))
def school_portfolio(spark, sf):
    return commerce.portfolio(sales(spark, sf).join(buyers(spark, sf), "buyer"), "school")


@query(_portfolio_sql("buyer", ""))
def buyer_portfolio(spark, sf):
    return commerce.portfolio(sales(spark, sf).withColumnRenamed("buyer", "who").withColumn("buyer", F.col("who")), "who").drop("buyers").withColumnRenamed("who", "buyer")


@query(f"WITH m AS (SELECT l_suppkey AS owner, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 3 * l_quantity ELSE -l_quantity END::BIGINT AS q FROM lineitem), t AS (SELECT owner, coalesce(-sum(q) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 56 DAY AND ts < '{NOW}' AND q < 0), 0)::BIGINT AS used, sum(q)::BIGINT AS balance FROM m GROUP BY 1) SELECT *, round(used / 8, 1) AS weekly, CASE WHEN used > 0 THEN round(balance * 8 / used, 1) END AS weeks_left FROM t")
def ledger_consumption(spark, sf):
    quantity = F.when(F.col("l_returnflag") == "R", 3 * F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long")
    moves = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_shipdate").alias("ts"), quantity.alias("quantity"))
    return commerce.consumption(moves, moment(NOW))


@query(f"{SALES}, p AS (SELECT o_custkey AS buyer, o_orderpriority AS plan, o_orderkey AS id, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus NOT IN ('F','O')) SELECT buyer, plan, id, ts FROM p WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM sales s WHERE s.buyer = p.buyer AND s.plan IS NOT DISTINCT FROM p.plan AND s.ts >= p.ts)")
def rule_unpaid(spark, sf):
    return commerce.unpaid_without_later(sales(spark, sf, paid=False), sales(spark, sf), "buyer", "plan")


@query(f"{SALES} SELECT buyer, max(ts) AS last_at FROM sales GROUP BY 1 HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 180 DAY")
def rule_inactive(spark, sf):
    return sales(spark, sf).groupBy("buyer").agg(F.max("ts").alias("last_at")).filter(F.col("last_at") < moment(NOW) - F.make_dt_interval(F.lit(180)))


@query(f"WITH {INTERVALS} SELECT owner, count(*) AS contracts, max(\"end\") AS last_end FROM i GROUP BY 1 HAVING max(\"end\") BETWEEN TIMESTAMP '2001-11-01' AND TIMESTAMP '2001-11-01' + INTERVAL 20 DAY")
def rule_expiring(spark, sf):
    ends = validity(spark, sf).groupBy("owner").agg(F.count("*").alias("contracts"), F.max("end").alias("last_end"))
    return ends.filter(F.col("last_end").between(moment("2001-11-01"), moment("2001-11-01") + F.make_dt_interval(F.lit(20))))


LEVELS = "WITH r AS (SELECT user_id AS \"user\", event_type AS topic, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events), c AS (SELECT \"user\", topic, count(*) AS answers, count(*) FILTER (value >= 50) AS hits FROM r WHERE n <= 20 GROUP BY 1, 2), l AS (SELECT *, round_even(100.0::DOUBLE * hits / answers, 0)::BIGINT AS rate FROM c), v AS (SELECT *, CASE WHEN answers < 5 THEN 'none' WHEN rate >= 80 THEN 'high' WHEN rate >= 50 THEN 'middle' ELSE 'low' END AS level FROM l)"


@query(f"{LEVELS} SELECT * FROM v")
def last_n_level(spark, sf):
    return learning.last_n_level(answers(spark, sf))


@query(f"{LEVELS}, w AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY rate, topic) AS n FROM v WHERE level <> 'none') SELECT \"user\", topic, rate FROM w WHERE n = 1")
def recommended_topic(spark, sf):
    return learning.weakest_topic(learning.last_n_level(answers(spark, sf)))


STREAKS = f"WITH d AS (SELECT DISTINCT user_id AS \"user\", ts::DATE AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY \"user\" ORDER BY day)::INT AS run FROM d), n AS (SELECT \"user\", run, count(*) AS days, max(day) AS last FROM g GROUP BY 1, 2), s AS (SELECT \"user\", max(days) AS longest, coalesce(max(days) FILTER (last >= DATE '{TODAY}' - 1), 0)::BIGINT AS current FROM n GROUP BY 1)"


@query(f"{STREAKS} SELECT * FROM s")
def streaks(spark, sf):
    return learning.streaks(answers(spark, sf), F.lit(TODAY).cast("date"))


@query(f"{STREAKS}, x AS (SELECT user_id AS \"user\", count(*) * 10 AS xp FROM events GROUP BY 1), y AS (SELECT \"user\", xp, (SELECT max(k) FROM range(0, 1000) t(k) WHERE 50 * k * (k + 1) <= xp)::BIGINT AS level, longest, current, longest >= 7 AS week_streak FROM x JOIN s USING (\"user\")) SELECT *, level >= 5 AS level_five FROM y")
def achievements(spark, sf):
    return learning.achievements(answers(spark, sf), F.lit(TODAY).cast("date"))


@query("WITH v AS (SELECT DISTINCT user_id AS \"user\", json_extract_string(props, '$.k')::BIGINT AS lesson FROM events WHERE event_type = 'view') SELECT \"user\", count(*) AS seen, 50::BIGINT AS lessons, round_even(100.0::DOUBLE * count(*) / 50, 0)::BIGINT AS progress FROM v WHERE lesson < 50 GROUP BY 1")
def progress(spark, sf):
    viewed = answers(spark, sf).filter("topic = 'view'").select("user", F.get_json_object("props", "$.k").cast("long").alias("lesson"))
    return learning.progress(viewed, spark.range(50).select(F.col("id").alias("lesson")))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2")
def last_writer_wins(spark, sf):
    return relational.last_writer(read(spark, sf, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], "turn")


NORMAL = "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORMAL}) AS first_id FROM documents) SELECT * FROM k WHERE doc_id > first_id")
def text_duplicates(spark, sf):
    return relational.duplicates(read(spark, sf, "documents"), T.normalised(F.col("text")), "doc_id")


@query("WITH i AS (SELECT l_suppkey AS owner, l_shipdate AS start, l_shipdate + to_days(l_quantity::INT) AS \"end\" FROM lineitem), m AS (SELECT *, max(\"end\") OVER (PARTITION BY owner ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY start, \"end\") AS island FROM m) SELECT owner, min(start) AS start, max(\"end\") AS \"end\", count(*) AS parts FROM g GROUP BY owner, island")
def interval_merge(spark, sf):
    return relational.merge_intervals(validity(spark, sf), "owner")


@query("WITH f AS (SELECT l_partkey AS part, l_shipdate AS ts, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2), p AS (SELECT l_partkey AS part, o_orderdate AS ts, o_orderkey AS id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT p.part, p.ts, p.id, p.line, f.price FROM p ASOF LEFT JOIN f ON p.part = f.part AND p.ts >= f.ts")
def asof_price(spark, sf):
    lines, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    facts = lines.groupBy(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    dated = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    probes = lines.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line")).join(dated, "id").select("part", "ts", "id", "line")
    return relational.asof(probes, facts, "part", "price")


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS need, (SELECT min(p_size)::DOUBLE FROM part WHERE p_size >= l_quantity) AS fits FROM lineitem")
def capacity_lookup(spark, sf):
    needs = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("need"))
    return relational.capacity(needs, "need", read(spark, sf, "part"), "p_size")


@query("WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS turn FROM documents) SELECT * FROM t ORDER BY turn, source LIMIT 40")
def round_robin(spark, sf):
    return relational.round_robin(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 40)


@query("WITH o AS (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderdate >= '2001-01-01' GROUP BY 1) SELECT coalesce(o.k, n.k) AS buyer, CASE WHEN o.k IS NULL THEN 'create' WHEN n.k IS NULL THEN 'delete' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.k = n.k")
def upsert_actions(spark, sf):
    orders = read(spark, sf, "orders")
    side = lambda rows: rows.groupBy(F.col("o_custkey").alias("buyer")).agg(F.max("o_orderpriority").alias("plan"))
    return relational.upsert_actions(side(orders.filter(F.col("o_orderdate") < moment("1998-01-01"))), side(orders.filter(F.col("o_orderdate") >= moment("2001-01-01"))), "buyer", "plan")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'brand#2')")
def text_search(spark, sf):
    found = F.lower("p_name").contains("ring") | F.lower("p_brand").contains("brand#2")
    return read(spark, sf, "part").filter(found).select("p_partkey", "p_name")


@query(f"{SALES} SELECT id, buyer FROM sales JOIN customer ON buyer = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def scope_rows(spark, sf):
    schools = read(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("school"))
    return sales(spark, sf).join(buyers(spark, sf).join(schools, "school", "left_semi"), "buyer", "left_semi").select("id", "buyer")


@query(f"SELECT doc_id, {NORMAL} AS normal FROM documents")
def normalise_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.normalised(F.col("text")).alias("normal"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS digest FROM documents")
def hash_fragment(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fragment_hash(F.col("text")).alias("digest"))


TERMS = f"words AS (SELECT doc_id, string_split({NORMAL}, ' ') AS w FROM documents), terms AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM words) WHERE length(term) > 2 AND term NOT IN {T.STOP_WORDS} AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1, 2)"


@query(f"WITH {TERMS} SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first) AS place FROM terms QUALIFY place <= 10")
def keywords(spark, sf):
    return corpus.keywords(read(spark, sf, "documents"), "doc_id", 10)


@query("WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), h AS (SELECT source, line, count(*) AS docs FROM l WHERE line <> '' GROUP BY 1, 2) SELECT source, line, docs FROM h JOIN t USING (source) WHERE docs >= 3 AND docs * 20 >= n")
def repeated_lines(spark, sf):
    return corpus.repeated_lines(read(spark, sf, "documents"), "source", "doc_id", parts=20)


@query(f"WITH {TERMS}, rare AS (SELECT term FROM terms GROUP BY 1 HAVING count(*) <= 0.02 * (SELECT count(*) FROM documents)), mine AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split({NORMAL}, ' ')) AS term FROM benchmark) WHERE length(term) > 2 AND term NOT IN {T.STOP_WORDS} AND NOT regexp_matches(term, '^[0-9]+$') AND term IN (SELECT term FROM rare)), s AS (SELECT item_id, count(*) AS terms FROM mine GROUP BY 1) SELECT item_id, doc_id, common, s.terms, round(common / s.terms, 4) AS share FROM (SELECT item_id, doc_id, count(*) AS common FROM mine JOIN terms USING (term) GROUP BY 1, 2) JOIN s USING (item_id)")
def anchoring(spark, sf):
    return corpus.shared_terms(read(spark, sf, "benchmark"), read(spark, sf, "documents"), "item_id", "doc_id", 0.02)


@query("WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5")
def vector_topk(spark, sf):
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return corpus.nearest(vectors, asked, 5)


@query("SELECT user_id AS \"user\", CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS day, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS authorised FROM events GROUP BY 1, 2")
def stream_daily_attempts(spark, sf):
    return attempts.daily(spark, sf)


@query("SELECT c_custkey AS buyer, c_nationkey AS school FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2001-01-01')")
def left_count_zero(spark, sf):
    late = read(spark, sf, "orders").filter(F.col("o_orderdate") >= moment("2001-01-01")).select(F.col("o_custkey").alias("buyer"))
    return relational.childless(buyers(spark, sf).select("buyer", "school"), late, "buyer")


@query("SELECT c_custkey AS buyer FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '2001-07-01') OR c_acctbal > 9000")
def multi_path_semi(spark, sf):
    people = read(spark, sf, "customer").select(F.col("c_custkey").alias("buyer"), F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    near = people.join(read(spark, sf, "nation").filter("n_regionkey = 2"), "n_nationkey", "left_semi")
    late = read(spark, sf, "orders").filter(F.col("o_orderdate") >= moment("2001-07-01")).select(F.col("o_custkey").alias("buyer"))
    return relational.by_any_path(people.select("buyer"), "buyer", near, late, people.filter("c_acctbal > 9000"))


@query(f"WITH {INTERVALS}, p AS (SELECT l_suppkey AS owner, o_orderdate AS ts, l_orderkey AS id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT * FROM p WHERE EXISTS (SELECT 1 FROM i WHERE i.owner = p.owner AND p.ts >= i.start AND p.ts <= i.\"end\")")
def range_containment(spark, sf):
    dated = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    return relational.contained(lines.join(dated, "id").select("owner", "ts", "id", "line"), validity(spark, sf), "owner")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents QUALIFY place <= 30 AND (place - 1) % 3 = 0")
def systematic(spark, sf):
    return relational.systematic(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3, 10)


@query("WITH f AS (SELECT l_partkey AS part, l_shipdate AS ts, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2), s AS (SELECT *, lag(price) OVER (PARTITION BY part ORDER BY ts) AS previous FROM f) SELECT * FROM s WHERE price IS DISTINCT FROM previous")
def price_steps(spark, sf):
    lines = read(spark, sf, "lineitem")
    facts = lines.groupBy(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return relational.steps(facts, "part", "ts", "price")


@query("SELECT l_orderkey AS id, count(*) AS parts, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS gapless FROM lineitem GROUP BY 1")
def range_order(spark, sf):
    return relational.gapless(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")), "id", "line")


@query("WITH d AS (SELECT DISTINCT l_quantity::BIGINT AS need FROM lineitem), c AS (SELECT need, a * 30 + b * 130 + c * 400 AS cost, a + b + c AS purchases, a + b * 5 + c * 20 AS units FROM d, range(0, 51) x(a), range(0, 12) y(b), range(0, 5) z(c) WHERE a + b * 5 + c * 20 >= need), m AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY cost, purchases, units) AS r FROM c) SELECT l_orderkey AS id, l_linenumber AS line, l_quantity::BIGINT AS need, cost::BIGINT AS cost, purchases::BIGINT AS purchases, units::BIGINT AS units, units::BIGINT - l_quantity::BIGINT AS surplus FROM lineitem LEFT JOIN m ON m.need = l_quantity::BIGINT AND r = 1")
def pack_recommendation(spark, sf):
    needs = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("need"))
    return commerce.cheapest_packs(needs, "need", {1: 30, 5: 130, 20: 400})


@query("WITH x AS (SELECT p_partkey, round(p_retailprice * 100)::BIGINT * (100 - p_size) / 10000.0::DOUBLE AS exact, p_size FROM part) SELECT p_partkey, round_even(exact, 0)::BIGINT AS half_even, round(exact)::BIGINT AS half_up, (ceil(exact / 10) * 10)::BIGINT AS tens, ceil(p_size / 7)::BIGINT AS keys FROM x")
def effective_prices(spark, sf):
    parts = read(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return commerce.prices(parts, "p_retailprice", "p_size").select("p_partkey", "half_even", "half_up", "tens", F.ceil(F.col("p_size") / 7).alias("keys"))


@query(f"WITH a AS ({ORACLES['anchoring']}) SELECT item_id, max(share) AS best, CASE WHEN max(share) >= 0.6 THEN 'solid' WHEN max(share) > 0 THEN 'weak' ELSE 'uncovered' END AS coverage FROM benchmark LEFT JOIN a USING (item_id) GROUP BY 1")
def coverage_classes(spark, sf):
    return corpus.coverage(read(spark, sf, "benchmark"), anchoring(spark, sf), "item_id", 0.6)


@query("SELECT doc_id, CASE WHEN n_chars < 0.5::DOUBLE * median(n_chars) OVER (PARTITION BY source) THEN 'visual' ELSE 'text' END AS kind FROM documents")
def page_class(spark, sf):
    return corpus.short_of_median(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", 0.5).select("doc_id", "kind")


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_retailprice < 1000 THEN 'cheap' END, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'brand' END) AS reasons FROM part WHERE p_size < 5 OR p_retailprice < 1000 OR p_brand LIKE 'Brand#1%'")
def validity_flags(spark, sf):
    rules = {"small": F.col("p_size") < 5, "cheap": F.col("p_retailprice") < 1000, "brand": F.col("p_brand").startswith("Brand#1")}
    reasons = F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items()))
    return read(spark, sf, "part").select("p_partkey", reasons.alias("reasons")).filter("reasons <> ''")


@query("SELECT CASE event_type WHEN 'purchase' THEN 'Sales' WHEN 'signup' THEN 'Sales' WHEN 'view' THEN 'Reading' ELSE 'General' END AS category, count(*) AS answers FROM events GROUP BY 1")
def taxonomy(spark, sf):
    names = F.create_map(*(F.lit(x) for pair in {"purchase": "Sales", "signup": "Sales", "view": "Reading"}.items() for x in pair))
    category = F.coalesce(F.try_element_at(names, F.col("topic")), F.lit("General"))
    return answers(spark, sf).groupBy(category.alias("category")).agg(F.count("*").alias("answers"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ0-9]+'))::INT AS words, length(text)::INT AS chars, len(string_split(text, chr(10)))::INT AS lines FROM documents")
def word_stats(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", T.word_count(text).alias("words"), F.length(text).alias("chars"), F.size(F.split(text, "\n")).alias("lines"))


@query("WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS x FROM documents) SELECT doc_id, count(*)::INT AS sentences, max(length(x))::INT AS longest FROM s GROUP BY 1")
def sentence_split(spark, sf):
    found = T.sentences(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(found).alias("sentences"), F.array_max(F.transform(found, F.length)).alias("longest")).filter("sentences > 0")


@query("WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substring(t, 1, 77), ' [^ ]*$', '') || '...' END AS short FROM c")
def shorten(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.shortened(F.col("text"), 80).alias("short"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales panorama: KPIs, change to the period before, repeat buyers, in one row."""
    parts = [panorama_kpis(spark, sf_dir), panorama_variation(spark, sf_dir).drop("revenue"), repeat_buyers(spark, sf_dir).select("repeaters", "repeat_share")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])
