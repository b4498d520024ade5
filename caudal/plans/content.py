"""Queries on course content and imports, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import content as C
from ..sources.tables import read
from .registry import query

RESOURCES = "r AS (SELECT l_orderkey AS lesson, l_linenumber * 1000000 + l_partkey AS place, CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'N' THEN 'video' ELSE 'pdf' END AS type, 'role' || (l_suppkey % 4) AS role, CASE WHEN l_quantity > 5 THEN 'u' || l_partkey || '-' || l_suppkey END AS url FROM lineitem)"
KINDS = {"audio": ("role1", "role0"), "video": ("role2",), "pdf": ("role0", "role3", "role1")}


def _resources(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "N", "video").otherwise("pdf")
    url = F.when(F.col("l_quantity") > 5, F.concat(F.lit("u"), "l_partkey", F.lit("-"), "l_suppkey"))
    place = F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("lesson"), place.alias("place"), kind.alias("type"), F.concat(F.lit("role"), F.col("l_suppkey") % 4).alias("role"), url.alias("url"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _mirror(kind, roles):
    rank = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(roles))
    return f"first(url ORDER BY CASE role {rank} ELSE 9 END, place, url) FILTER (type = '{kind}' AND url IS NOT NULL) AS {kind}"


@query(f"WITH {RESOURCES} SELECT lesson, {', '.join(_mirror(k, v) for k, v in KINDS.items())} FROM r GROUP BY 1 HAVING count(url) > 0")
def media_mirror(spark, sf):
    rows = _resources(spark, sf)
    a, v, p = (C.preferred(rows, "lesson", k, roles) for k, roles in KINDS.items())
    return a.join(v, "lesson", "full").join(p, "lesson", "full")


@query(f"WITH {RESOURCES} SELECT lesson, type, min(place) AS place, arg_max(url, place) FILTER (url IS NOT NULL) AS url, arg_max(role, place) AS role FROM r GROUP BY 1, 2")
def resource_upserts(spark, sf):
    return C.merged_resources(_resources(spark, sf), "lesson", "type", "place", ("url", "role"), ("file", "row"))


@query(
    r"WITH b AS (SELECT o_orderkey AS row_, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'user' || o_custkey || CASE WHEN o_orderkey % 17 = 0 THEN '@host' ELSE '@host.org' END END AS email FROM orders), v AS (SELECT *, CASE WHEN email = '' THEN 'missing' WHEN NOT regexp_full_match(email, '[^@\s]+@[^@\s]+\.[^@\s]+') THEN 'format' END AS bad FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY email, bad IS NULL ORDER BY row_) AS n FROM v) "
    "SELECT row_, CASE WHEN bad IS NOT NULL THEN bad WHEN n > 1 THEN 'in_batch' WHEN email IN (SELECT 'user' || c_custkey || '@host.org' FROM customer WHERE c_acctbal < 0) THEN 'in_table' ELSE 'created' END AS state FROM w"
)
def account_import(spark, sf):
    host = F.when(F.col("o_orderkey") % 17 == 0, "@host").otherwise("@host.org")
    email = F.when(F.col("o_orderkey") % 23 == 0, "").otherwise(F.concat(F.lit("user"), "o_custkey", host))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_"), email.alias("given"))
    bad = F.when(F.coalesce("given", F.lit("")) == "", "missing").when(~C.is_email(F.col("given")), "format")
    rows = rows.withColumn("bad", bad).withColumn("email", F.when(F.col("bad").isNull(), F.col("given")))
    held = read(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("user"), "c_custkey", F.lit("@host.org")).alias("email"))
    found = C.batch_state(rows, held, "email", "row_")
    return found.select("row_", F.coalesce("bad", F.when(F.col("in_batch"), "in_batch").when(F.col("in_table"), "in_table").otherwise("created")).alias("state"))


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part WHERE p_size > 20), k AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size = 1) SELECT p_partkey AS row_, CASE WHEN lower(p_name) IN (FROM k) THEN 'in_table' WHEN n > 1 THEN 'in_batch' ELSE 'created' END AS state FROM p")
def question_import(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_size", F.lower("p_name").alias("key"))
    found = C.batch_state(part.filter("p_size > 20"), part.filter("p_size = 1").select("key"), "key", "p_partkey")
    return found.select(F.col("p_partkey").alias("row_"), F.when(F.col("in_table"), "in_table").when(F.col("in_batch"), "in_batch").otherwise("created").alias("state"))


@query("WITH r AS (SELECT l_suppkey AS lesson, l_linenumber AS par, l_orderkey AS o, l_partkey AS p, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) <= 3 AS near FROM lineitem), s AS (SELECT *, sum(near::INT) OVER (PARTITION BY lesson ORDER BY o, par, p, x) AS before FROM r) SELECT lesson, par, count(*) FILTER (near AND before <= 12) AS in_text, count(*) FILTER (NOT (near AND before <= 12)) AS gallery FROM s GROUP BY 1, 2")
def figure_density(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lesson"), F.col("l_linenumber").alias("par"), "l_orderkey", "l_partkey", "l_extendedprice")
    kept = C.within_density(rows, "lesson", "par", ["l_orderkey", "par", "l_partkey", "l_extendedprice"], 3, 12)
    return kept.groupBy("lesson", "par").agg(F.count_if("in_text").alias("in_text"), F.count_if(~F.col("in_text")).alias("gallery"))


LESSONS = "l AS (SELECT o_custkey AS book, o_orderkey AS id, (o_orderkey % 4 + 1)::INT AS size, least(o_orderkey % 4 + 1, o_orderkey % 7)::INT AS colons, o_totalprice::BIGINT // 1000 AS words FROM orders), b AS (SELECT book, row_number() OVER k AS place, sum(size) OVER k - size AS first, sum(size) OVER k - 1 AS last, size, colons, words FROM l WINDOW k AS (PARTITION BY book ORDER BY id))"


def _lessons(spark, sf):
    key = F.col("o_orderkey")
    by = Window.partitionBy("book").orderBy("id")
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("book"), key.alias("id"), (key % 4 + 1).cast("int").alias("size"), F.least(key % 4 + 1, key % 7).cast("int").alias("colons"), F.floor(F.round("o_totalprice") / 1000).alias("words"))
    end = F.sum("size").over(by)
    return rows.select("book", F.row_number().over(by).alias("place"), (end - F.col("size")).alias("first"), (end - 1).alias("last"), "colons", "words")


@query(f"WITH {LESSONS}, r AS (SELECT *, sum((colons <> size)::INT) OVER (PARTITION BY book ORDER BY place) AS run FROM b), m AS (SELECT *, sum(CASE WHEN colons = size THEN size - 1 ELSE colons END) OVER (PARTITION BY book, run ORDER BY place) AS moved, lead(place) OVER (PARTITION BY book ORDER BY place) IS NOT NULL AS more FROM r), n AS (SELECT *, CASE WHEN more THEN moved ELSE 0 END AS moves FROM m) SELECT book, place, (first - coalesce(lag(moves) OVER (PARTITION BY book ORDER BY place), 0))::BIGINT AS first, (last - moves)::BIGINT AS last FROM n")
def colon_borders(spark, sf):
    return C.shifted_borders(_lessons(spark, sf), "book")


@query()
def tiny_lessons(spark, sf):
    return C.merged_tiny(_lessons(spark, sf), "book", 120, 400)


@query()
def section_groups(spark, sf):
    return C.grouped_sections(_lessons(spark, sf).withColumnRenamed("words", "chars"), "book", 500, 300)


@query("WITH t AS (SELECT l_suppkey AS course, l_linenumber AS unit, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) AS topic FROM lineitem), g AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY topic DESC, unit) AS goes, dense_rank() OVER (PARTITION BY course ORDER BY unit) AS place FROM t), k AS (SELECT course, count(*) + count(DISTINCT unit) - 60 AS over_, count(DISTINCT unit) AS units FROM t GROUP BY 1) SELECT course, unit, count(*) AS topics FROM g JOIN k USING (course) WHERE (2 * units <= 60 OR place <= 30) AND (topic = 1 OR goes > over_) GROUP BY 1, 2")
def pruned_units(spark, sf):
    number = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey"))
    topics = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("course"), F.col("l_linenumber").alias("unit"), number.alias("topic"))
    return C.capped_units(topics, "course", 60).groupBy("course", "unit").agg(F.count("*").alias("topics"))


@query("WITH l AS (SELECT l_suppkey AS course, l_linenumber AS unit, l_partkey % 50 AS a, CASE WHEN l_orderkey % 3 > 0 THEN l_partkey % 50 + l_orderkey % 5 END AS z, l_quantity::BIGINT AS words FROM lineitem WHERE l_quantity > 10), u AS (SELECT course, unit, coalesce(min(a) FILTER (a <> 0), 0) AS start, coalesce(max(coalesce(nullif(z, 0), a)) FILTER (a <> 0), 0) AS \"end\", sum(words)::BIGINT AS words, count(*) AS lessons FROM l GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY course ORDER BY unit) AS number FROM u")
def course_totals(spark, sf):
    start = F.col("l_partkey") % 50
    end = F.when(F.col("l_orderkey") % 3 > 0, start + F.col("l_orderkey") % 5)
    rows = read(spark, sf, "lineitem").filter("l_quantity > 10")
    return C.plan_totals(rows.select(F.col("l_suppkey").alias("course"), F.col("l_linenumber").alias("unit"), start.alias("start"), end.alias("end"), F.col("l_quantity").cast("long").alias("words")), "course")


@query("WITH n AS (SELECT l_suppkey AS book, count(DISTINCT l_orderkey % 20) AS n FROM lineitem GROUP BY 1), h AS (SELECT l_suppkey AS book, l_quantity AS item, count(DISTINCT l_orderkey % 20) AS pages FROM lineitem GROUP BY 1, 2) SELECT book, item, pages FROM h JOIN n USING (book) WHERE n >= 4 AND pages > greatest(3, 0.3 * n)")
def repeated_images(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), (F.col("l_orderkey") % 20).alias("page"), F.col("l_quantity").alias("item"))
    return C.on_many_pages(rows, "book", "page", "item")


@query("SELECT lower(p_name) || '|' || array_to_string(list_sort([regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'), regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')]), '|') AS key, min(p_partkey) AS id, count(*) AS copies FROM part GROUP BY 1")
def question_keys(spark, sf):
    key = C.natural_key(F.col("p_name"), F.array("p_type", "p_brand"))
    return read(spark, sf, "part").groupBy(key.alias("key")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("copies"))


@query("SELECT n_nationkey AS branch, count(c_custkey) AS students FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'FURNITURE' GROUP BY 1")
def branch_students(spark, sf):
    counts = read(spark, sf, "customer").filter("c_mktsegment = 'FURNITURE'").groupBy(F.col("c_nationkey").alias("branch")).agg(F.count("*").alias("students"))
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("branch")).join(counts, "branch", "left").fillna(0, ["students"])


@query("SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(lower(c_name), '17') OR contains(lower(o_orderpriority), '17') OR o_orderkey = 17")
def sale_search(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.filter(C.matches("17", "c_name", "o_orderpriority", id_="o_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"))


@query(r"WITH u AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'http://placeholder.url' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN left(md5(url), 31) WHEN page_id % 2 = 0 THEN '{' || md5(url) || '}' ELSE 'urn:uuid:' || md5(url) END AS code FROM pages) SELECT page_id, coalesce(url <> 'http://placeholder.url' AND regexp_matches(url, '^https?://'), false) AS real, coalesce(page_id % 5 <> 0 AND url IS NOT NULL, false) AS uuid FROM u")
def format_checks(spark, sf):
    id_, url = F.col("page_id"), F.col("url")
    code = F.when(id_ % 5 == 0, F.substring(F.md5("url"), 1, 31)).when(id_ % 2 == 0, F.concat(F.lit("{"), F.md5("url"), F.lit("}"))).otherwise(F.concat(F.lit("urn:uuid:"), F.md5("url")))
    shown = F.when(id_ % 9 == 0, "http://placeholder.url").otherwise(url)
    return read(spark, sf, "pages").select("page_id", C.is_real_url(shown, "http://placeholder.url").alias("real"), C.is_uuid(code).alias("uuid"))


@query("WITH d AS (SELECT lang, length(p_text) AS n, CASE WHEN annex THEN 'annex' WHEN length(p_text) < 20 THEN 'short_text' END AS reason FROM (SELECT p_type AS lang, p_name AS p_text, p_size > 45 AS annex FROM part)) SELECT lang, count(*) FILTER (reason IS NULL) AS pending, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS chars, count(*) FILTER (reason = 'annex') AS annexes, count(*) FILTER (reason = 'short_text') AS short FROM d GROUP BY 1")
def pending_media(spark, sf):
    rows = read(spark, sf, "part").withColumn("reason", C.skip_reason(F.col("p_size") > 45, F.col("p_name"), 20))
    open_ = F.col("reason").isNull()
    return rows.groupBy(F.col("p_type").alias("lang")).agg(F.count_if(open_).alias("pending"), F.coalesce(F.sum(F.when(open_, F.length("p_name"))), F.lit(0)).alias("chars"), F.count_if(F.col("reason") == "annex").alias("annexes"), F.count_if(F.col("reason") == "short_text").alias("short"))
