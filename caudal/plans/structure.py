"""Queries on texts and sequences, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from ..operators import structure as X
from ..sources.tables import read
from .catalogue import NORMAL, TERMS
from .registry import query

SPACED = "regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g')"


@query(f"SELECT doc_id, trim({SPACED.format('strip_accents(text)')}) AS plain, lower(trim({SPACED.format('strip_accents(text)')})) AS key, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9%$]+', ' ', 'g')) AS signs FROM documents")
def text_forms(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", T.collapsed(T.unmarked(text)).alias("plain"), T.canonical(text).alias("key"), T.with_signs(text, "%$").alias("signs"))


ROOT = "CASE WHEN term LIKE '%ciones' AND length(term) > 9 THEN term[:-7] WHEN term LIKE '%cion' AND length(term) > 7 THEN term[:-5] WHEN term LIKE '%mente' AND length(term) > 8 THEN term[:-6] WHEN term LIKE '%es' AND length(term) > 5 THEN term[:-3] WHEN term LIKE '%s' AND length(term) > 4 THEN term[:-2] ELSE term END"


@query(f"WITH {TERMS} SELECT root, sum(tf)::BIGINT AS tf, count(DISTINCT term) AS forms FROM (SELECT *, {ROOT} AS root FROM terms) GROUP BY 1")
def word_roots(spark, sf):
    terms = corpus.terms(read(spark, sf, "documents"), "doc_id")
    each = terms.groupBy(T.root(F.col("term")).alias("root"), "term").agg(F.sum("tf").alias("tf"))
    return each.groupBy("root").agg(F.sum("tf").alias("tf"), F.count("*").alias("forms"))


LINES = (
    "l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(\\w)-\\s*\\n\\s*(\\w)', '\\1\\2', 'g'), chr(10)), lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'))) AS x FROM documents)), "
    "c AS (SELECT *, length(regexp_replace(line, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{Lu}]', '', 'g')) AS capitals, len(regexp_extract_all(line, '[^ \\t\\n\\f\\r]+')) AS words, len(regexp_extract_all(line, '(?:^| )\\p{Lu}')) AS titled FROM l), "
    "h AS (SELECT doc_id, pos, line, line = '' AS blank, length(line) BETWEEN 1 AND 110 AND words BETWEEN 1 AND 14 AND NOT regexp_matches(line, '[.;,]$') AND letters > 0 AND (capitals > 0.55 * letters OR regexp_matches(line, '^[0-9]+(\\.[0-9]+)*\\s+') OR titled >= greatest(2, words // 2)) AS head FROM c), "
    "o AS (SELECT *, (head OR coalesce(lag(blank) OVER w, true) OR coalesce(lag(head) OVER w, true))::INT AS opens FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "p AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS place FROM o WHERE NOT blank), "
    "paras AS (SELECT doc_id, place, string_agg(line, ' ' ORDER BY pos) AS text, bool_or(head) AS head FROM p GROUP BY 1, 2)"
)


@query(f"WITH {LINES} SELECT * FROM paras")
def paragraphs(spark, sf):
    return X.paragraphs(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _paras(spark, sf):
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0))
    return X.paragraphs(read(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "place", words.alias("words"))


@query()
def lesson_blocks(spark, sf):
    return X.lessons(_paras(spark, sf), "doc_id", 120, 200)


MD = "'## Part ' || doc_id || chr(10) || '**Bold** and _soft_ {{figura:f' || doc_id % 5 || '}} [a link](http://x/' || doc_id || ') `code`' || chr(10) || '- ' || substring(text, 1, 60) || chr(10) || '{{ figura : g' || doc_id % 3 || ' }}' || chr(10) || '## End' || chr(10) || 'last words'"


@query(
    f"WITH m AS (SELECT doc_id, {MD} AS md FROM documents), s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '\\{{\\{{\\s*figura\\s*:\\s*([A-Za-z0-9_-]+)\\s*\\}}\\}}', '', 'g'), '`{{1,3}}[^`]*`{{1,3}}', '', 'g'), '(?m)^\\s{{0,3}}#{{1,6}}\\s*', '', 'g'), '(?m)^\\s{{0,3}}[-*+]\\s+', '', 'g'), '[*_]{{1,3}}([^*_]+)[*_]{{1,3}}', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM m) "
    "SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS plain, regexp_extract_all(md, '\\{\\{\\s*figura\\s*:\\s*([A-Za-z0-9_-]+)\\s*\\}\\}', 1) AS figures, 'last words' AS ending, contains(lower(md), 'bold and') OR contains(lower(md), 'the end') AS flagged FROM s"
)
def markdown_facts(spark, sf):
    key = F.col("doc_id").cast("string")
    md = F.concat(F.lit("## Part "), key, F.lit("\n**Bold** and _soft_ {{figura:f"), F.col("doc_id") % 5, F.lit("}} [a link](http://x/"), key, F.lit(") `code`\n- "), F.substring("text", 1, 60), F.lit("\n{{ figura : g"), F.col("doc_id") % 3, F.lit(" }}\n## End\nlast words"))
    rows = read(spark, sf, "documents").select("doc_id", md.alias("md"))
    banned = F.lower("md").contains("bold and") | F.lower("md").contains("the end")
    return rows.select("doc_id", T.unmarkdown(F.col("md")).alias("plain"), T.markers(F.col("md")).alias("figures"), T.section(F.col("md"), "End").alias("ending"), banned.alias("flagged"))


@query("WITH n AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 5 WHEN 0 THEN (l_partkey * 1000)::VARCHAR WHEN 1 THEN l_partkey || '.50' WHEN 2 THEN '00' || l_partkey || ',' WHEN 3 THEN '1.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') ELSE '0,' || l_partkey || '0' END AS token FROM lineitem) SELECT id, line, token, CASE line % 5 WHEN 0 THEN token WHEN 1 THEN CASE WHEN token = '0.50' THEN '0.5' ELSE rtrim(token, '0') END WHEN 2 THEN CASE WHEN ltrim(rtrim(token, ','), '0') = '' THEN '0' ELSE ltrim(rtrim(token, ','), '0') END WHEN 3 THEN replace(token, '.', '') ELSE CASE WHEN regexp_full_match(token, '0,\\d{3}') THEN CASE WHEN ltrim(replace(token, ',', ''), '0') = '' THEN '0' ELSE ltrim(replace(token, ',', ''), '0') END ELSE CASE WHEN rtrim(rtrim(replace(token, ',', '.'), '0'), '.') IN ('0', '') THEN '0' ELSE rtrim(replace(token, ',', '.'), '0') END END END AS core FROM n")
def number_cores(spark, sf):
    part, turn = F.col("l_partkey"), F.col("l_linenumber") % 5
    text = part.cast("string")
    token = F.when(turn == 0, (part * 1000).cast("string")).when(turn == 1, F.concat(text, F.lit(".50"))).when(turn == 2, F.concat(F.lit("00"), text, F.lit(","))).when(turn == 3, F.concat(F.lit("1."), F.lpad((part % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("0,"), text, F.lit("0")))
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), token.alias("token"))
    return rows.withColumn("core", T.number_core(F.col("token")))


@query("WITH c AS (SELECT DISTINCT l_orderkey AS id, l_quantity::INT::VARCHAR AS value, CASE WHEN l_linenumber % 2 = 0 THEN 'kg' ELSE 'm' END AS unit FROM lineitem WHERE l_quantity >= 1), s AS (SELECT l_orderkey AS id, l_quantity::INT::VARCHAR AS value, list_distinct(list(CASE WHEN l_suppkey % 2 = 0 THEN 'kg' ELSE 'm' END)) AS units FROM lineitem WHERE l_linenumber <> 3 AND l_quantity >= 1 GROUP BY 1, 2) SELECT id, value, unit, CASE WHEN units IS NULL THEN 'value' ELSE 'unit' END AS reason FROM c LEFT JOIN s USING (id, value) WHERE units IS NULL OR NOT list_contains(units, unit)")
def unsupported_figures(spark, sf):
    lines = read(spark, sf, "lineitem").filter("l_quantity >= 1")
    number = F.col("l_quantity").cast("int").cast("string")
    said = lambda unit: F.concat(F.lit("about "), number, F.lit(" "), unit, F.lit(" of it, not 7 days"))
    found = lambda rows, unit: rows.select(F.col("l_orderkey").alias("id"), F.inline(X.figures(said(unit), "kg|m")))
    claims = found(lines, F.when(F.col("l_linenumber") % 2 == 0, "kg").otherwise("m"))
    sources = found(lines.filter("l_linenumber <> 3"), F.when(F.col("l_suppkey") % 2 == 0, "kg").otherwise("m"))
    return X.unsupported(claims, sources, "id")


@query(f"WITH b AS (SELECT item_id, string_split({NORMAL}, ' ') AS w FROM benchmark), n AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS x FROM b, range(1, 3000, 4) r(i) WHERE i <= len(w) - 7), d AS (SELECT doc_id, string_split({NORMAL}, ' ') AS w FROM documents), m AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)) SELECT item_id, doc_id, count(*) AS windows FROM m JOIN n USING (x) GROUP BY 1, 2")
def needle_windows(spark, sf):
    return corpus.needles(read(spark, sf, "benchmark"), read(spark, sf, "documents"), "item_id", "doc_id")


ASKED = f"asked AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(string_split({NORMAL}, ' ')) AS term FROM benchmark) WHERE length(term) > 2 AND term NOT IN {T.STOP_WORDS} AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1, 2)"


@query(f"WITH {TERMS}, {ASKED}, i AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM terms GROUP BY 1), r AS (SELECT item_id, doc_id, sum(idf * least(asked.tf, 3)) AS raw FROM asked JOIN i USING (term) JOIN terms USING (term) GROUP BY 1, 2) SELECT item_id, doc_id, round(raw / max(raw) OVER (PARTITION BY item_id), 6) AS affinity FROM r")
def idf_affinity(spark, sf):
    return corpus.idf_affinity(read(spark, sf, "benchmark"), read(spark, sf, "documents"), "item_id", "doc_id")


GRAMS = "SELECT {id}, term, count(*) AS tf FROM (SELECT {id}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {id}, list_filter(string_split(" + NORMAL + ", ' '), lambda z: z <> '') AS w FROM {table})) GROUP BY 1, 2"


@query(
    f"WITH q AS ({GRAMS.format(id='item_id', table='benchmark')}), d AS ({GRAMS.format(id='doc_id', table='documents')}), n AS (SELECT (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents) AS n), i AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM (SELECT term FROM q UNION ALL SELECT term FROM d) GROUP BY 1), "
    "a AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM q JOIN i USING (term)), b AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS v FROM d JOIN i USING (term)), na AS (SELECT item_id, sqrt(sum(w * w)) AS x FROM a GROUP BY 1), nb AS (SELECT doc_id, sqrt(sum(v * v)) AS y FROM b GROUP BY 1), "
    "s AS (SELECT item_id, doc_id, round(sum(w * v) / (any_value(x) * any_value(y)), 6) AS score FROM a JOIN b USING (term) JOIN na USING (item_id) JOIN nb USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS p, max(score) OVER (PARTITION BY item_id) AS best FROM s) "
    "SELECT item_id, doc_id, score, best < 0.2 AS forced FROM r WHERE p <= 5 AND (score >= greatest(0.2, best * 0.75, best - 0.08) OR (p = 1 AND best < 0.2))"
)
def tfidf_matches(spark, sf):
    return corpus.tfidf_matches(read(spark, sf, "benchmark"), read(spark, sf, "documents"), "item_id", "doc_id")


RANGES = "r AS (SELECT o_custkey % 200 AS book, (o_orderkey * 7 % 60)::INT AS start, (o_orderkey * 7 % 60 + o_orderkey % 9 - 1)::INT AS \"end\", 64 AS size, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey * 7 % 60, o_orderkey) AS place FROM orders WHERE o_orderkey % 5 = 0)"


def _ranges(spark, sf):
    key = F.col("o_orderkey")
    start = key * 7 % 60
    rows = read(spark, sf, "orders").filter("o_orderkey % 5 = 0").select((F.col("o_custkey") % 200).alias("book"), start.cast("int").alias("start"), (start + key % 9 - 1).cast("int").alias("end"), F.lit(64).alias("size"), key.alias("id"))
    return rows.withColumn("place", F.row_number().over(X.Window.partitionBy("book").orderBy("start", "id"))).drop("id")


@query(f"WITH {RANGES}, v AS (SELECT book, start, least(\"end\", size - 1) AS e, size FROM r WHERE start >= 0 AND start <= \"end\"), k AS (SELECT *, coalesce(max(e) OVER (PARTITION BY book ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM v), f AS (SELECT * FROM k WHERE e > reach) SELECT book, reach + 1 AS start, CASE WHEN lead(start) OVER (PARTITION BY book ORDER BY start, e) IS NULL THEN size - 1 ELSE e END AS \"end\" FROM f")
def repaired_ranges(spark, sf):
    return X.repaired(_ranges(spark, sf).drop("place"), "book", "size")


@query(f"WITH {RANGES}, f AS (SELECT book, place, CASE WHEN start <> coalesce(lag(\"end\") OVER w + 1, 0) THEN 'gap' WHEN \"end\" < start OR \"end\" >= size THEN 'bad' WHEN lead(place) OVER w IS NULL AND \"end\" + 1 <> size THEN 'short' END AS fault FROM r WINDOW w AS (PARTITION BY book ORDER BY place)) SELECT book, arg_min(fault, place) AS fault, min(place)::INT AS place FROM f WHERE fault IS NOT NULL GROUP BY 1")
def range_errors(spark, sf):
    return X.range_errors(_ranges(spark, sf), "book", "size")


@query("WITH c AS (SELECT DISTINCT o_custkey AS book, (o_orderkey % 300)::INT AS start FROM orders) SELECT book, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start) - 1, 320)) AS \"end\" FROM c")
def chapter_ends(spark, sf):
    starts = read(spark, sf, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 300).cast("int").alias("start")).distinct()
    return X.chapter_ends(starts.withColumn("last", F.lit(320)), "book", "last")


@query("SELECT \"user\", id, name FROM (SELECT user_id AS \"user\", event_id AS id, event_type AS name, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE name IS DISTINCT FROM b")
def without_repeats(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    return X.without_repeats(rows, "user", "id", F.col("name"))


@query("SELECT source, doc_id, n::INT AS number, ((n - 1) // 25)::INT AS batch FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def fixed_batches(spark, sf):
    return X.batches(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 25)


@query("WITH e AS (SELECT conv_id, turn, text, split_part(text, ' ', 2) AS f FROM conversations), n AS (SELECT *, CASE WHEN f IS NULL OR f = '' THEN NULL ELSE (length(text) - length(replace(text, f, ''))) // length(f) END AS n FROM e) SELECT conv_id, turn, CASE WHEN n = 1 THEN replace(text, f, 'EDIT') ELSE text END AS text, CASE WHEN n = 1 THEN 'done' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM n")
def content_edits(spark, sf):
    word = F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.when(F.col("text").isNotNull(), ""))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "text", word.alias("f"), F.lit("EDIT").alias("new"))
    return X.replaced_once(rows, "text", "f", "new").select("conv_id", "turn", "text", "status")


@query("SELECT doc_id FROM documents ORDER BY sha256('7|' || doc_id) LIMIT 50")
def hash_sample(spark, sf):
    return X.sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 50, 7)


@query("SELECT source, arg_min(doc_id, sha256('7|' || doc_id)) AS doc_id FROM documents GROUP BY 1")
def one_variant_each(spark, sf):
    return X.one_each(read(spark, sf, "documents"), "source", "doc_id", 7)


@query("WITH c AS (SELECT l_orderkey AS id, l_suppkey % 4 AS choice, count(*) AS votes FROM lineitem GROUP BY 1, 2) SELECT id, choice, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, choice) AS n FROM c) WHERE n = 1")
def most_voted(spark, sf):
    return X.votes(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 4).alias("choice")), "id", "choice")


WORDSET = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"


@query(f"WITH b AS (SELECT item_id, {WORDSET.format(NORMAL)} AS x FROM benchmark), p AS (SELECT a.item_id, b.item_id AS other, round(CASE WHEN len(a.x) = 0 OR len(b.x) = 0 THEN 0 ELSE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) END, 6) AS overlap FROM b a JOIN b ON b.item_id = a.item_id + 1) SELECT * FROM p")
def neighbour_overlap(spark, sf):
    words = F.array_distinct(F.filter(F.split(T.normalised(F.col("text")), " "), lambda w: w != ""))
    items = read(spark, sf, "benchmark").select("item_id", words.alias("x"))
    others = items.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("x").alias("y"))
    return items.join(others, "item_id").select("item_id", "other", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("SELECT p_partkey AS id, [trim(p_name)] || list_filter([trim(p_brand), trim(p_type)], lambda s: lower(s) <> lower(trim(p_name))) AS names, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS k FROM part")
def clean_lists(spark, sf):
    names = F.filter(F.transform(F.array("p_name", F.upper("p_name"), "p_brand", F.concat("p_name", F.lit(" ")), "p_type"), lambda s: F.trim(s)), lambda s: s != "")
    # the first form of each name, whatever its case
    kept = F.aggregate(names, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda t: F.lower(t) == F.lower(s)), acc).otherwise(F.concat(acc, F.array(s))))
    said = F.concat(F.lit("Here it is:\n```json\n{\"k\": "), F.when(F.col("p_partkey") % 3 == 0, "null").otherwise(F.col("p_size").cast("string")), F.lit(", \"list\": [1, 2, ],}\n```"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), kept.alias("names"), F.get_json_object(T.json_object(said), "$.k").cast("int").alias("k"))


@query("WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents) SELECT doc_id, greatest(150, round_even(least(1200, greatest(250, round_even(w * 1.1::DOUBLE, 0))) * 0.6::DOUBLE, 0))::BIGINT AS least, least(1200, greatest(250, round_even(w * 1.1::DOUBLE, 0)))::BIGINT AS most, least(100, greatest(8, w // 50))::BIGINT AS lessons FROM w")
def lesson_targets(spark, sf):
    words = T.space_count(F.col("text"))
    most = F.least(F.lit(1200), F.greatest(F.lit(250), F.bround(words * F.lit(1.1)).cast("long")))
    return read(spark, sf, "documents").select("doc_id", F.greatest(F.lit(150), F.bround(most * F.lit(0.6)).cast("long")).alias("least"), most.cast("long").alias("most"), F.least(F.lit(100), F.greatest(F.lit(8), F.floor(words / 50))).cast("long").alias("lessons"))
