"""Source divergence audit: how far the sources of a language differ in their terms, and the terms that mark each source.

Terms are counted within batches, then by Spark. Shares p and q are whole parts of a thousand million, smoothed by two
occurrences a term. Two sources are compared over all kept terms, but only the terms that one of them has are touched:
with the share of a term that a source has not as its baseline, the sum is that of the baselines, corrected by each
source's own terms (by how many have each share) and by the terms that both have. A source's leading terms come from a
radix select: histograms over ten bits of the value at a time find the value of the last rank asked for in every group
at once, then histograms over the first byte in which the tied terms differ part the ties, in UTF-8 order.

Defined cases: null text, lang and source count as ''; a text without terms still makes its group occur; repeated rows
count one by one; a very long text is counted whole; in a lang without kept terms all pairs have value 0 and there are no
terms; one source alone has no pairs; an empty table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small_batches, table
from .textkit import LOWER, parts, spelt, words

LEAST_DOCUMENTS, TOP = 10, 10
UNIT, PRIOR = 1_000_000_000, 2
BITS = 10
MAX_BROADCAST = 100_000  # groups; a state row is a few hundred bytes but for its two tied terms
SALTS = 64
#: Bytes outside terms: `[\x00-\x40\x5B-\x60\x7B-\x7F]`.
APART = np.zeros(256, bool)
APART[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

COUNTS = "lang string, source string, term string, c long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in COUNTS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source = (batch.column(i).dictionary_encode() for i in (1, 2))
        pair, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        langs = lang.dictionary.take(pa.array(pair // len(source.dictionary)))
        sources = source.dictionary.take(pa.array(pair % len(source.dictionary)))
        none = pa.array(np.zeros(len(pair), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(pair), pa.string()), none, none], names=names)
        for first, last, data, offsets in parts(batch.column(0), 4 << 20):
            data = LOWER[data]
            starts, ends, places = words(data, offsets, APART)
            if not len(starts):
                continue
            terms = spelt(data, starts, ends).dictionary_encode()
            size = len(terms.dictionary)
            row = np.repeat(np.arange(last - first), np.diff(places))
            cell, times = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)
            key, at = np.unique(group[first:last][cell // size] * size + cell % size, return_inverse=True)
            sums = np.bincount(at, times, len(key)).astype(np.int64)
            docs = np.bincount(at, minlength=len(key))
            of = pa.array(key // size)
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(sums), pa.array(docs)], names=names)


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows of COUNTS (occurrences c, documents docs) for every lang, source and term, and one with a null term for every lang and source."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]).mapInArrow(_counts, COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact; null in a lang without terms."""
    wide = "decimal(19,0)"
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast(wide)
    below = (total + PRIOR * terms).cast(wide)
    return F.when(terms > 0, 1 + F.call_function("div", above, F.when(terms > 0, below)))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group's state. A group may hold most rows: up to MAX_BROADCAST groups are broadcast, of more each is dealt in SALTS parts."""
    if state.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(state), keys)
    dealt = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("item", "value"), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "salt"]).drop("salt")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds how many first bytes lo and hi share."""
    for batch in batches:
        lo, hi = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lo", "hi"))
        same = [len(os.path.commonprefix([a.encode(), b.encode()])) for a, b in zip(lo, hi, strict=True)]
        yield batch.append_column("same", pa.array(same, pa.int32()))


def leading(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The rows (keys, item string, value long of 0 or more) of the k greatest values of each group, ties by item in UTF-8 order, with rank.

    rows should be cheap to read several times (a table). Every step is a histogram that combines before it is shuffled:
    at most 2^BITS counts a group for values, at most 257 for bytes. The state is one row a group.
    """
    top = rows.agg(F.max("value")).first()[0]
    if top is None:
        return rows.withColumn("rank", F.lit(0))
    shift = max(0, -(-int(top).bit_length() // BITS) - 1) * BITS
    down, up = Window.partitionBy(*keys).orderBy(F.desc("digit")), Window.partitionBy(*keys).orderBy("digit")
    live = rows.withColumn("need", F.lit(k).cast("long"))
    while True:
        counts = live.groupBy(*keys, "need", F.shiftright("value", shift).alias("digit")).agg(F.count("*").alias("n"))
        # Buckets from the top until they hold what is needed, or all of them: the last one goes on.
        before = counts.withColumn("before", F.sum("n").over(down) - F.col("n")).filter("before < need")
        state = table(before.groupBy(*keys).agg(F.min("digit").alias("prefix"), F.min_by(F.col("need") - F.col("before"), "digit").alias("need")), "radix")
        if shift == 0:
            break
        live = with_state(rows, state, keys).filter(F.shiftright("value", shift) == F.col("prefix"))
        shift -= BITS
    limit = state.withColumnRenamed("prefix", "limit")
    tied = with_state(rows, limit, keys).filter("value = limit")
    state = table(tied.groupBy(*keys, "limit", "need").agg(F.count("*").alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi")), "radix")
    is_open = F.expr("n > need and lo < hi")
    while not state.filter(is_open).isEmpty():
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
        parted = state.filter(is_open).mapInArrow(_common, f"{shape}, same int").drop("n")
        tied = with_state(rows, parted, keys).filter("value = limit and item between lo and hi")
        digit = F.substring(F.encode("item", "UTF-8"), F.col("same") + 1, F.lit(1))
        counts = tied.groupBy(*keys, "limit", "need", digit.alias("digit")).agg(F.count("*").alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi"))
        before = counts.withColumn("before", F.sum("n").over(up) - F.col("n")).filter("before < need")
        last = before.groupBy(*keys, "limit").agg(F.max_by(F.struct((F.col("need") - F.col("before")).alias("need"), "n", "lo", "hi"), "digit").alias("at")).select(*keys, "limit", "at.*")
        state = table(last.unionByName(state.filter(~is_open)), "radix")
    kept = with_state(rows, state.select(*keys, "limit", "hi"), keys).filter("value > limit or value = limit and item <= hi").drop("limit", "hi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= k)


def rates(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms), both written: groups has lang, source, terms (V), zero (share of a term it has not), one row a group that occurs;
    terms has lang, source, item, p, q (the lang's share), zero, one row a kept term and group that has it."""
    same = Window.partitionBy("lang", "term")
    counted = term_counts(docs).select("*", F.sum("docs").over(same).alias("all_docs"), F.sum("c").over(same).alias("lang_c"), (F.col("source") == F.min("source").over(same)).alias("once"))
    kept = table(counted.filter((F.col("all_docs") >= least) | F.col("term").isNull()).drop("docs", "all_docs"), "terms")
    langs = kept.groupBy("lang").agg(F.sum("c").alias("lang_n"), F.count_if(F.col("once") & F.col("term").isNotNull()).alias("terms"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = table(sizes.join(langs, "lang").withColumn("zero", share(F.lit(0).cast("long"), F.col("n"), F.col("terms"))), "groups")
    found = kept.filter("term is not null").select("lang", "source", F.col("term").alias("item"), F.col("c").alias("value"), "lang_c")
    found = with_state(found, groups, ["lang", "source"])
    p, q = share(F.col("value"), F.col("n"), F.col("terms")), share(F.col("lang_c"), F.col("lang_n"), F.col("terms"))
    return groups.select("lang", "source", "terms", "zero"), table(found.select("lang", "source", "item", p.alias("p"), q.alias("q"), "zero"), "rates")


def divergences(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value: the sum of gap() over all kept terms, for every ordered pair."""
    a, b = groups.alias("a"), groups.alias("b")
    v = {f"{s}_{c}": F.col(f"{s}.{c}") for s in "ab" for c in ("p", "zero")}
    of = [F.col("a.lang").alias("lang"), F.col("a.source").alias("a"), F.col("b.source").alias("b")]
    base = a.join(b, F.expr("a.lang = b.lang and a.source < b.source")).select(*of, F.coalesce(F.col("a.terms") * gap(v["a_zero"], v["b_zero"]), F.lit(0)).alias("value"))
    # How many of a source's terms have each share: terms of the same share correct a baseline alike.
    levels = terms.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times")).alias("a")
    own = levels.join(b, F.expr("a.lang = b.lang and a.source <> b.source")).select(
        of[0], F.least("a.source", "b.source").alias("a"), F.greatest("a.source", "b.source").alias("b"), (F.col("times") * (gap(v["a_p"], v["b_zero"]) - gap(v["a_zero"], v["b_zero"]))).alias("value")
    )
    slim = terms.select("lang", "item", "source", "p", "zero")
    both = slim.alias("a").join(slim.alias("b"), F.expr("a.lang = b.lang and a.item = b.item and a.source < b.source")).select(
        *of, (gap(v["a_p"], v["b_p"]) - gap(v["a_p"], v["b_zero"]) - gap(v["a_zero"], v["b_p"]) + gap(v["a_zero"], v["b_zero"])).alias("value")
    )
    parts_ = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (own, both)]
    sums = base.union(parts_[0]).union(parts_[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", sides.alias("side"), "value").select("lang", "side.source", "side.item", "value")


def marking_terms(terms: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the k terms by which each source stands out most from its lang."""
    return leading(table(terms.filter("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value")), "gaps"), ["lang", "source"], k)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, k: int = TOP) -> DataFrame:
    groups, terms = rates(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = divergences(groups, terms).withColumn("rank", F.row_number().over(order))
    shape = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(shape).union(marking_terms(terms, k).withColumn("part", F.lit("term")).select(shape))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), said AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS lang_c FROM said GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), langs AS (SELECT lang, sum(lang_c) AS lang_n, count(*) AS v FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT s.lang, s.source, s.term, count(*) AS c FROM said s JOIN kept k ON s.lang = k.lang AND s.term = k.term GROUP BY s.lang, s.source, s.term
), sizes AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), shares AS (
    SELECT z.lang, z.source, k.term, coalesce(c.c, 0) AS c,
           1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (z.n + 2 * l.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (k.lang_c + 2)) // (l.lang_n + 2 * l.v)::HUGEINT AS q
    FROM sizes z JOIN langs l ON z.lang = l.lang JOIN kept k ON z.lang = k.lang
    LEFT JOIN counts c ON z.lang = c.lang AND z.source = c.source AND k.term = c.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON a.lang = x.lang AND a.source = x.source AND b.source = x.item
), told AS (
    SELECT * FROM pairs UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
