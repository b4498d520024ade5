"""Operators over many texts: word counts, keywords, repeated lines, weighted matching."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised, tokens
from .storage import written

#: Rows of a list (terms or windows of queries, one row a query) that are broadcast at most; longer ones are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Of tfidf_matches: terms of a block, bytes of text whose terms make a bucket, scores at once.
BLOCK, BUCKET, CELLS = 1 << 20, 8 << 20, 1 << 17


def lookup(rows: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """rows, broadcast if they (or `bound`, which has as many rows at least and is cheaper to count) are few."""
    counted = rows if bound is None else bound
    return F.broadcast(rows) if counted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else rows


def terms(docs: DataFrame, id_: str) -> DataFrame:
    """id, term, tf. Each text's words are counted in its own row's task before anything moves."""
    return docs.select(id_, F.explode(tokens(F.col("text"))).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("tf"))


def keywords(docs: DataFrame, id_: str, n: int) -> DataFrame:
    """The n commonest terms of each text, ties by what comes first in it. Texts that share an id count as one.

    A text of its own id is counted in its own row, so that nothing but the ids moves; only texts that share an id meet by a shuffle.
    """
    shared = docs.groupBy(F.col(id_).alias("_id")).agg(F.count("*").alias("_rows")).filter("_rows > 1").select("_id")
    rows = docs.select(id_, tokens(F.col("text")).alias("words"))
    if shared.isEmpty():
        return _own_keywords(rows, id_, n)
    same = F.col(id_).eqNullSafe(F.col("_id"))
    placed = rows.join(shared, same, "left_semi").select(id_, F.posexplode("words").alias("pos", "term")).groupBy(id_, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    by = Window.partitionBy(id_).orderBy(F.desc("tf"), "first")
    together = placed.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n).drop("first")
    return _own_keywords(rows.join(shared, same, "left_anti"), id_, n).unionByName(together)


def _own_keywords(rows: DataFrame, id_: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms_, counts, places = [], [], [], []
            for row, words in enumerate(batch.column(1).to_pylist()):
                # a Counter keeps the order of first places, and so does the sort
                for place, (term, tf) in enumerate(Counter(words or ()).most_common(n), 1):
                    at.append(row), terms_.append(term), counts.append(tf), places.append(place)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms_, pa.string()), pa.array(counts, pa.int64()), pa.array(places, pa.int32())], [id_, "term", "tf", "place"])

    return rows.mapInArrow(run, f"{id_} {rows.schema[id_].dataType.simpleString()}, term string, tf long, place int")


def repeated_lines(docs: DataFrame, group: str, id_: str, least: int = 3, parts: int = 3) -> DataFrame:
    """Lines that at least max(least, one in parts) of a group's documents hold."""
    lines = docs.select(group, id_, F.explode(F.split("text", "\n")).alias("raw")).select(group, id_, F.trim("raw").alias("line")).filter("line <> ''")
    held = lines.groupBy(group, "line").agg(F.countDistinct(id_).alias("docs"))
    total = docs.groupBy(group).agg(F.count("*").alias("total"))
    return held.filter(F.col("docs") >= least).join(total, group).filter(F.col("docs") * parts >= F.col("total")).drop("total")


def shared_terms(topics: DataFrame, docs: DataFrame, topic_id: str, doc_id: str, most_docs: float) -> DataFrame:
    """Share of a topic's distinct terms that a document holds; terms in more than that share of the documents don't count."""
    # Only the topics' own terms are counted and moved; Spark broadcasts their list where it is small.
    asked = terms(topics, topic_id).select(topic_id, "term")
    held = docs.select(doc_id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").select(doc_id, "term")
    often = held.groupBy("term").agg(F.count("*").alias("df"))
    common = often.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).filter(F.col("df") > F.col("n") * most_docs).select("term")
    # a term that no document holds is no anchor either
    mine = asked.join(often.select("term"), "term", "left_semi").join(common, "term", "left_anti")
    size = mine.groupBy(topic_id).agg(F.count("*").alias("terms"))
    return held.join(mine, "term").groupBy(topic_id, doc_id).agg(F.count("*").alias("common")).join(size, topic_id).withColumn("share", F.round(F.col("common") / F.col("terms"), 4))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def coverage(topics: DataFrame, shares: DataFrame, topic_id: str, solid: float) -> DataFrame:
    """topic, best share and class: solid, weak or uncovered."""
    best = topics.select(topic_id).join(shares.groupBy(topic_id).agg(F.max("share").alias("best")), topic_id, "left")
    return best.withColumn("coverage", F.when(F.col("best") >= solid, "solid").when(F.col("best") > 0, "weak").otherwise("uncovered"))


def short_of_median(rows: DataFrame, group: str, size: str, share: float) -> DataFrame:
    """rows with `visual` for those whose size is under that share of their group's median, else `text`; equal sizes combine before the shuffle."""
    middle = rows.groupBy(group).agg(F.percentile(size, F.lit(0.5)).alias("middle"))
    return rows.join(middle, group).withColumn("kind", F.when(F.col(size) < share * F.col("middle"), "visual").otherwise("text")).drop("middle")


def _best_of(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, n: int) -> DataFrame:
    """query_id, vec_id, score: of each task's vectors the n most like each asked one, by score to six places and id; unrounded."""
    unit = np.sqrt((asked * asked).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query (its place), vec_id, score
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vec = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(vec), -1)
                norm = np.sqrt((x * x).sum(1))
                found = [best]
                for q in range(0, len(ids), 256):
                    scores = (asked[q : q + 256] @ x.T) / (unit[q : q + 256, None] * norm)
                    scores[ids[q : q + 256, None] == vec] = -np.inf
                    rounded = np.round(scores, 6)
                    least = np.partition(rounded, -n, axis=1)[:, -n, None] if len(vec) > n else -np.inf
                    row, column = np.nonzero((rounded >= least) & (rounded > -np.inf))
                    found.append([row + q, vec[column], scores[row, column]])
                query, vecs, scores = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((vecs, -np.round(scores, 6), query))
                query = query[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                best = [query[place < n], vecs[order][place < n], scores[order][place < n]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, asked: DataFrame, n: int, block: int = 4096) -> DataFrame:
    """query_id, vec_id, score: the n vectors (vec_id, embedding) most like each asked one (query_id, asked), itself left out.

    The queries go over all vectors in blocks of bounded size. Each task multiplies its vectors with a block and keeps n rows a query, so
    that a query's rows over the shuffle are n times the tasks. Vectors without the commonest length, with nulls, entries that are not
    finite or zeros alone are compared one by one, as are vectors and queries without an id.
    """
    kind, asked_kind = vectors.schema["vec_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    size = asked.filter("asked IS NOT NULL").groupBy(F.size("asked").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = size["size"] if size else 0
    def plain(c, id_):  # noqa: E306
        finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return F.coalesce(F.col(id_).isNotNull() & (F.size(c) == size) & finite & F.exists(c, lambda v: v != 0), F.lit(False))

    known, queries = plain("embedding", "vec_id"), plain("asked", "query_id")
    found = None
    ids = [r.query_id for r in asked.filter(queries).select("query_id").distinct().orderBy("query_id").collect()]
    for at in range(0, len(ids), block):
        rows = asked.filter(queries & F.col("query_id").isin(ids[at : at + block])).dropDuplicates(["query_id"]).orderBy("query_id").toArrow()
        some = rows.column("asked").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, -1)
        best = _best_of(vectors.filter(known), rows.column("query_id").to_numpy().astype(np.int64), some, n)
        found = best if found is None else found.unionByName(best)
    odd = vectors.filter(~known).join(F.broadcast(asked), F.col("vec_id") != F.col("query_id")).unionByName(vectors.filter(known).join(F.broadcast(asked.filter(~queries)), F.col("vec_id") != F.col("query_id")))
    odd = odd.select(F.col("query_id").cast("long"), F.col("vec_id").cast("long"), cosine(F.col("embedding"), F.col("asked")).alias("score"))
    found = odd if found is None else found.unionByName(odd)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kept = found.withColumn("score", F.round("score", 6)).withColumn("place", place).filter(F.col("place") <= n)
    return kept.select(F.col("query_id").cast(asked_kind), F.col("vec_id").cast(kind), "score")


def idf_affinity(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, tf_most: int = 3) -> DataFrame:
    """query, doc, affinity: sum over shared terms of ln(1 + N / df) times the query's count (with a cap), by each query's best document."""
    # What queries ask for is broadcast where it is short, so that only sums by query and document move.
    asked = written(terms(queries, query_id), "asked")
    sought = lookup(asked.select("term").distinct(), asked)
    held = docs.select(doc_id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(sought, "term", "left_semi").select(doc_id, "term")
    n = docs.agg(F.count("*").alias("n"))
    idf = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    weights = asked.join(idf, "term").select(query_id, "term", (F.col("idf") * F.least("tf", F.lit(tf_most))).alias("w"))
    raw = held.join(lookup(weights, asked), "term").groupBy(query_id, doc_id).agg(F.sum("w").alias("raw"))
    best = raw.groupBy(query_id).agg(F.max("raw").alias("best"))
    return raw.join(lookup(best, queries), query_id).select(query_id, doc_id, F.round(F.col("raw") / F.col("best"), 6).alias("affinity"))


def grams(rows: DataFrame, id_: str) -> DataFrame:
    """id, terms: the hash of each word and each pair of neighbouring words of the normalised text, as often as it is there."""
    words = F.coalesce(F.filter(F.split(normalised(F.col("text")), " "), lambda w: w != ""), F.array().cast("array<string>"))
    pairs = F.filter(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda t: t.isNotNull())
    return rows.select(id_, words.alias("w")).select(id_, F.transform(F.concat("w", pairs), lambda t: F.xxhash64(t)).alias("terms"))


def _of_each(rows: DataFrame, id_: str) -> DataFrame:
    """id, terms: the hashes of a text's terms; texts that share an id count as one. Where there are any, the other texts are written once."""
    shared = rows.groupBy(F.col(id_).alias("_id")).agg(F.count("*").alias("_rows")).filter("_rows > 1").select("_id")
    if shared.isEmpty():
        return grams(rows, id_)
    # both parts are written, since what a shuffle gives may come in another order when it is read again
    same = F.col(id_).eqNullSafe(F.col("_id"))
    apart = written(rows.select(id_, "text").join(shared, same, "left_anti"), "apart")
    together = grams(rows.join(shared, same, "left_semi"), id_).groupBy(id_).agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return grams(apart, id_).unionByName(written(together, "together"))


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 by the first, second, ... byte of all of them, compressed: the high bytes of small ones take no room."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _values(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising[:1] * 0)


def _blocks(told, side: int):
    """Calls told(block, ids, hashes, counts, rows, codes, tf) for each block of a task's rows (id, terms).

    hashes are the block's distinct ones, rising, and counts how many rows have each; rows, codes (places in hashes) and tf tell each
    row's distinct terms. A block is named by the task's partition, its number there, a sum of its hashes and its side, so that one made
    of other rows has another name.
    """

    def made(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        table = pa.Table.from_batches(held).combine_chunks()
        ids, terms_ = (table.column(c).combine_chunks() for c in (0, 1))
        sizes = pc.list_value_length(terms_).to_numpy(zero_copy_only=False)
        hashes, codes = np.unique(terms_.flatten().to_numpy().view(np.uint64), return_inverse=True)
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(hashes), 1) + codes, return_counts=True)
        rows, codes = np.divmod(pairs, max(len(hashes), 1))
        name = TaskContext.get().partitionId() << 40 | number << 28 | zlib.crc32(hashes.tobytes()) >> 4
        return told(2 * name + side, ids, hashes, np.bincount(codes, minlength=len(hashes)), rows, codes, tf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0
        for batch in batches:
            flat = batch.column(1)
            ends = flat.offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK - size, "right")) - 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[min(to, batch.num_rows)] - ends[at])
                at = to
                if size >= BLOCK or at < batch.num_rows:
                    yield made(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield made(held, number)

    return run


def _told_terms(buckets: int):
    """A block's distinct terms by ranges of their hashes: bucket, block, hashes, counts."""

    def told(block, ids, hashes, counts, rows, codes, tf):
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        there, first = np.unique(bucket, return_index=True)
        ends = [*first[1:], len(hashes)]
        packed = [[_planes(x(i, j)) for i, j in zip(first, ends, strict=True)] for x in (lambda i, j: _steps(hashes[i:j]), lambda i, j: counts[i:j])] if len(there) else [[], []]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(np.full(len(there), block), pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["bucket", "block", "hashes", "counts"])

    return told


def _told_texts(block, ids, hashes, counts, rows, codes, tf):
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    # within a row the codes rise, so that their steps are small; a row begins anew
    sizes = np.bincount(rows, minlength=len(ids.values))
    first = np.diff(rows, prepend=-1) != 0
    steps = np.where(first, codes, np.diff(codes, prepend=0)) if len(codes) else codes
    return pa.RecordBatch.from_arrays([pa.array([block]), ids, *(pa.array([_planes(x)], pa.binary()) for x in (sizes, steps, tf)), pa.array([len(hashes)])], names=["block", "ids", "sizes", "steps", "tf", "known"])


def _counted(texts: pa.Table, queries: pa.Table) -> pa.Table:
    """Of a bucket's rows (block, hashes, counts) of both sides each block's answer: twice the rows of all blocks that have each term, and one more if a query has it; and the hashes of these."""
    told = pa.concat_tables([texts, queries])
    hashes = [np.cumsum(_values(x), dtype=np.uint64) for x in told.column("hashes").to_pylist()]
    blocks = told.column("block").to_numpy()
    counts = np.concatenate([_values(x) for x in told.column("counts").to_pylist()]).astype(np.float64)
    sizes = np.array([len(x) for x in hashes])
    every = np.concatenate(hashes)
    _, place = np.unique(every, return_inverse=True)
    held, asked = np.bincount(place, counts), np.bincount(place, np.repeat(blocks & 1, sizes)) > 0
    answers = (2 * held.astype(np.int64) + asked)[place]
    spans = [slice(b - n, b) for b, n in zip(np.cumsum(sizes), sizes, strict=True)]
    terms_ = pa.array([every[x][(answers[x] & 1) > 0].view(np.int64) for x in spans], pa.list_(pa.int64()))
    return pa.table({"block": blocks, "bucket": told.column("bucket"), "answers": pa.array([_planes(answers[x]) for x in spans], pa.binary()), "terms": terms_})


def _weighed(total: int):
    """Of a block (_told_texts) and its answers: each row's norm, and of the terms that queries have the hashes, and the rows, terms (places in these hashes) and weights."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        answers = [_values(x) for x in found.column("answers").to_pylist()]
        answers = np.concatenate(answers).astype(np.int64) if answers else np.zeros(0, np.int64)
        if texts.num_rows != 1 or texts.column("known")[0].as_py() != len(answers):
            raise ValueError("texts came in another order when they were read again; write them as a table first")
        sizes, steps, tf = (_values(texts.column(c)[0].as_py()).astype(np.int64) for c in ("sizes", "steps", "tf"))
        rows, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        sums = np.concatenate([[0], np.cumsum(steps)])
        codes = sums[1:] - np.repeat(sums[starts], sizes)
        w = (1 + np.log(tf)) * (np.log((1 + total) / (1 + (answers >> 1))) + 1)[codes]
        on = np.flatnonzero(answers[codes] & 1)
        hashes = found.column("terms").combine_chunks().flatten().to_numpy()
        whole = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({"block": texts.column("block"), "ids": texts.column("ids"), "norms": whole(np.sqrt(np.bincount(rows, w * w, len(sizes))), pa.float64()), "hashes": whole(hashes, pa.int64()), "at": whole(rows[on], pa.int32()), "term": whole(np.searchsorted(np.flatnonzero(answers & 1), codes[on]), pa.int32()), "w": whole(w[on], pa.float64())})

    return run


def _best_pairs(query_id: str, doc_id: str, n: int):
    """Of pairs of a block of queries (q_ columns of _weighed) and a block of texts: of each query the n best texts by score to six places and id; unrounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                take = lambda c, k=k, batch=batch: batch.column(c)[k].values
                q_ids, ids = take("q_ids"), take("ids")
                number = lambda c, take=take: take(c).to_numpy()
                # the queries' entries by term, and for each of the texts' entries those of its term
                _, q_place, place = np.intersect1d(number("q_hashes"), number("hashes"), assume_unique=True, return_indices=True)
                as_q = np.full(len(number("hashes")) + 1, -1)
                as_q[place] = q_place
                order = np.argsort(number("q_term"), kind="stable")
                q_at, q_w = number("q_at")[order], number("q_w")[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(number("q_term"), minlength=len(number("q_hashes"))))])
                at, term, w = number("at"), as_q[number("term")], number("w")
                met = np.flatnonzero(term >= 0)
                at, term, w = at[met], term[met], w[met]
                sizes = ends[term + 1] - ends[term]
                best = []
                step = max(1, CELLS // max(len(q_ids), 1))
                for a in range(0, len(ids), step):
                    i, j = np.searchsorted(at, [a, a + step])
                    count = sizes[i:j]
                    with_ = np.arange(count.sum()) + np.repeat(ends[term[i:j]] - (np.cumsum(count) - count), count)
                    rows = min(step, len(ids) - a)
                    cell = q_at[with_].astype(np.int64) * rows + np.repeat(at[i:j] - a, count)
                    dots = np.bincount(cell, np.repeat(w[i:j], count) * q_w[with_], len(q_ids) * rows).reshape(len(q_ids), rows)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        scores = np.where(dots > 0, dots / (number("q_norms")[:, None] * number("norms")[None, a : a + rows]), -1.0)
                    rounded = np.round(scores, 6)
                    least = np.partition(rounded, -n, axis=1)[:, -n, None] if rows > n else np.full((len(q_ids), 1), -1.0)
                    q, d = np.nonzero((rounded >= least) & (scores >= 0))
                    found = pa.table({"q": q, "d": d + a, "score": scores[q, d], "order": -rounded[q, d], "id": ids.take(pa.array(d + a))}).sort_by([("q", "ascending"), ("order", "ascending"), ("id", "ascending")])
                    q = found.column("q").to_numpy()
                    best.append(found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < n)))
                for found in best:
                    for part in found.combine_chunks().to_batches():
                        yield pa.RecordBatch.from_arrays([q_ids.take(part.column("q")), part.column("id"), part.column("score")], [query_id, doc_id, "score"])

    return run


def tfidf_matches(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, least: float = 0.2, near: float = 0.75, below: float = 0.08, n: int = 5) -> DataFrame:
    """query, doc, score, forced: the best documents by cosine of TF-IDF vectors (1 + ln tf, idf smoothed and fitted on both sides).

    Kept are scores of `least` and more that are near the best one (near times it, and no more than `below` under it); where none is,
    the best document alone, marked as forced.

    Each task's texts make blocks. Only a block's distinct terms move, as 64-bit hashes, to where all blocks' rows are counted by ranges
    of hashes, and the counts go back to the blocks, whose texts are kept as places in these terms: a term is moved once a block, not once
    a text. Blocks of texts then meet those of queries, and each pair keeps n texts a query. Terms of one hash would count as one: with
    T distinct ones any two have with a chance of T * T / 2 ** 65. The texts are read twice and must come in the same order (a table does).
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # a worker holds a batch and a block
    sides = [(0, docs, doc_id), (1, queries, query_id)]
    size = [side.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first() for _, side, _ in sides]
    total, buckets = sum(x[0] for x in size), 1 + sum(x[1] for x in size) // BUCKET
    each = {side: _of_each(rows, id_) for side, rows, id_ in sides}
    asked = [rows.mapInArrow(_blocks(_told_terms(buckets), side), "bucket long, block long, hashes binary, counts binary") for side, rows in each.items()]
    answers = written(asked[0].groupBy("bucket").cogroup(asked[1].groupBy("bucket")).applyInArrow(_counted, "block long, bucket long, answers binary, terms array<long>"), "answers")

    def weighed(side: int, id_: str) -> DataFrame:
        kind = docs.schema[id_].dataType.simpleString() if side == 0 else queries.schema[id_].dataType.simpleString()
        texts = each[side].mapInArrow(_blocks(_told_texts, side), f"block long, ids array<{kind}>, sizes binary, steps binary, tf binary, known long")
        mine = answers.filter(F.col("block").bitwiseAND(F.lit(1)) == side)
        return texts.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_weighed(total), f"block long, ids array<{kind}>, norms array<double>, hashes array<long>, at array<int>, term array<int>, w array<double>").drop("block")

    asking = weighed(1, query_id)
    asking = lookup(written(asking.select(*(F.col(c).alias(f"q_{c}") for c in asking.columns)), "asking"), queries)
    shape = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double"
    pairs = weighed(0, doc_id).crossJoin(asking).mapInArrow(_best_pairs(query_id, doc_id, n), shape)
    scores = pairs.filter(F.col(query_id).isNotNull() & F.col(doc_id).isNotNull()).withColumn("score", F.round("score", 6))
    by = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    ranked = scores.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n)
    first = ranked.groupBy(query_id).agg(F.max("score").alias("best"))
    floor = F.greatest(F.lit(least), F.col("best") * near, F.col("best") - below)
    chosen = ranked.join(first, query_id).filter((F.col("score") >= floor) | ((F.col("place") == 1) & (F.col("best") < least)))
    return chosen.select(query_id, doc_id, "score", (F.col("best") < least).alias("forced"))


def needles(needle_texts: DataFrame, docs: DataFrame, needle_id: str, doc_id: str, width: int = 8, step: int = 4) -> DataFrame:
    """needle, doc, windows: how many of a text's windows of so many words, each so many words on, a document holds: an equal join on hashes."""
    def windows(rows: DataFrame, id_: str, every: int) -> DataFrame:
        words = rows.select(id_, F.filter(F.split(normalised(F.col("text")), " "), lambda w: w != "").alias("w"))
        starts = F.when(F.size("w") >= width, F.sequence(F.lit(1), F.size("w") - width + 1, F.lit(every))).otherwise(F.array().cast("array<int>"))
        return words.select(id_, F.explode(F.transform(starts, lambda s: F.xxhash64(F.array_join(F.slice("w", s, F.lit(width)), " ")))).alias("window"))

    # Only windows that a needle has go on, and of these each one of a document once.
    asked = written(windows(needle_texts, needle_id, step).distinct(), "needles")
    met = windows(docs, doc_id, 1).join(lookup(asked), "window").select(needle_id, doc_id, "window").distinct()
    return met.groupBy(needle_id, doc_id).agg(F.count("*").alias("windows"))
