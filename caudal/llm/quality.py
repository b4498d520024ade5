"""Quality rules: counting rules over the whole text, then a hashed n-gram log-likelihood ratio.

Two multinomials over BUCKETS hashed byte NGRAM-grams are counted: of trusted documents (all that are labelled of good
quality) and of the whole raw corpus. A document's score is the mean of log(p_target / p_raw) over its n-grams, so its
length cancels. One threshold, the cut that parts all labelled rows best, decides every document.

Counts are summed in slices of the bucket range over a tree of groups; the driver gets two arrays of BUCKETS. Labels are
broadcast up to BROADCAST_ROWS documents and joined by a shuffle beyond that; the cut is found over ranges of scores.

Defined cases: null text has no words and fails the base rule; a text under NGRAM bytes scores 0; a very long text is measured
whole, by itself; a score equal to the threshold is kept, and of equally good cuts the one in the widest gap is taken, of equal
gaps the lowest; without labels (or with labels of one kind) no document is rejected by the score; repeated rows are judged
alike (of labelled rows with one doc_id the least score sets the threshold); a null doc_id is judged like any other; an empty
table gives no rows; extra columns, whatever their names, are not read by `judge` and stay in `passing`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, table, tidied
from .textkit import distinct, mix, parts, ranges, shingles, span_hashes, words

NGRAM, BUCKETS, SLICES, SMOOTH = 4, 1 << 16, 16, 0.5
BROADCAST_ROWS = 4_000_000
MIN_WORDS, REPEAT_WORDS = 50, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _sums(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[places[1:]] - total[places[:-1]]


def _row_sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of each row's values, by themselves: a row's last digits do not depend on the rows beside it."""
    out = np.zeros(len(places) - 1)
    full = np.flatnonzero(places[1:] > places[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, places[full])
    return out


def line_counts(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """For each row the lines (split at \\n) that hold a word and equal an earlier line."""
    is_end = data == 10
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(is_end) + 1]))
    starts = starts[starts < len(data)]
    rows = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.flatnonzero(is_end)
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(np.concatenate([breaks, [len(data)]])[at], offsets[rows + 1])
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    places = np.searchsorted(rows[full], np.arange(len(offsets)))
    _, kept = distinct(span_hashes(data, starts[full], ends[full]), places)
    return np.diff(places) - np.diff(kept)


def repeated_words(hashes: np.ndarray, firsts: np.ndarray, width: int = 3) -> np.ndarray:
    """For each row the words that stand in a window of width words that occurs twice or more in the row."""
    counts = np.diff(firsts)
    windows, places = shingles(hashes, firsts, width)
    rows = np.repeat(np.arange(len(counts)), np.diff(places))
    keys = mix(windows ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.repeat(firsts[:-1] - places[:-1], np.diff(places)) + np.arange(len(keys))
    covered = np.zeros(len(hashes), bool)
    for j in range(width):
        covered[at[twice] + j] = True
    return _sums(covered, firsts)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each NGRAM-gram of bytes within a row, and where each row's begin."""
    sizes = np.maximum(np.diff(offsets) - NGRAM + 1, 0)
    places = np.concatenate([[0], np.cumsum(sizes)])
    if len(data) < NGRAM:
        return np.zeros(0, np.int64), places
    word = np.zeros(len(data) - NGRAM + 1, np.uint32)
    for j in range(NGRAM):
        word |= data[j : len(data) - NGRAM + 1 + j].astype(np.uint32) << np.uint32(8 * j)
    hashed = (word * np.uint32(2654435761)) >> np.uint32(16)
    return hashed[ranges(offsets[:-1], sizes)], places


def multinomials(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-gram buckets in all docs (good, text), and in the good ones."""
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in parts(batch.column(1)):
                grams, places = gram_buckets(data, offsets)
                raw += np.bincount(grams, minlength=BUCKETS)
                mine = np.repeat(good[a:b], np.diff(places))
                target += np.bincount(grams[mine], minlength=BUCKETS)
        salt = int(np.random.default_rng(int(raw[:64].sum())).integers(64))
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int32()), pa.array([x.tobytes() for x in raw.reshape(SLICES, width)], pa.binary()), pa.array([x.tobytes() for x in target.reshape(SLICES, width)], pa.binary())], ["slice", "salt", "raw", "target"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for r, t in zip(batch.column("raw").to_pylist(), batch.column("target").to_pylist(), strict=True):
                raw += np.frombuffer(r, np.int64)
                target += np.frombuffer(t, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], ["slice", "salt", "raw", "target"])

    shape = "slice int, salt int, raw binary, target binary"
    counted = docs.select("good", "text").mapInArrow(tidied(count), shape)
    summed = counted.groupBy("slice", "salt").applyInArrow(add, shape).groupBy("slice").applyInArrow(add, shape)
    raw, target = np.zeros((SLICES, width), np.int64), np.zeros((SLICES, width), np.int64)
    for row in summed.collect():
        raw[row.slice], target[row.slice] = np.frombuffer(row.raw, np.int64), np.frombuffer(row.target, np.int64)
    return raw.ravel(), target.ravel()


def weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, smoothed; zero where there is no target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = (target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS), (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.log(p / q)


def measured(column: pa.Array, ratios: np.ndarray) -> Iterator[tuple]:
    """(first row, end row, then the columns of FEATURES but doc_id) for ranges of rows."""
    for a, b, data, offsets in parts(column):
        starts, ends, firsts = words(data, offsets)
        grams, places = gram_buckets(data, offsets)
        inside = ((data & 0xC0) != 0x80) & ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
        score = np.round(_row_sums(ratios[grams], places) / np.maximum(np.diff(places), 1), 9)
        yield a, b, np.diff(firsts), _sums(inside, offsets), _sums(SYMBOLS[data], offsets), line_counts(data, offsets, starts), repeated_words(span_hashes(data, starts, ends), firsts), score


def features(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """FEATURES of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(zip(*(row[2:] for row in measured(batch.column(1), ratios)), strict=True))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in out)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), FEATURES)


def threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least sum of the good ones' share below it and the bad ones' share above; of equal ones the widest gap's middle.

    -inf without both kinds of labels.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    values, is_good = scores[order], good[order]
    lost = np.cumsum(is_good)[:-1] / is_good.sum() + 1 - np.cumsum(~is_good)[:-1] / (~is_good).sum()
    gaps = np.diff(values)
    lost = np.round(np.where(gaps > 0, lost, np.inf), 12)
    if not np.isfinite(lost).any():
        return -np.inf
    best = np.flatnonzero(lost == lost.min())
    at = best[np.argmax(gaps[best])]
    return round(float(values[at] + values[at + 1]) / 2, 9)


FAILED = f"n_words < {MIN_WORDS} OR n_repeat_words > {REPEAT_WORDS} * n_words"


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, quality (the least label) and good (a label is 1) of every labelled document."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return table(known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.col("quality") == 1).alias("good")), "labels")


def at_hand(known: DataFrame) -> DataFrame:
    """known, broadcast where it has BROADCAST_ROWS rows at most."""
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def learned(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """The log-ratio of each bucket, from all docs and all that are labelled good."""
    marked = docs.select("doc_id", "text").join(known.select("doc_id", "good"), "doc_id", "left")
    return weights(*multinomials(marked.select(F.coalesce("good", F.lit(False)).alias("good"), "text")))


def cut(found: DataFrame, known: DataFrame) -> float:
    """The threshold() for FEATURES rows, from all of them that are labelled.

    Scores are dealt in ranges; each sums its own rows, and only a row a range and the best cut meet in one place.
    """
    rows = found.filter(f"NOT ({FAILED})").join(known.select("doc_id", "quality"), "doc_id").groupBy("doc_id").agg(F.min("score").alias("score"), F.min("quality").alias("quality"))
    counted = rows.groupBy("score").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad"))
    dealt = table(counted.repartitionByRange("score").sortWithinPartitions("score").withColumn("range", F.spark_partition_id()), "scores")
    total = dealt.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total.good or not total.bad:
        return -np.inf
    by, inside = Window.orderBy("range"), Window.partitionBy("range").orderBy("score")
    sums = dealt.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("score").alias("from"))
    sums = sums.select("range", (F.sum("g").over(by) - F.col("g")).alias("g"), (F.sum("b").over(by) - F.col("b")).alias("b"), F.lead("from").over(by).alias("then"))
    placed = dealt.join(F.broadcast(sums), "range")
    lost = (F.sum("good").over(inside) + F.col("g")) / F.lit(total.good) + 1 - (F.sum("bad").over(inside) + F.col("b")) / F.lit(total.bad)
    cuts = placed.select("score", F.coalesce(F.lead("score").over(inside), "then").alias("next"), F.round(lost, 12).alias("lost")).filter("next IS NOT NULL")
    best = cuts.orderBy("lost", F.desc(F.col("next") - F.col("score")), "score").first()
    return round((best.score + best.next) / 2, 9) if best else -np.inf


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """FEATURES, base_failed and kept of every row of docs (doc_id, text). labels: doc_id, quality (1 is good)."""
    small_batches(spark)
    known = at_hand(labelled(labels))
    found = table(features(docs, learned(docs, known)), "quality")
    return found.withColumn("base_failed", F.expr(FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut(found, known))))


def passing(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are. Texts stay in their tasks: nothing is joined or shuffled but counts."""
    small_batches(spark)
    known = at_hand(labelled(labels))
    ratios = learned(docs, known)
    least = cut(features(docs.join(known.select("doc_id"), "doc_id", "left_semi"), ratios), known)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for a, b, n_words, _, _, _, repeated, score in measured(batch.column(at), ratios):
                kept[a:b] = (n_words >= MIN_WORDS) & (repeated <= REPEAT_WORDS * n_words) & (score >= least)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(tidied(run), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
