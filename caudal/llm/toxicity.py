"""Toxicity classifier: hashed word embeddings, convolutions of several widths, max pooling, trained in numpy.

A word is a run of letters (or bytes over 127), A-Z lower-cased. Its embedding is the sum of three rows of one
table of BUCKETS rows, found by hashes of the word and of its first PREFIXES bytes, so that inflected forms meet.
Filters of each width slide over the whole text; ReLU and the maximum over all places give one number per
filter, and a logistic layer the score. For scoring, each filter's part for each bucket is tabled, so a text
costs a few table look-ups per word.

The model is fitted on all labelled rows whose crc32(doc_id as text) mod 5 is not 0. They are dealt in shards of about SHARD_ROWS rows;
in each epoch every shard moves the common model on over its own rows, and the next epoch starts from the mean of the shards' models,
weighted by rows. The driver gets sums and models only, no texts. Labels, lang, source and doc_id never enter a
score. Thresholds by language give the operator's own verdict `flagged`; they are set where a second model, fitted without one row
in CALIBRATION of them, parts those rows best; scores have six decimals, so what a language's cut looks through is bounded.

Defined cases: a null or empty text, or one without letters, gets the score of no evidence; a very long text is scored
whole; of rows with one doc_id the first by label and text hash is trained on; equal scores share a side of a threshold; without labels of
both kinds all scores are the base rate; a text shorter than a filter is padded with nothing and skips that
filter; unknown or null languages use the overall threshold; repeated rows score alike; an empty table gives no
rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, table, tidied
from .textkit import LOWER, mix, parts, span_hashes, words

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 15, 8, 6, (1, 2, 3)
SHARD_ROWS, CALIBRATION, EPOCHS, BATCH, RATE = 16384, 8, 4, 64, 0.03
BLOCKS, MAX_BROADCAST = 64, 500_000
PRIOR, FLOOR, PREFIXES = 12, 1.0, (4, 6)
LETTERS = np.full(256, 0x20, np.uint8)
for _c in (*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)):
    LETTERS[_c] = LOWER[_c]


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + len(PREFIXES)) buckets of each word and of its first bytes, and where each row's words begin (n + 1 places)."""
    plain = LETTERS[data]
    starts, ends, firsts = words(plain, offsets)
    spans = [span_hashes(plain, starts, ends)] + [mix(span_hashes(plain, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in PREFIXES]
    return np.stack([(h >> np.uint64(49)).astype(np.int32) for h in spans], axis=1), firsts


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIMS, FILTERS)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    intercept: float

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [(self.embedding @ self.filters[w][o]).astype(np.float32) for o in range(w)] for w in WIDTHS}

    def pooled(self, buckets: np.ndarray, firsts: np.ndarray, tables: dict[int, list[np.ndarray]] | None, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(rows, filters) maxima after ReLU, and for training the first word of each maximum's window (-1 if none).

        Without tables the parts of the filters are worked out for these words alone.
        """
        counts = np.diff(firsts)
        sums = None if tables else sum(self.embedding[buckets[:, c]] for c in range(buckets.shape[1])).astype(np.float32)
        values = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        at = np.full(values.shape, -1, np.int64) if places else None
        for k, w in enumerate(WIDTHS):
            rows = np.flatnonzero(counts >= w)
            if not len(rows):
                continue
            n = len(buckets) - w + 1
            raw = np.zeros((n, FILTERS), np.float32)
            for o in range(w):
                if tables is None:
                    raw += sums[o : n + o] @ self.filters[w][o].astype(np.float32)
                    continue
                for c in range(buckets.shape[1]):
                    raw += tables[w][o][buckets[o : n + o, c]]
            if w > 1:  # windows that run into the next row, those of shorter rows too
                over = (firsts[1:][:, None] - np.arange(1, w)).ravel()
                raw[over[(over >= 0) & (over < n)]] = -np.inf
            best = np.maximum.reduceat(raw, firsts[:-1][rows], axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            values[rows, cols] = np.maximum(best + self.biases[w].astype(np.float32), 0)
            if places:
                for r, row in enumerate(rows):
                    at[row, cols] = firsts[row] + np.argmax(raw[firsts[row] : firsts[row + 1]], axis=0)
        return values, at

    def scores(self, buckets: np.ndarray, firsts: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        values, _ = self.pooled(buckets, firsts, tables)
        return 1 / (1 + np.exp(-np.clip(values.astype(float) @ self.out + self.intercept, -40, 40)))


def begun(seen: np.ndarray, toxic: int, rows: int, seed: int = 7) -> tuple[Model, dict, bool]:
    """(model, sums of squared slopes, whether there are labels of both kinds) before training. seen: (2, BUCKETS) texts of either label that hold a bucket."""
    rng = np.random.default_rng(seed)
    base = toxic / rows if rows else 0.0
    rate = min(max(base, 1e-3), 1 - 1e-3)
    model = Model(rng.normal(0, 0.02, (BUCKETS, DIMS)), {w: rng.normal(0, 0.2, (w, DIMS, FILTERS)) for w in WIDTHS}, {w: np.full(FILTERS, -0.2) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS)), float(np.log(rate / (1 - rate))))
    past = {"e": np.full((BUCKETS, DIMS), 0.1), "o": np.full(len(model.out), 0.1), "i": np.float64(0.1)} | {("f", w): np.full(model.filters[w].shape, 0.1) for w in WIDTHS} | {("b", w): np.full(FILTERS, 0.1) for w in WIDTHS}
    if not 0 < toxic < rows:
        return model, past, False
    # The first dimension starts at each word's log-odds over the training rows, shrunk by PRIOR rows at the base rate; the rest is learned from chance.
    share = (seen[1] + PRIOR * base) / (seen.sum(0) + PRIOR)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    model.embedding[:, 0] = np.sign(odds) * np.maximum(np.abs(odds) - FLOOR, 0) / 2
    for w in WIDTHS:
        model.filters[w][:, 0, :] = np.abs(model.filters[w][:, 0, :]) / w
    model.out[:] = 0.5
    return model, past, True


def moved(model: Model, past: dict, texts: list[np.ndarray], toxic: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """Moves model and past on over word buckets of texts and their labels, once each, with Adagrad; gradients pass through the maxima only."""

    def move(key: object, x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        past[key] = past[key] + slope * slope
        return x - RATE * slope / np.sqrt(past[key])

    share = np.where(toxic, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    order = rng.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        pick = order[at : at + BATCH]
        buckets = np.concatenate([texts[i] for i in pick])
        firsts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
        values, places = model.pooled(buckets, firsts, None, places=True)
        p = 1 / (1 + np.exp(-np.clip(values @ model.out + model.intercept, -40, 40)))
        miss = (p - toxic[pick]) * share[pick] / len(pick)
        back = miss[:, None] * model.out * (values > 0)
        model.out = move("o", model.out, values.T @ miss)
        model.intercept = float(move("i", np.float64(model.intercept), miss.sum()))
        touched: list[tuple[np.ndarray, np.ndarray]] = []
        for k, w in enumerate(WIDTHS):
            slope_f, slope_b = np.zeros_like(model.filters[w]), np.zeros(FILTERS)
            for f in range(FILTERS):
                g, first = back[:, k * FILTERS + f], places[:, k * FILTERS + f]
                on = np.flatnonzero((g != 0) & (first >= 0))
                if not len(on):
                    continue
                slope_b[f] = g[on].sum()
                for o in range(w):
                    b = buckets[first[on] + o]
                    slope_f[o, :, f] = g[on] @ model.embedding[b].sum(1)
                    touched.append((b.ravel(), np.repeat(g[on, None] * model.filters[w][o, :, f], b.shape[1], axis=0)))
            model.filters[w] = move(("f", w), model.filters[w], slope_f)
            model.biases[w] = move(("b", w), model.biases[w], slope_b)
        if touched:
            rows, place = np.unique(np.concatenate([r for r, _ in touched]), return_inverse=True)
            slopes = np.zeros((len(rows), DIMS))
            np.add.at(slopes, place, np.concatenate([part for _, part in touched]))
            past["e"][rows] += slopes * slopes
            model.embedding[rows] -= RATE * slopes / np.sqrt(past["e"][rows])


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model:
    """Fits a model to word buckets of texts and their labels, all in one place."""
    seen = np.zeros((2, BUCKETS))
    for words_, y in zip(texts, toxic, strict=True):
        seen[int(y), np.unique(words_)] += 1
    model, past, live = begun(seen, int(toxic.sum()), len(toxic), seed)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS if live else 0):
        moved(model, past, texts, toxic, toxic.mean(), rng)
    return model


def packed(model: Model, past: dict) -> np.ndarray:
    """Model and past in one row of numbers."""
    pieces = [model.embedding, past["e"], model.out, past["o"], model.intercept, past["i"]] + [x for w in WIDTHS for x in (model.filters[w], past["f", w], model.biases[w], past["b", w])]
    return np.concatenate([np.ravel(x) for x in pieces]).astype(float)


def unpacked(row: np.ndarray) -> tuple[Model, dict]:
    at = 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        at += (n := int(np.prod(shape)))
        return row[at - n : at].reshape(shape).copy()

    pair = lambda *shape: (take(*shape), take(*shape))
    (embedding, e), (out, o), (intercept, i) = pair(BUCKETS, DIMS), pair(FILTERS * len(WIDTHS)), pair(1)
    model, past = Model(embedding, {}, {}, out, float(intercept[0])), {"e": e, "o": o, "i": i[0]}
    for w in WIDTHS:
        (model.filters[w], past["f", w]), (model.biases[w], past["b", w]) = pair(w, DIMS, FILTERS), pair(FILTERS)
    return model, past


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


WORDS = "doc_id long, lang string, toxic int, words binary"


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """shard, doc_id, lang, toxic, words (buckets, two bytes each) and apart of all rows to learn from, once each doc_id by `rows_of`; a table."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    n = known.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(0)):
                buckets, firsts = word_buckets(data, offsets)
                told = [buckets[i:j].astype("<u2").tobytes() for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (1, 2, 3)), pa.array(told, pa.binary())], ["doc_id", "lang", "toxic", "words"])

    texts = docs.filter(~held_out(F.col("doc_id"))).select("text", F.col("doc_id").cast("long").alias("doc_id"), "lang")
    rows = texts.join(F.broadcast(known) if n <= MAX_BROADCAST else known, "doc_id").select("text", "doc_id", "lang", "toxic").mapInArrow(tidied(run), WORDS)
    turn = F.xxhash64(F.lit(3), "doc_id")
    rows = rows.withColumn("shard", F.pmod(turn, F.lit(max(1, -(-n // SHARD_ROWS)))).cast("int")).withColumn("apart", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(CALIBRATION)) == 0)
    dealt = rows.repartition("shard").sortWithinPartitions("shard", turn, "doc_id", "toxic", F.xxhash64("words"), "lang")
    return table(dealt.select("shard", "doc_id", "lang", "toxic", "words", "apart"), "labelled")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, list[str | None]]]:
    """(shard, words of texts, toxic, apart, lang) of the rows of labelled(), a batch and shard at a time; of equal doc_ids the first."""
    last = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        fresh = []
        for i, key in enumerate(columns[1]):
            if key != last:
                fresh.append(i)
                last = key
        for shard in sorted({columns[0][i] for i in fresh}):
            own = [i for i in fresh if columns[0][i] == shard]
            texts = [np.frombuffer(columns[4][i], "<u2").astype(np.int32).reshape(-1, 1 + len(PREFIXES)) for i in own]
            yield shard, texts, np.array([columns[3][i] == 1 for i in own]), np.array([columns[5][i] for i in own]), [columns[2][i] for i in own]


def summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, np.ndarray]]]) -> np.ndarray:
    """The sum of what run gives for the partitions of rows: (shard, weight, numbers), each times its weight; added up in BLOCKS parts, in order of shards."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, weight, numbers in run(batches):
            values = [(part * weight).astype("<f8").tobytes() for part in np.array_split(numbers, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, shard, np.int32)), pa.array(np.full(BLOCKS, weight, np.int64)), pa.array(values, pa.binary())], ["block", "shard", "weight", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "numbers"])
        for batch in batches:
            for now, value in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != block:
                    if block is not None:
                        yield one()
                    block, total = now, np.zeros(len(value) // 8)
                total = total + np.frombuffer(value, "<f8")
        if block is not None:
            yield one()

    each = rows.mapInArrow(tidied(told), "block int, shard int, weight long, numbers binary").repartition("block").sortWithinPartitions("block", "shard", "weight", "numbers")
    found = {r.block: np.frombuffer(r.numbers, "<f8") for r in each.mapInArrow(add, "block int, numbers binary").collect()}
    return np.concatenate([found[k] for k in range(BLOCKS)]) if found else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float], float]:
    """(model, threshold of each language, overall threshold) from docs (doc_id, text, lang) and labels (doc_id, toxic)."""
    rows, spark = labelled(docs, labels), docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        seen, kinds, first = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2)), None
        for shard, texts, toxic, apart, _ in rows_of(batches):
            first = shard if first is None else first
            for x, y, z in zip(texts, toxic.astype(int), apart.astype(int), strict=True):
                seen[z, y, np.unique(x)] += 1
                kinds[z, y] += 1
        if first is not None:
            yield first, 1, np.concatenate([seen.ravel(), kinds.ravel()])

    sums = summed(rows, count)
    sums = sums if len(sums) else np.zeros(4 * BUCKETS + 4)
    seen, kinds = sums[:-4].reshape(2, 2, BUCKETS), sums[-4:].reshape(2, 2)
    # The model of all rows, and that of those that are not set apart.
    pair = [begun(x, int(k[1]), int(k.sum())) for x, k in ((seen.sum(0), kinds.sum(0)), (seen[0], kinds[0]))]
    live, rates = [p[2] for p in pair], [k[1] / max(1, k.sum()) for k in (kinds.sum(0), kinds[0])]
    states = [packed(m, past) for m, past, _ in pair]
    for epoch in range(EPOCHS if any(live) else 0):
        shared = spark.sparkContext.broadcast(states)

        def learn(batches: Iterator[pa.RecordBatch], epoch: int = epoch, shared=shared) -> Iterator[tuple[int, int, np.ndarray]]:
            at, held, n = None, None, np.zeros(2)
            # Each model is told times its own rows, after which come these numbers of rows.
            whole = lambda: (at, 1, np.concatenate([*(packed(*x) * k for x, k in zip(held, n, strict=True)), n]))
            for shard, texts, toxic, apart, _ in rows_of(batches):
                if shard != at:
                    if at is not None:
                        yield whole()
                    at, held, n = shard, [unpacked(x) for x in shared.value], np.zeros(2)
                    rng = np.random.default_rng((epoch, shard))
                for k, own in enumerate((np.ones(len(texts), bool), ~apart)):
                    if own.any():
                        n[k] += own.sum()
                        if live[k]:
                            moved(*held[k], [t for t, x in zip(texts, own, strict=True) if x], toxic[own], rates[k], rng)
            if at is not None:
                yield whole()

        sums = summed(rows, learn)
        states = [x / n if n else state for x, n, state in zip(np.split(sums[:-2], 2), sums[-2:], states, strict=True)]
    model, second = (unpacked(x)[0] for x in states)
    return model, *cuts(scored(rows, second))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """lang, score and toxic of the rows of labelled() that are set apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for _, texts, toxic, apart, lang in rows_of(batches):
            own = np.flatnonzero(apart)
            if len(own):
                firsts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
                scores = np.round(model.scores(np.concatenate([texts[i] for i in own]), firsts, tables), 6)
                yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in own], pa.string()), pa.array(scores), pa.array(toxic[own])], ["lang", "score", "toxic"])

    return rows.mapInArrow(tidied(run), "lang string, score double, toxic boolean")


def cuts(found: DataFrame) -> tuple[dict[str, float], float]:
    """(threshold of each language, overall threshold) that calibrated() gives for lang, score and toxic of all rows; equal scores are one row of the sums."""
    none = F.lit(None).cast("string")
    kinds = [F.sum(F.col("toxic").cast("long")).alias("hits"), F.count("*").alias("n")]
    by = table(found.groupBy("lang", "score").agg(*kinds), "cuts")
    every = by.groupBy("score").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).select(none.alias("lang"), "score", "hits", "n")
    counted = every.union(by.filter("lang <> ''").select("lang", "score", "hits", "n"))
    so_far, whole = Window.partitionBy("lang").orderBy(F.desc("score")), Window.partitionBy("lang")
    placed = counted.select("lang", "score", F.sum("hits").over(so_far).alias("h"), F.sum("n").over(so_far).alias("at"), F.sum("hits").over(whole).alias("toxic"), F.sum("n").over(whole).alias("n"), F.coalesce(F.lead("score").over(so_far), F.lit(0.0)).alias("next"))
    best = placed.groupBy("lang").agg(F.max(F.struct((2 * F.col("h") / (F.col("at") + F.col("toxic"))).alias("f1"), "score", "next")).alias("b"), F.first("toxic").alias("toxic"), F.first("n").alias("n"))
    told = {r.lang: round((r.b.score + r.b.next) / 2, 6) if r.toxic >= 20 and r.n - r.toxic >= 20 else None for r in best.collect()}
    overall = told.pop(None, None)
    overall = 0.5 if overall is None else overall
    return {lang: overall if x is None else x for lang, x in told.items()}, overall


def calibrated(scores: np.ndarray, toxic: np.ndarray, other: float = 0.5) -> float:
    """The cut that gives the best F1; `other` with fewer than 20 rows of either kind."""
    if toxic.sum() < 20 or (~toxic).sum() < 20:
        return other
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    best = int(np.argmax(f1))
    return round(float(s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2, 6)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang and score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            out = []
            for _, _, data, offsets in parts(batch.column(2)):
                out.append(model.scores(*word_buckets(data, offsets), tables))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.concatenate(out), 6))], ["doc_id", "lang", "score"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model, by_language, overall = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    limit = F.lit(overall)
    for language, cut in sorted(by_language.items()):
        limit = F.when(F.col("lang") == language, F.lit(cut)).otherwise(limit)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
