"""Benchmark decontamination: documents that hold a benchmark passage, up to SHARE per cent of edited words.

Texts are sequences of words (lower case, punctuation dropped). A document leaks an item of n words if one of its runs
of words is within n * SHARE // 100 word edits (insertion, deletion, substitution) of the item.

1. Every word position of every document starts a window. Such a run has at least n - d of its first n + d words
   in the benchmark's vocabulary, so windows with fewer are left out (this loses nothing).
2. CGK embedding: a walk reads the word at its place, and a random bit of (step, word) says whether it moves on. The
   same walk over item and window turns few edits into few differing steps. A step depends on the words up to it
   only, so one walk over a document serves windows of all sizes.
3. Bit sampling: of each walk SAMPLED steps make a signature, chosen for the item's size class. A window with an
   item's signature is a candidate. WALKS independent walks reach a recall of at least TARGET (measured in the tests
   at the greatest distance allowed; passages with fewer edits are found more surely, exact ones always).
4. Candidates are verified by the exact word edit distance to the best run around the window.

An item of over SEGMENT words is searched for by its segments, of which at least one is within its own SHARE wherever the whole
item is; around each segment found the whole item is verified. An item of fewer than SHORT words, where SHARE allows no edit, is
found by the hash of its words.

The benchmark is read in blocks of at most BLOCK_WORDS words, each one pass over the documents, so that what is broadcast is
bounded. Documents are never shuffled: each task searches its own rows.

Defined cases: a null or empty text, or one without letters and digits, holds nothing; an item without words is held by nothing;
null item_ids are left out; a very long document is searched in one piece; of equally near runs the first is told; repeated
documents give repeated rows, equal rows of the benchmark count once, items of one id are told once, at their least distance;
empty tables give no rows; extra columns, whatever their names, are not read by `leaks` and stay in `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, tidied
from .textkit import parts, ranges, shingles, span_hashes, words

SHARE, SHORT, SEGMENT = 20, 5, 256
TARGET, WALKS, SAMPLED = 0.95, 18, 3
BLOCK_WORDS, CELL, BATCH = 400_000, 16, 2048
LEAKS = "doc_id long, item_id long, distance int, item_words int, end_word long"

KEPT = np.full(256, 0x20, np.uint8)
KEPT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hash of each word, where each row's words begin)."""
    for a, b, data, offsets in parts(pc.utf8_lower(column)):
        plain = KEPT[data]
        starts, ends, firsts = words(plain, offsets)
        yield a, b, span_hashes(plain, starts, ends), firsts


def allowed(n: np.ndarray | int) -> np.ndarray | int:
    return n * SHARE // 100


def scattered(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words that keeps 0."""
    x = x.astype(np.uint32)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


class Walk:
    """One random walk: the bit of (step, word), and the sampled steps of each size class."""

    def __init__(self, seed: int, classes: list[int], longest: int) -> None:
        rng = np.random.default_rng([7, seed])
        self.keys = rng.integers(0, 2**32, 2 * longest + 2, dtype=np.uint32)
        self.factor = np.uint32(rng.integers(0, 2**31) * 2 + 1)
        # The walk moves on every second step: the first 3 n / 2 steps lie within the first n words but for rare cases.
        # One sampled step is an early one, so that most walks over other text end soon.
        self.steps = {n: [early := int(rng.integers(max(1, n // 4))), *np.sort(rng.choice(np.arange(early + 1, max(early + SAMPLED, 3 * n // 2)), SAMPLED - 1, replace=False)).tolist()] for n in classes}

    def moves(self, step: int, scatter: np.ndarray) -> np.ndarray:
        return ((scatter ^ self.keys[step]) * self.factor) >> np.uint32(31)


class Index:
    """The items of one block: vocabulary, size classes and the signatures of each walk. items: (item_id, word hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        short = [(i, w) for i, w in items if 0 < len(w) < SHORT]
        self.short = [self._exact(n, [(i, w) for i, w in short if len(w) == n]) for n in range(1, SHORT)]
        items = [(i, w) for i, w in items if len(w) >= SHORT]
        pieces = [(k, a, w[a:b]) for k, (_, w) in enumerate(items) for a, b in cuts(len(w))]
        self.id = np.array([i for i, _ in items], np.int64)
        self.whole = np.array([len(w) for _, w in items], np.int64)
        self.item, self.at = np.array([k for k, _, _ in pieces], np.int64), np.array([a for _, a, _ in pieces], np.int64)
        pieces = [(k, w) for k, _, w in pieces]
        self.n = np.array([len(w) for _, w in pieces], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in pieces)]))
        self.scatter = scattered(np.arange(len(self.vocabulary) + 1))
        self.filled = np.zeros(1 << 20, bool)
        self.filled[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.pieces = [(np.searchsorted(self.vocabulary, w) + 1).astype(np.int32) for _, w in pieces]
        self.long = {k: (np.searchsorted(self.vocabulary, w) + 1).astype(np.int32) for k, (_, w) in enumerate(items) if len(w) > SEGMENT}
        smallest, self.rank = [], np.zeros(len(pieces), np.int64)
        for k in np.argsort(self.n, kind="stable").tolist():
            if not smallest or 4 * self.n[k] > 5 * smallest[-1]:
                smallest.append(int(self.n[k]))
            self.rank[k] = len(smallest) - 1
        self.classes = smallest
        self.sizes = [np.unique(self.n[self.rank == c]) for c in range(len(smallest))]
        self.walks = [Walk(r, smallest, SEGMENT + SHORT) for r in range(WALKS)] if pieces else []
        self.tables = [[self._signatures(walk, c) for c in range(len(smallest))] for walk in self.walks]

    @staticmethod
    def _exact(n: int, items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of items of n words each, and their ids."""
        keys = np.array([shingles(w, np.array([0, n]), n)[0][0] for _, w in items], np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.array([i for i, _ in items], np.int64)[order]

    def exact(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """search() for the items under SHORT words."""
        out = [(np.zeros(0, np.int64),) * 5]
        for n, (keys, ids) in enumerate(self.short, 1):
            if not len(keys) or len(hashes) < n:
                continue
            # rows with fewer words have one window of another hash
            windows, places = shingles(hashes, firsts, n)
            low, high = np.searchsorted(keys, windows), np.searchsorted(keys, windows, "right")
            hits = np.flatnonzero(high > low)
            one = np.repeat(hits, (high - low)[hits])
            row = np.searchsorted(places, one, "right") - 1
            out.append((row, ids[ranges(low[hits], (high - low)[hits])], np.zeros(len(one), np.int64), np.full(len(one), n), one - places[row] + n))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _signatures(self, walk: Walk, c: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each sampled step the words that items have there, and the sorted signatures with their pieces."""
        mine, size = np.flatnonzero(self.rank == c), len(self.vocabulary) + 1
        steps, seen, keys = walk.steps[self.classes[c]], [], np.zeros(len(mine), np.int64)
        padded = np.zeros((len(mine), int(self.n[mine].max()) + 1), np.int32)
        for row, k in enumerate(mine.tolist()):
            padded[row, : self.n[k]] = self.pieces[k]
        at, rows = np.zeros(len(mine), np.int64), np.arange(len(mine))
        for step in range(steps[-1] + 1):
            code = padded[rows, np.minimum(at, self.n[mine])]
            if step in steps:
                there = np.zeros(size, bool)
                there[code] = True
                there[0] = False
                seen.append(there)
                keys = keys * size + code
            at += walk.moves(step, self.scatter[code])
        order = np.argsort(keys, kind="stable")
        return seen, keys[order], mine[order]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, from 1; 0 for others."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.filled[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def starts(self, codes: np.ndarray, c: int, known: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Windows of class c with enough known words in their own row. known: words in the vocabulary before each place; stops: the row's end."""
        total = len(codes)
        enough = np.zeros(total, bool)
        for n in self.sizes[c].tolist():
            d = allowed(n)
            width = min(n + d, total)
            counts = np.full(total, known[-1], known.dtype)
            counts[: total - width + 1] = known[width:]
            counts -= known[:-1]
            enough |= counts >= n - d
        places = np.flatnonzero(enough).astype(np.int32)
        # of these, windows that would need words of the next row
        least = int(self.sizes[c][0]) - allowed(int(self.sizes[c][0]))
        return places[known[stops[places]] - known[places] >= least]

    def candidates(self, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, cell of CELL words in which the window starts), each once. A walk stays at its row's end, stops."""
        scatter = self.scatter[codes]
        known = np.concatenate([[0], np.cumsum(codes > 0)]).astype(np.int32)
        last, size, found = len(codes) - 1, len(self.vocabulary) + 1, []
        for c in range(len(self.classes)):
            starts = self.starts(codes, c, known, stops)
            for walk, tables in zip(self.walks, self.tables, strict=True):
                seen, keys, pieces = tables[c]
                steps, begin, at, stop = walk.steps[self.classes[c]], starts, starts, stops[starts]
                signature = np.zeros(len(starts), np.int64)
                for step in range(steps[-1] + 1):
                    if step in steps:
                        code = codes[at]
                        live = np.flatnonzero(seen[steps.index(step)][code])
                        begin, at, stop, signature = begin[live], at[live], stop[live], signature[live] * size + code[live]
                    if not len(at):
                        break
                    at = np.minimum(at + walk.moves(step, scatter[at]).view(np.int32), stop)
                if len(at):
                    low, high = np.searchsorted(keys, signature), np.searchsorted(keys, signature, "right")
                    hits = np.repeat(np.arange(len(at)), high - low)
                    within = np.arange(len(hits)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                    found.append(np.unique(pieces[low[hits] + within] * (last // CELL + 1) + begin[hits].astype(np.int64) // CELL))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // (last // CELL + 1), both % (last // CELL + 1)

    def search(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance, words of the piece, end word in the row) of each leak, the nearest and first for each row and item."""
        out = [self.exact(hashes, firsts)]
        if len(hashes) and len(self.n):
            out += self.near(hashes, firsts)
        rows, items, best, size, end = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((end, best, items, rows))
        new = np.ones(len(order), bool)
        new[1:] = (rows[order][1:] != rows[order][:-1]) | (items[order][1:] != items[order][:-1])
        keep = order[new]
        return rows[keep], items[keep], best[keep], size[keep], end[keep]

    def near(self, hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """search() for the items of SHORT words and more."""
        # Each row ends in a place without a word, where its walks stay.
        codes = np.zeros(len(hashes) + len(firsts) - 1, np.int32)
        rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        codes[np.arange(len(hashes)) + rows] = self.codes(hashes)
        firsts = firsts + np.arange(len(firsts))
        stops = np.repeat((firsts[1:] - 1).astype(np.int32), np.diff(firsts))
        piece, cell = self.candidates(codes, stops)
        # A cell may hold the starts of several rows: each is verified within its own row's words.
        first = np.searchsorted(firsts, cell * CELL, "right") - 1
        final = np.searchsorted(firsts, np.minimum(cell * CELL + CELL, len(codes)) - 1, "right") - 1
        spread = np.repeat(np.arange(len(piece)), final - first + 1)
        row = ranges(first, final - first + 1)
        piece, cell = piece[spread], cell[spread]
        out = []
        for n in np.unique(self.n[piece]).tolist():
            of = np.flatnonzero(self.n[piece] == n)
            for at in range(0, len(of), BATCH):
                some = of[at : at + BATCH]
                patterns = np.stack([self.pieces[k] for k in piece[some].tolist()])
                best, end = nearest(codes, patterns, cell[some] * CELL, firsts[row[some]], firsts[row[some] + 1] - 1)
                good = best <= allowed(n)
                r, k, best, end = row[some][good], self.item[piece[some][good]], best[good], end[good]
                part = self.whole[k] > SEGMENT
                out.append((r[~part], self.id[k[~part]], best[~part], np.full((~part).sum(), n), (end - firsts[r])[~part]))
                if part.any():
                    begin = (end - self.at[piece[some][good]] - n)[part]
                    tries = {(x, y, z // CELL * CELL) for x, y, z in zip(r[part].tolist(), k[part].tolist(), begin.tolist(), strict=True)}
                    for x, y, z in sorted(tries):
                        best, end = nearest(codes, self.long[y][None], np.array([z]), firsts[x : x + 1], firsts[x + 1 : x + 2] - 1)
                        if best[0] <= allowed(len(self.long[y])):
                            out.append((np.array([x]), self.id[[y]], best, self.whole[[y]], end - firsts[x]))
        return out


def cuts(n: int) -> list[tuple[int, int]]:
    """An item's segments of SEGMENT words; the last takes what is too short for one."""
    ends = [*range(SEGMENT, n - SHORT + 1, SEGMENT), n]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def nearest(codes: np.ndarray, patterns: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edit distance of each pattern to a run that begins near starts, within words low to high; and that run's end."""
    n = patterns.shape[1]
    d = allowed(n)
    places = (starts - d)[:, None] + np.arange(CELL + n + 2 * d)
    inside = (places >= low[:, None]) & (places < high[:, None])
    text = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], 0)
    kind = np.int16 if text.shape[1] < 1 << 14 else np.int32
    steps = np.arange(text.shape[1] + 1, dtype=kind)
    last = np.zeros((len(text), text.shape[1] + 1), kind)
    for i in range(n):
        now = last + kind(1)
        np.minimum(now[:, 1:], last[:, :-1] + (text != patterns[:, i : i + 1]), out=now[:, 1:])
        now -= steps
        last = np.minimum.accumulate(now, axis=1) + steps
    end = last.argmin(1)
    return last[np.arange(len(last)), end].astype(np.int64), np.clip(starts - d + end, low, high)


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An Index for each block of the benchmark (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_WORDS)))  # a word and its space are two characters at least
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        listed = []
        for a, b, hashes, firsts in word_hashes(mine.column("text")):
            listed += [(i, hashes[x:y]) for i, x, y in zip(mine.column("item_id").to_pylist()[a:b], firsts[:-1], firsts[1:], strict=True)]
        yield Index(listed)


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """LEAKS: each pair of a document and an item that it holds."""
    small_batches(spark, 300)
    found = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, hashes, firsts in word_hashes(batch.column(1)):
                    row, item, distance, size, end = shared.value.search(hashes, firsts)
                    ids = batch.column(0).slice(a, b - a).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item), pa.array(distance, pa.int32()), pa.array(size, pa.int32()), pa.array(end, pa.int64())], ["doc_id", "item_id", "distance", "item_words", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(tidied(run), LEAKS)
        found = part if found is None else found.union(part)
    return found


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no benchmark item."""
    small_batches(spark, 300)
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, hashes, firsts in word_hashes(batch.column(at)):
                    clean[a + shared.value.search(hashes, firsts)[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
