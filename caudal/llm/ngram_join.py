"""N-gram Jaccard join: all documents linked by a Jaccard similarity of SHARE or more on sets of WIDTH-word shingles.

1. Documents with equal shingle sets form one class (a node); only nodes are compared.
2. Every shingle is ordered by frequency class and hash. Two sets that are similar enough share one of the
   first n - ceil(SHARE * n) + 1 shingles of their own order (the prefix), so a bucket for each such shingle
   holds every pair that can be linked. Any common order is exact; rare ones first keep buckets small. Frequent
   shingles are found from all documents: one in 1 / FREQUENT documents at least, so their table has a bound
   (2 * mean set size * FREQUENT) that does not grow with the corpus. A bucket is parted where neighbours by set size are too far apart.
3. A node's shingles are hashed into GROUPS groups; its group counts are a point. For two points the sum of the
   coordinates' minima bounds the overlap. Within a bucket the points are indexed in an R-tree, and a join of the tree
   with itself drops pairs of subtrees whose boxes bound the overlap below what SHARE needs.
4. Surviving pairs are bounded by finer points, and then verified on the whole sets, which move once a pair. First only pairs with the most central point of each bucket
   are verified, one pair for each node and then those still across components; then, of the buckets whose nodes are
   not all connected yet, the pairs across components. A large group of near copies so costs rows in proportion to its
   size, and no link between different components is lost.

Buckets over BLOCK nodes are dealt in blocks and all pairs of blocks, each its own unit of work. Buckets with the same
smallest node (mostly those of one shared passage) go to one task, which tells a pair that meets in many of them once;
where they have over BLOCK rows together, they are split by bucket.

Hashes have 64 bits: two different shingles or sets are taken for equal with a chance of about 5e-20 a pair.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; fewer than WIDTH
words are one shingle; a very long text is one set like any other; repeated rows are one node; a pair at exactly SHARE is
linked; several texts under one doc_id are linked each by itself, and a row has the component of its own text; a null doc_id
is linked too (its component is null where all of it is); an empty table gives no rows; extra columns, whatever their names,
are not read by `linked` and stay in `one_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, table, tidied
from .textkit import LOWER, distinct, mix, parts, shingles, span_hashes, words

WIDTH, SHARE = 5, 80  # words, per cent
FREQUENT, CHUNK, SEEN = 2000, 3_000_000, 200_000
GROUPS, MOST_GROUPS, LEAF, BLOCK, HELD_PAIRS = 128, 1024, 32, 2048, 200_000
MAX_BROADCAST = 500_000


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes of each row in rising order, where each row's begin)."""
    for a, b, data, offsets in parts(column):
        plain = LOWER[data]
        starts, ends, firsts = words(plain, offsets)
        yield a, b, *distinct(*shingles(span_hashes(plain, starts, ends), firsts, WIDTH))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (in rising order) that at least one in FREQUENT documents holds, and their rank by estimated frequency.

    Each chunk of a partition reports those that at least half that share of its own documents hold; what is frequent
    overall must be so in chunks with half its occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs_ = [], 0, 0

        def flush() -> pa.RecordBatch:
            # Sorted in place, and only runs of three and more are looked at: no array of all distinct values is made.
            values = np.concatenate(held)
            held.clear()
            values.sort()
            starts = np.flatnonzero((values[2:] == values[:-2]) & np.concatenate([[True], values[1:-2] != values[:-3]])) if len(values) > 2 else np.zeros(0, np.int64)
            found = values[starts]
            counts = np.searchsorted(values, found, "right") - starts
            often = counts >= max(3, docs_ / (2 * FREQUENT))
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often]), pa.array(np.zeros(often.sum(), np.int64))], ["shingle", "hits", "docs"])

        total = 0
        for batch in batches:
            total += batch.num_rows
            for a, b, values, _ in shingle_sets(batch.column(0)):
                held.append(values)
                size, docs_ = size + len(values), docs_ + b - a
                if size >= CHUNK:
                    yield flush()
                    held, size, docs_ = [], 0, 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["shingle", "hits", "docs"])

    counted = table(docs.select("text").mapInArrow(tidied(run), "shingle long, hits long, docs long"), "frequent")
    n = counted.agg(F.sum("docs")).first()[0] or 0
    found = counted.filter("hits > 0").groupBy("shingle").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= n / (2 * FREQUENT)).toArrow()
    values, hits = found.column("shingle").to_numpy().view(np.uint64), found.column("hits").to_numpy()
    order = np.lexsort((values, hits))
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(1, len(values) + 1)
    by_value = np.argsort(values)
    return values[by_value], ranks[by_value]


def prefixes(values: np.ndarray, places: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(SHARE n) + 1 shingles of each row in the common order, and where each row's begin."""
    rank = np.zeros(len(values), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rank = np.where(frequent[at] == values, ranks[at], 0)
    kept, sizes = [], np.zeros(len(places) - 1, np.int64)
    for i in range(len(sizes)):
        row, of = values[places[i] : places[i + 1]], rank[places[i] : places[i + 1]]
        if len(row):
            sizes[i] = len(row) - -(-SHARE * len(row) // 100) + 1
            if of.any():
                row = row[np.argsort(of, kind="stable")]
            kept.append(row[: sizes[i]])
    return np.concatenate(kept) if kept else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def node_ids(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values))])
    return mix((total[places[1:]] - total[places[:-1]]) ^ np.diff(places).astype(np.uint64)).view(np.int64)


NODES = "doc_id long, node long, n_shingles long, counts binary, prefix array<long>, fine binary"


def nodes(docs: DataFrame, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """NODES of every row; counts and prefix are given once for each node and partition. node is null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranks = shared.value
        seen: set[int] = set()
        for batch in batches:
            for a, b, values, places in shingle_sets(batch.column(1)):
                sizes, node = np.diff(places), node_ids(values, places)
                new = np.zeros(len(sizes), bool)
                for i in np.flatnonzero(sizes):
                    if node[i] not in seen:
                        seen.add(int(node[i]))
                        new[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                tokens, firsts = prefixes(values, places, frequent, ranks)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                group = (mix(values) >> np.uint64(57)).astype(np.int64)
                points = np.bincount(rows * GROUPS + group, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(node, pa.int64(), mask=sizes == 0),
                        pa.array(sizes),
                        pa.array([points[i].astype("<u4" if points[i].max() > 65535 else "<u2").tobytes() if new[i] else None for i in range(len(sizes))], pa.binary()),
                        pa.array([tokens[firsts[i] : firsts[i + 1]].view(np.int64) if new[i] else None for i in range(len(sizes))], pa.list_(pa.int64())),
                        pa.array([fine_point(values[places[i] : places[i + 1]], MOST_GROUPS) if new[i] else None for i in range(len(sizes))], pa.binary()),
                    ],
                    ["doc_id", "node", "n_shingles", "counts", "prefix", "fine"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), NODES)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Joins batches sorted by their first columns so that no key is parted over two tables."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        cols = [now.column(k).to_numpy() for k in range(keys)]
        last = int(np.flatnonzero(np.logical_and.reduce([c == c[-1] for c in cols]) == 0)[-1]) + 1 if any(c[0] != c[-1] for c in cols) else 0
        if last:
            yield now.slice(0, last)
        held = now.slice(last)
    if held is not None:
        yield held


def buckets(found: DataFrame) -> DataFrame:
    """bucket, node, size, lead (its smallest node) of each bucket of two nodes or more; buckets with the same nodes count once.

    A shingle's nodes are parted where neighbours in the order of their set sizes are too far apart to be linked: no two on different
    sides can be. Most shingles that meet by chance so make no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in _runs(batches, 1):
            token, size, node = (rows.column(k).to_numpy() for k in range(3))
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, size, node = token[fresh], size[fresh], node[fresh]
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (100 * size[:-1] < SHARE * size[1:])]))
            sizes = np.diff(np.concatenate([starts, [len(token)]]))
            ids = mix(np.add.reduceat(mix(node.view(np.uint64)), starts) ^ sizes.astype(np.uint64)).view(np.int64)
            keep = sizes > 1
            for i in np.flatnonzero(keep):
                if ids[i] in seen:
                    keep[i] = False
                else:
                    seen.add(int(ids[i]))
            if len(seen) > SEEN:
                seen.clear()
            if keep.any():
                mask = np.repeat(keep, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)[mask]), pa.array(node[mask]), pa.array(np.repeat(sizes, sizes)[mask]), pa.array(np.repeat(np.minimum.reduceat(node, starts), sizes)[mask])], ["bucket", "node", "size", "lead"])

    exploded = found.filter("prefix IS NOT NULL").select(F.explode("prefix").alias("token"), "n_shingles", "node")
    return exploded.repartition("token").sortWithinPartitions("token", "n_shingles", "node").mapInArrow(tidied(run), "bucket long, node long, size long, lead long").distinct()


def with_deal(members: DataFrame) -> DataFrame:
    """members (a table) with deal, equal for the buckets that one task takes: those of a lead, or a part of them if they have over BLOCK rows."""
    heavy = table(members.groupBy("lead").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK), "heavy")
    few = heavy.count() <= MAX_BROADCAST
    part = F.pmod(F.xxhash64(F.lit(2), "bucket"), F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK))
    return members.join(F.broadcast(heavy) if few else heavy, "lead", "left").withColumn("deal", F.xxhash64("lead", part)).drop("lead", "rows")


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap that two sets of such sizes must have, times 100 + SHARE: overlap >= SHARE (a + b) / (100 + SHARE)."""
    return SHARE * (a + b)


class CountTree:
    """An R-tree over points of counts, bulk-loaded by halving at the widest coordinate (the set size included)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.rows: list[np.ndarray] = []
        self.below: list[tuple[int, int] | None] = []
        self.tops: list[np.ndarray] = []
        self.least: list[int] = []
        self.root = self._build(np.arange(len(sizes)))

    def _build(self, rows: np.ndarray) -> int:
        me = len(self.rows)
        mine = self.points[rows]
        self.rows.append(rows)
        self.tops.append(mine.max(0))
        self.least.append(int(self.sizes[rows].min()))
        self.below.append(None)
        if len(rows) > LEAF:
            spread = np.ptp(mine, axis=0)
            axis = int(np.argmax(spread))
            by = self.sizes[rows] if np.ptp(self.sizes[rows]) >= spread[axis] else mine[:, axis]
            order = rows[np.argsort(by, kind="stable")]
            half = len(order) // 2
            self.below[me] = (self._build(order[:half]), self._build(order[half:]))
        return me


def tree_join(a: CountTree, b: CountTree, labels_a: np.ndarray, labels_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs with different labels whose summed minima allow the similarity. a is b: each pair once."""
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        bound = np.minimum(a.tops[x], b.tops[y]).sum(dtype=np.int64)
        if (100 + SHARE) * bound < needed(a.least[x], b.least[y]):
            continue
        if a.below[x] is None and b.below[y] is None:
            i, j = a.rows[x], b.rows[y]
            overlap = np.minimum(a.points[i][:, None], b.points[j][None]).sum(2, dtype=np.int64)
            fits = ((100 + SHARE) * overlap >= needed(a.sizes[i][:, None], b.sizes[j][None])) & (labels_a[i][:, None] != labels_b[j][None])
            if a is b and x == y:
                fits &= np.arange(len(i))[:, None] < np.arange(len(j))[None]
            p, q = np.nonzero(fits)
            if len(p):
                yield i[p], j[q]
        elif a is b and x == y:
            left, right = a.below[x]
            stack += [(left, left), (left, right), (right, right)]
        elif b.below[y] is None or (a.below[x] is not None and len(a.rows[x]) >= len(b.rows[y])):
            stack += [(z, y) for z in a.below[x]]
        else:
            stack += [(x, z) for z in b.below[y]]


def _points(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u4" if len(x) == 4 * GROUPS else "<u2").astype(np.int64) for x in column.to_pylist()])


def star_pairs(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most central row with every other row that the bound allows."""
    middle = int(np.argmin(np.abs(points - np.median(points, axis=0)).sum(1))) if len(points) > 2 else 0
    overlap = np.minimum(points, points[middle]).sum(1)
    fits = (100 + SHARE) * overlap >= needed(sizes, sizes[middle])
    fits[middle] = False
    others = np.flatnonzero(fits)
    return np.full(len(others), middle), others


PAIRS = "x long, y long"


def candidates(members: DataFrame, labels: DataFrame | None, points: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (x < y) of nodes to verify. members: bucket, rep, size, n_shingles, counts, deal.

    Without labels the stars of the buckets (or of their blocks); with labels (node, component) all pairs across components
    that the fine points (points: rep, n_shingles, counts, fine) allow too; points go to open buckets only.
    """
    many = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "bucket", "rep"), many).cast("int"))
    if labels is None:
        keyed = dealt.select("bucket", "block", F.col("block").alias("other"), "block", F.col("rep"), "n_shingles", F.lit(0).cast("long").alias("label"), "counts", F.lit(None).cast("binary"), "deal")
    else:
        named = dealt.drop("n_shingles", "counts").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        split = named.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("bucket")
        opened = named.join(split, "bucket", "left_semi").join(points, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), many - 1)))
        keyed = opened.select("bucket", F.least("block", "with").alias("block"), F.greatest("block", "with").alias("other"), F.col("block").alias("own"), "rep", "n_shingles", "label", "counts", "fine", "deal")
    keyed = keyed.toDF("bucket", "block", "other", "own", "rep", "n_shingles", "label", "counts", "fine", "deal")
    star = labels is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for rows in _runs(batches, 3):
            keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            ends = np.concatenate([starts[1:], [keys.shape[1]]])
            own, rep, size, label = (rows.column(k).to_numpy() for k in range(3, 7))
            points, close, out = _points(rows.column(7)), rows.column(8).to_pylist(), []

            def fits(i: np.ndarray, j: np.ndarray, close=close) -> np.ndarray:
                return np.array([may_link(close[p], close[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)

            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                if star:
                    i, j = star_pairs(points[s:e], size[s:e])
                    out.append((rep[s:e][i], rep[s:e][j]))
                    continue
                if keys[1, s] == keys[2, s]:
                    tree = CountTree(points[s:e], size[s:e])
                    pairs = tree_join(tree, tree, label[s:e], label[s:e])
                    out += [(rep[s + i[ok]], rep[s + j[ok]]) for i, j in pairs if len(i) and (ok := fits(s + i, s + j)).any()]
                else:
                    left, right = s + np.flatnonzero(own[s:e] == keys[1, s]), s + np.flatnonzero(own[s:e] != keys[1, s])
                    if len(left) and len(right):
                        pairs = tree_join(CountTree(points[left], size[left]), CountTree(points[right], size[right]), label[left], label[right])
                        out += [(rep[left[i[ok]]], rep[right[j[ok]]]) for i, j in pairs if len(i) and (ok := fits(left[i], right[j])).any()]
            if out:
                x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                pairs = list(zip(*both.tolist(), strict=True))
                new = np.array([pair not in told for pair in pairs], bool)
                told.update(pairs)
                if len(told) > HELD_PAIRS:
                    told.clear()
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(both[0][new]), pa.array(both[1][new])], ["x", "y"])

    return keyed.repartition("deal", "block", "other").sortWithinPartitions("deal", "bucket", "block", "other", "n_shingles", "rep").mapInArrow(tidied(run), PAIRS).distinct()


def fine_point(values: np.ndarray, most: int = 1 << 30) -> bytes:
    """Group counts of a set in a quarter to half as many groups as it has shingles (GROUPS at least, most at most), after a byte that tells their width."""
    bits = max(GROUPS.bit_length() - 1, min(most, len(values) // 2).bit_length() - 1)
    counts = np.bincount((mix(values) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = 1 if counts.max(initial=0) < 256 else 4
    return bytes([kind]) + counts.astype(f"<u{kind}").tobytes()


def may_link(x: bytes, y: bytes) -> bool:
    """Whether the minima of two fine points, summed over the coarser grouping of the two, allow the similarity."""
    a, b = (np.frombuffer(z, f"<u{z[0]}", offset=1).astype(np.int64) for z in (x, y))
    least = min(len(a), len(b))
    a, b = a.reshape(least, -1).sum(1), b.reshape(least, -1).sum(1)
    return (100 + SHARE) * np.minimum(a, b).sum() >= SHARE * (a.sum() + b.sum())


def alike(x: bytes, y: bytes) -> bool:
    """Whether two whole sets of shingles are similar enough."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SHARE * (len(a) + len(b) - common)


def compared(pairs: DataFrame, values: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (x, y of node; a table) whose values pass the test. values: node, value (binary), once or more for each node.

    A pair meets at that of its nodes which has more pairs, the hub. A hub's value goes there once for each BLOCK of its pairs, and the
    other's once for each pair, in one ordered pass that holds the hub's value.
    """
    counts = pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    known = pairs.join(counts.toDF("x", "of_x"), "x").join(counts.toDF("y", "of_y"), "y")
    swap = F.col("of_x") < F.col("of_y")
    met = known.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("hub"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("node"), F.greatest("of_x", "of_y").alias("n"))
    met = met.select("hub", F.pmod(F.xxhash64(F.lit(3), "node"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("part"), F.lit(True).alias("leaf"), "node")
    wanted = table(met.union(met.select("hub", "part", F.lit(False), "hub").distinct()), "met")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, last = None, b"", None
        for batch in batches:
            out = []
            for hub, part, leaf, node, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not leaf:
                    at, held, last = (hub, part), value, None
                elif at == (hub, part) and node != last:
                    last = node
                    if test(held, value):
                        out.append((min(hub, node), max(hub, node)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["x", "y"])

    dealt = values.join(wanted, "node").select("hub", "part", "leaf", "node", "value").repartition("hub", "part")
    return dealt.sortWithinPartitions("hub", "part", "leaf", "node").mapInArrow(tidied(run), PAIRS)


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """The pairs (x, y of node) whose whole sets are similar enough. pairs: a table; reps: node and a doc_id that has it.

    With points (node, fine) texts are read and whole sets moved only for pairs that the bound on fine points lets through: in long
    documents the coarse points of the tree are too even to tell two of them apart.
    """
    if points is not None:
        pairs = table(compared(pairs, points.select("node", F.col("fine").alias("value")), may_link), "bounded")
    wanted = table(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(reps, "node").select("rep").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, values, places in shingle_sets(batch.column(0)):
                node, rows = node_ids(values, places).tolist(), []
                for i in np.flatnonzero(np.diff(places)).tolist():
                    if node[i] not in seen:
                        seen.add(node[i])
                        rows.append((node[i], values[places[i] : places[i + 1]]))
                if len(seen) > SEEN:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([v.astype("<u8").tobytes() for _, v in rows], pa.binary())], ["node", "value"])

    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    return compared(pairs, table(texts.mapInArrow(tidied(run), "node long, value binary"), "sets"), alike)


def grouped(links: DataFrame) -> DataFrame:
    """node, component of the nodes in links (x, y)."""
    return table(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), "components")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    named = pairs
    for end in ("x", "y"):
        named = named.join(labels.toDF(end, f"of_{end}"), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return named.filter("of_x <> of_y").select("x", "y")


def linked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    found = table(nodes(docs, *frequent_shingles(docs)), "nodes")
    small_batches(spark, 20_000)
    # Columns of fixed size only: a class of copies is its node and smallest doc_id before any join.
    reps = table(found.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    points = found.filter("counts IS NOT NULL").dropDuplicates(["node"]).select("node", "n_shingles", "counts")
    members = table(buckets(found).join(points, "node").select("bucket", "size", "lead", F.col("node").alias("rep"), "n_shingles", "counts"), "members")
    members = with_deal(members)
    small_batches(spark, 2000)
    stars = table(candidates(members, None), "pairs")
    fine = found.filter("fine IS NOT NULL")
    links = table(verified(docs, table(stars.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "pairs"), reps, fine), "links")
    links = table(links.union(verified(docs, table(across(stars, grouped(links)), "pairs"), reps, fine)), "links")
    first = grouped(links)
    fine = fine.dropDuplicates(["node"]).select(F.col("node").alias("rep"), "n_shingles", "counts", "fine")
    more = table(verified(docs, table(candidates(members, first, fine), "pairs"), reps), "links")
    # A component is told by its smallest doc_id; the sum over a component combines before the shuffle.
    whole = table(reps.join(grouped(links.union(more)), "node", "left").withColumn("component", F.coalesce("component", "node")), "whole")
    names = whole.join(whole.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    return found.select("doc_id", "node", "n_shingles").join(names, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, all columns as they are, with the smallest doc_id of each group of linked documents.

    Rows of one doc_id are one document, of which the row with the least text (then the least other columns) stays. Rows without
    doc_id stay.
    """
    found = table(linked(spark, docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "linked")
    gone = found.filter("component_id <> doc_id").select("doc_id")
    few = gone.count() <= MAX_BROADCAST
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    again = found.filter("rows > 1 AND component_id = doc_id").select("doc_id")
    if not (n := again.count()):
        return kept
    again = F.broadcast(again) if n <= MAX_BROADCAST else again
    least = F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("x")
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least).select(*(F.col("doc_id") if c == "doc_id" else F.col(f"x.`{c}`").alias(c) for c in docs.columns))
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
