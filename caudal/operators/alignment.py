"""Lessons against the pages of their book: affinity, alignment in book order, best spans, and one-to-one matching of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush, heapreplace
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .storage import written

# What a page must add to a span, the cap of a term's count, the share of the best page that neighbours keep, pages of a span.
PENALTY, TF_MOST, NEAR, MOST_PAGES = 0.35, 3, 0.55, 8
#: Pairs and rows, all in all, that are left to one pass a group.
FEW = 500_000
MILLION = 1_000_000
NEVER = -(1 << 61)


def weights(lessons: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, held): the weight of each term of a lesson, and the pages that hold it.

    lessons is (unit, lesson, text), pages (unit, page, text); both number from 0 within the unit. A term weighs ln(1 + pages / pages
    that hold it), by its count in the lesson (at most TF_MOST); terms that no page of the unit holds weigh nothing.
    """
    held = pages.select("unit", "page", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    size = pages.groupBy("unit").agg(F.count("*").alias("pages"))
    often = held.groupBy("unit", "term").agg(F.count("*").alias("df")).join(size, "unit").select("unit", "term", F.log(1 + F.col("pages") / F.col("df")).alias("idf"))
    counts = lessons.select("unit", "lesson", F.explode(tokens(F.col("text"))).alias("term")).groupBy("unit", "lesson", "term").agg(F.count("*").alias("tf"))
    asked = counts.join(often, ["unit", "term"]).select("unit", "lesson", "term", (F.col("idf") * F.least("tf", F.lit(TF_MOST))).alias("weight"))
    return asked, held


def page_scores(asked: DataFrame, held: DataFrame) -> DataFrame:
    """unit, lesson, page, raw: the weight of the lesson's terms that the page holds, where there is any."""
    return asked.join(held, ["unit", "term"]).groupBy("unit", "lesson", "page").agg(F.sum("weight").alias("raw"))


def lesson_rows(lessons: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """unit, lesson, pages (of the unit), scores: array of (page, raw) by page, one row a lesson of a unit with pages."""
    size = pages.groupBy("unit").agg(F.count("*").alias("pages"))
    found = scores.groupBy("unit", "lesson").agg(F.sort_array(F.collect_list(F.struct("page", "raw"))).alias("scores"))
    return lessons.select("unit", "lesson").join(size, "unit").join(found, ["unit", "lesson"], "left")


def spans(n: int, m: int, row: Callable[[int], np.ndarray], penalty: int) -> list[tuple[int, int]]:
    """(first page, last page) of each of n lessons on m pages, in order, each contiguous to the one before or sharing its last page.

    The sum of row(lesson)[page] - penalty over all spans is the greatest; of equal sums, the end is the earliest, then from the
    last lesson back each start is. Two vectors of m numbers for every sqrt(n)-th lesson are kept, and the way back is worked out again from
    there, so memory grows with m * sqrt(n). With fewer pages than lessons the pages are shared out evenly.
    """
    if m < n:
        return [(min(i * m // n, m - 1),) * 2 for i in range(n)]
    places = np.arange(m)

    def onward(best: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = np.concatenate([[0], np.cumsum(row(i) - penalty)])
        after, shared = best[:-1] - sums[:-1], best[1:] - sums[:-1] if i else np.full(m, 2 * NEVER)
        start = np.maximum(after, shared)
        top = np.maximum.accumulate(start)
        at = np.maximum.accumulate(np.where(np.concatenate([[True], top[1:] > top[:-1]]), places, 0))
        ends = np.concatenate([[NEVER], np.where(top > NEVER // 2, top + sums[1:], NEVER)])
        return ends, at, (at + (shared > after)[at])

    step = isqrt(n) + 1
    best = np.full(m + 1, NEVER)
    best[0] = 0
    kept = {}
    for i in range(n):
        if i % step == 0:
            kept[i] = best
        best = onward(best, i)[0]
    end, out = int(np.argmax(best[1:])) + 1, []
    for first in sorted(kept, reverse=True):
        best, ways = kept[first], []
        for i in range(first, min(n, first + step)):
            best, at, before = onward(best, i)
            ways.append((at.astype(np.int32), before.astype(np.int32)))
        for at, before in reversed(ways):
            out.append((int(at[end - 1]), end - 1))
            end = int(before[end - 1])
    return out[::-1]


def _aligned(batch: pa.Table) -> pa.Table:
    batch = batch.sort_by("lesson")
    n, m = batch.num_rows, batch.column("pages")[0].as_py()
    listed = batch.column("scores").combine_chunks()
    lengths = np.asarray(listed.value_lengths().fill_null(0)).astype(np.int64)
    flat = listed.flatten()
    page, raw = flat.field("page").to_numpy(), flat.field("raw").to_numpy()
    firsts = np.concatenate([[0], np.cumsum(lengths)])

    def row(i: int) -> np.ndarray:
        out = np.zeros(m, np.int64)
        mine = raw[firsts[i] : firsts[i + 1]]
        if len(mine):
            out[page[firsts[i] : firsts[i + 1]]] = np.floor(mine / mine.max() * MILLION + 0.5)
        return out

    found = spans(n, m, row, int(PENALTY * MILLION))
    mean = [0.0 if m < n else row(i)[a : b + 1].mean() / MILLION for i, (a, b) in enumerate(found)]
    return pa.table({"unit": batch.column("unit"), "lesson": batch.column("lesson"), "start": pa.array([a for a, _ in found], pa.int32()), "end": pa.array([b for _, b in found], pa.int32()), "affinity": pa.array(mean, pa.float64())})


def align(rows: DataFrame) -> DataFrame:
    """unit, lesson, start, end, affinity (mean over the span, two places) of lesson_rows(). A group is one unit: numbers only, no texts.

    Affinities are whole millionths of the lesson's best page, so that equal sums are equal whatever the order they are added in.
    """
    kind = rows.schema["unit"].dataType.simpleString()
    found = rows.groupBy("unit").applyInArrow(_aligned, f"unit {kind}, lesson {rows.schema['lesson'].dataType.simpleString()}, start int, end int, affinity double")
    return found.withColumn("affinity", F.round("affinity", 2))


def grown(rows: DataFrame) -> DataFrame:
    """unit, lesson, start, end: a lesson's best page (the first of equals) with the neighbours, one at a time the better one (the next page of equals), that keep NEAR of its score, MOST_PAGES at most; null without any score."""
    dense = F.map_from_entries(F.transform("scores", lambda s: F.struct(s["page"], s["raw"])))
    known = rows.filter("scores is not null").select("unit", "lesson", "pages", dense.alias("at"), F.aggregate("scores", F.struct(F.lit(-1).cast("int").alias("page"), F.lit(0.0).alias("raw")), lambda b, s: F.when(s["raw"] > b["raw"], F.struct(s["page"].cast("int").alias("page"), s["raw"])).otherwise(b)).alias("best"))
    score = lambda page: F.coalesce(F.element_at("at", page), F.lit(0.0))

    def wider(span: Column, _: Column) -> Column:
        left = F.when(span["start"] > 0, score(span["start"] - 1)).otherwise(-1.0)
        right = F.when(span["end"] + 1 < F.col("pages"), score(span["end"] + 1)).otherwise(-1.0)
        moved = F.when(right >= left, F.struct(span["start"].alias("start"), (span["end"] + 1).alias("end"))).otherwise(F.struct((span["start"] - 1).alias("start"), span["end"].alias("end")))
        # A step that falls short changes nothing, so all later ones fall short too.
        return F.when(F.greatest(left, right) >= NEAR * F.col("best.raw"), moved).otherwise(span)

    span = F.aggregate(F.sequence(F.lit(2), F.lit(MOST_PAGES)), F.struct(F.col("best.page").alias("start"), F.col("best.page").alias("end")), wider)
    found = known.select("unit", "lesson", span.alias("span"))
    return rows.select("unit", "lesson").join(found, ["unit", "lesson"], "left").select("unit", "lesson", "span.start", "span.end")


def span_coverage(asked: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """found (unit, lesson, start, end) with coverage: the share of the lesson's weight in terms that a page of the span holds, two places; 0 without span."""
    inside = asked.join(found, ["unit", "lesson"]).join(held, ["unit", "term"]).groupBy("unit", "lesson", "term", "weight").agg(F.max(F.col("page").between(F.col("start"), F.col("end"))).alias("in"))
    share = inside.groupBy("unit", "lesson").agg((F.sum(F.when(F.col("in"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))
    return found.join(share, ["unit", "lesson"], "left").select("unit", "lesson", "start", "end", F.round(F.coalesce("share", F.lit(0.0)), 2).alias("coverage"))


class _Books:
    """Whole units, one after another (rows unit, side, number, words; lessons are side 0, pages 1): the terms of lessons that pages of their unit hold, their weights, and the pages of each.

    It grows with the words, not with lessons times pages: a lesson's scores are worked out when they are asked for.
    """

    def __init__(self, rows: pa.Table) -> None:
        unit = rows.column("unit").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        side, number = rows.column("side").to_numpy(), rows.column("number").to_numpy()
        row, terms_ = self._terms(rows)
        coded = terms_.dictionary_encode()
        key, of_page = unit[row] * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), side[row] == 1
        known, code = np.unique(key[of_page], return_inverse=True)
        df = np.bincount(code, minlength=len(known))
        self.page, self.ends = number[row[of_page]][np.argsort(code, kind="stable")], np.concatenate([[0], np.cumsum(df)])
        self.lessons = np.flatnonzero(side == 0)
        self.unit, pages = unit[self.lessons], np.bincount(unit[side == 1], minlength=unit.max() + 1)
        self.m = pages[self.unit]
        place, asked = np.searchsorted(self.lessons, row[~of_page]), key[~of_page]
        at = np.searchsorted(known, asked)
        there = at < len(known)
        there[there] = known[at[there]] == asked[there]
        pairs, tf = np.unique(place[there] * max(len(known), 1) + at[there], return_counts=True)
        place, self.term = np.divmod(pairs, max(len(known), 1))
        self.weight = np.log(1 + self.m[place] / df[self.term]) * np.minimum(tf, TF_MOST)
        self.first = np.searchsorted(place, np.arange(len(self.lessons) + 1))

    @staticmethod
    def _terms(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
        listed = pc.split_pattern(rows.column("words").combine_chunks(), " ")
        row, terms_ = pc.list_parent_indices(listed), pc.list_flatten(listed)
        real = pc.not_equal(terms_, "")
        return row.filter(real).to_numpy().astype(np.int64), terms_.filter(real)

    def held(self, lesson: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """weights of the lesson's terms, and for each page of each the place in them and the page."""
        mine = slice(self.first[lesson], self.first[lesson + 1])
        begin = self.ends[self.term[mine]]
        sizes = self.ends[self.term[mine] + 1] - begin
        place = np.repeat(np.arange(len(sizes)), sizes)
        return self.weight[mine], place, self.page[np.arange(len(place)) + (begin - np.cumsum(sizes) + sizes)[place]]

    def scores(self, lesson: int) -> np.ndarray:
        weight, place, page = self.held(lesson)
        return np.bincount(page, weight[place], self.m[lesson])

    def span(self, lesson: int) -> tuple[int | None, int | None, float]:
        """start, end as grown() tells them, and the share of the lesson's weight in terms that a page of the span holds."""
        raw = self.scores(lesson)
        start = end = int(np.argmax(raw))
        if not raw[start]:
            return None, None, 0.0
        least = NEAR * raw[start]
        for _ in range(MOST_PAGES - 1):
            left, right = raw[start - 1] if start else -1.0, raw[end + 1] if end + 1 < self.m[lesson] else -1.0
            if max(left, right) < least:
                break
            start, end = (start, end + 1) if right >= left else (start - 1, end)
        weight, place, page = self.held(lesson)
        inside = np.zeros(len(weight), bool)
        inside[place[(page >= start) & (page <= end)]] = True
        return start, end, float(weight[inside].sum() / weight.sum())


def _by_unit(lessons: DataFrame, pages: DataFrame, told: Callable[[_Books, range], list[tuple]], last: str) -> DataFrame:
    """unit, lesson, start, end and a double of each lesson of a unit with pages: told(books, places of a unit's lessons).

    Lessons and pages meet once, each as its terms in one string, in one ordered pass over each partition; a task holds the units of a batch, or one.
    """
    kinds = [lessons.schema[c].dataType.simpleString() for c in ("unit", "lesson")]
    words = lambda t: F.coalesce(F.array_join(t, " "), F.lit("")).alias("words")
    side = lambda rows, n, number, t: rows.filter("unit IS NOT NULL").select("unit", F.lit(n).alias("side"), F.col(number).cast("long").alias("number"), words(t))
    both = side(lessons, 0, "lesson", tokens(F.col("text"))).union(side(pages, 1, "page", F.array_distinct(tokens(F.col("text")))))

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        books = _Books(rows)
        at = np.flatnonzero(np.diff(books.unit, prepend=-1, append=-1)) if len(books.unit) else []
        out = [x for a, b in zip(at[:-1], at[1:], strict=True) if books.m[a] for x in told(books, range(a, b))]
        start, end, value = zip(*out, strict=True) if out else ((), (), ())
        mine = rows.take(pa.array(books.lessons[books.m > 0]))
        return pa.RecordBatch.from_arrays([*(mine.column(c).combine_chunks() for c in ("unit", "number")), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.float64())], names=["unit", "lesson", "start", "end", last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).dictionary_encode().indices.to_numpy()
            open_ = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if held and (open_ or held[-1].column(0)[-1] != batch.column(0)[0]):
                yield made([*held, batch.slice(0, open_)])
                held = []
            elif open_:
                yield made([batch.slice(0, open_)])
            held.append(batch.slice(open_))
        if held:
            yield made(held)

    dealt = both.repartition("unit").sortWithinPartitions("unit", "side", "number")
    found = dealt.mapInArrow(run, f"unit {kinds[0]}, lesson long, start int, end int, {last} double")
    return found.withColumns({"lesson": F.col("lesson").cast(kinds[1]), last: F.round(last, 2)})


def page_spans(lessons: DataFrame, pages: DataFrame) -> DataFrame:
    """unit, lesson, start, end, affinity: align() of lessons (unit, lesson, text) and pages (unit, page, text), which move once."""
    def told(books: _Books, mine: range) -> list[tuple]:
        def row(i: int) -> np.ndarray:
            raw = books.scores(mine[i])
            return np.floor(raw / (raw.max() or 1) * MILLION + 0.5).astype(np.int64)

        n, m = len(mine), int(books.m[mine[0]])
        return [(a, b, 0.0 if m < n else row(i)[a : b + 1].mean() / MILLION) for i, (a, b) in enumerate(spans(n, m, row, int(PENALTY * MILLION)))]

    return _by_unit(lessons, pages, told, "affinity")


def best_spans(lessons: DataFrame, pages: DataFrame) -> DataFrame:
    """unit, lesson, start, end, coverage: span_coverage() of what grown() tells of lessons (unit, lesson, text) and pages (unit, page, text), which move once."""
    return _by_unit(lessons, pages, lambda books, mine: [books.span(i) for i in mine], "coverage")


def _classes(rows: DataFrame, words: Column) -> DataFrame:
    """group, key, words (sorted, distinct), id, rank: rows of equal words are one class, in falling order of id; its key is a digest of the words, which can be many."""
    named = rows.select("group", F.array_sort(F.array_distinct(words)).alias("words"), "id").filter(F.size("words") > 0)
    keyed = named.select("group", F.unhex(F.md5(F.to_json("words"))).alias("key"), "words", "id")
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy("group", "key").orderBy(F.desc("id"))))


def _alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """group, a, b (keys), score: classes of both sides with a Jaccard of `least` or more, by their rarest words alone: two such sets share one of them.

    A word goes about with its class's key, its place and a sketch of the class; the words of a class move only once a pair. Both bounds
    lose no pair: the first word that two classes share leaves behind it as many as they still need, and as many words as part them, or
    fewer, part their sketches.
    """
    both = left.filter("rank = 1").select("group", "key", "words", F.lit("a").alias("side")).union(right.filter("rank = 1").select("group", "key", "words", F.lit("b").alias("side")))
    each = both.select("group", "side", "key", F.explode("words").alias("word"))
    often = each.groupBy("group", "word").agg(F.count("*").alias("often"))
    hashed = F.xxhash64("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(hashed, 1).bitwiseAND(F.lit(63)).cast("int"))
    sketch = (F.coalesce(F.bit_xor(F.when(hashed.bitwiseAND(F.lit(1)) == i, bit)), F.lit(0).cast("long")).alias(f"sketch{i}") for i in (0, 1))
    ranked = each.join(often, ["group", "word"]).groupBy("group", "side", "key").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("rare"), *sketch)
    size = F.size("rare")
    first = size - F.ceil(F.lit(least) * size - 1e-9) + 1
    heads = ranked.select("group", "side", "key", size.alias("size"), "sketch0", "sketch1", F.posexplode(F.slice("rare", F.lit(1), first.cast("int"))).alias("place", "head"))
    told = lambda s: heads.filter(F.col("side") == s).select("group", "head.word", F.col("key").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("size", "place", "sketch0", "sketch1")))
    need = F.ceil((F.col("a_size") + F.col("b_size")) * F.lit(least / (1 + least)) - 1e-9)
    behind = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    apart = sum((F.bit_count(F.col(f"a_sketch{i}").bitwiseXOR(F.col(f"b_sketch{i}"))) for i in (0, 1)), F.lit(0))
    near = (behind >= need) & (apart <= F.col("a_size") + F.col("b_size") - 2 * need)
    pairs = told("a").join(told("b"), ["group", "word"]).filter(near).select("group", "a", "b").distinct()
    told = lambda rows, s: rows.filter("rank = 1").select("group", F.col("key").alias(s), F.col("words").alias(f"{s}_words"))
    met = pairs.join(told(left, "a"), ["group", "a"]).join(told(right, "b"), ["group", "b"])
    same = F.size(F.array_intersect("a_words", "b_words"))
    return met.select("group", "a", "b", (same / (F.size("a_words") + F.size("b_words") - same)).alias("score")).filter(F.col("score") >= least)


def _scan(table: pa.Table) -> pa.Table:
    """group, left_id, right_id, score that the scan takes of one group's pairs of classes (side p) and the rows they have left (sides a and b).

    Each class on the left stands in the heap once, with the best that its row can have; a choice that was used meanwhile can only
    have become worse, and is put right when it comes up.
    """
    group, side, p_a, p_b, score, a_id, b_id = (table.column(c).combine_chunks() for c in ("group", "side", "a", "b", "score", "a_id", "b_id"))
    queues, names = {}, {}
    for s, keys, ids in (("a", p_a, a_id), ("b", p_b, b_id)):
        mine = np.flatnonzero(pc.equal(side, s).to_numpy(zero_copy_only=False))
        order = pc.sort_indices(ids.take(pa.array(mine)), sort_keys=[("", "descending")], null_placement="at_end").to_numpy()
        names[s] = ids.take(pa.array(mine[order]))
        queue = queues.setdefault(s, {})
        for place, key in enumerate(keys.take(pa.array(mine[order])).to_pylist()):
            queue.setdefault(key, []).append(place)
        for places in queue.values():
            places.reverse()  # the next row is the last
    lefts, rights, own = queues["a"], queues["b"], {}
    mine = pa.array(np.flatnonzero(pc.equal(side, "p").to_numpy(zero_copy_only=False)))
    for a, b, x in zip(p_a.take(mine).to_pylist(), p_b.take(mine).to_pylist(), score.take(mine).to_pylist(), strict=True):
        own.setdefault(a, []).append((-x, rights[b][-1], b))
    top, out = [], []

    def put(a: bytes) -> None:
        choices = own[a]
        while choices:
            x, place, b = choices[0]
            if not rights[b]:
                heappop(choices)
            elif rights[b][-1] != place:
                heapreplace(choices, (x, rights[b][-1], b))
            else:
                heappush(top, (x, lefts[a][-1], place, a))
                return

    for a, choices in own.items():
        heapify(choices)
        put(a)
    while top:
        x, place, other, a = heappop(top)
        b = own[a][0][2]
        if rights[b] and rights[b][-1] == other:
            out.append((place, other, -x))
            lefts[a].pop()
            rights[b].pop()
        if lefts[a]:
            put(a)
    a, b, x = zip(*out, strict=True) if out else ((), (), ())
    columns = [group.take(pa.array(np.zeros(len(out), np.int64))), names["a"].take(pa.array(a, pa.int64())), names["b"].take(pa.array(b, pa.int64())), pa.array(x, pa.float64())]
    return pa.Table.from_arrays(columns, names=["group", "left_id", "right_id", "score"])


def one_to_one(left: DataFrame, right: DataFrame, words: Column, least: float = 0.6) -> DataFrame:
    """group, left_id, right_id, score: what a scan of all pairs by falling (score, left id, right id) takes that uses each row once.

    left and right are (group, id, ...); words is each row's array of words; rows without words match nothing. Rows of equal words
    are a class; classes meet by their rarest words, and only the first row of a class that is left can be the next one taken. In each
    round all pairs of classes that are the best for both sides take a row each, or all rows they can where neither side has an equal
    choice: a pair that is the best for both sides comes before any other that uses its rows, so rounds give what the scan gives. Once
    pairs and the rows of their classes are FEW, all in all, each group is scanned in one pass: chains of choices would take a round a link.
    """
    a, b = written(_classes(left, words), "left"), written(_classes(right, words), "right")
    pairs = written(_alike(a, b, least), "alike")
    # Equal words come first: the scan pairs them in order of their ids before any other score.
    a, b = a.drop("words"), b.drop("words")
    taken = a.join(b.withColumnRenamed("id", "right_id"), ["group", "key", "rank"]).select("group", F.col("id").alias("left_id"), "right_id", F.lit(1.0).alias("score"), F.col("key").alias("a"), F.col("key").alias("b"), F.col("rank").alias("a_rank"), F.col("rank").alias("b_rank"))
    taken = written(taken, "taken")
    sizes = {s: rows.groupBy("group", F.col("key").alias(s)).agg(F.max("rank").alias("size")) for s, rows in (("a", a), ("b", b))}
    ids = {"a": a.select("group", F.col("key").alias("a"), F.col("rank").alias("a_rank"), F.col("id").alias("a_id")), "b": b.select("group", F.col("key").alias("b"), F.col("rank").alias("b_rank"), F.col("id").alias("b_id"))}
    parts = [taken]
    live = pairs.filter("score < 1")
    while True:
        used = parts[0]
        for p in parts[1:]:
            used = used.union(p)
        for s in "ab":
            done = used.groupBy("group", s).agg(F.max(f"{s}_rank").alias("done"))
            left_over = sizes[s].join(done, ["group", s], "left").select("group", s, (F.coalesce("done", F.lit(0)) + 1).alias(f"{s}_rank"), (F.col("size") - F.coalesce("done", F.lit(0))).alias(f"{s}_left")).filter(f"{s}_left > 0")
            live = live.join(left_over, ["group", s]).join(ids[s], ["group", s, f"{s}_rank"])
        live = written(live, "live")
        classes = live.select("group", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("key"), F.col(f"{s}_left").alias("left")) for s in "ab"))).alias("c")).distinct()
        if live.count() + (classes.agg(F.sum("c.left")).first()[0] or 0) <= FEW:
            break
        for s, o in ("ab", "ba"):
            by = Window.partitionBy("group", s).orderBy(F.desc("score"), F.desc(f"{o}_id"))
            live = live.withColumn(f"{s}_place", F.row_number().over(by)).withColumn(f"{s}_lone", F.coalesce(F.lead("score").over(by) < F.col("score"), F.lit(True)))
        best = live.filter("a_place = 1 and b_place = 1")
        many = F.when(F.col("a_lone") & F.col("b_lone"), F.least("a_left", "b_left")).otherwise(1)
        rows = best.select("group", "a", "b", "score", F.explode(F.sequence(F.lit(0), many - 1)).alias("k"), *(F.col(f"{s}_rank").alias(f"{s}_from") for s in "ab"))
        rows = rows.select("group", "a", "b", "score", *((F.col(f"{s}_from") + F.col("k")).alias(f"{s}_rank") for s in "ab"))
        for s, name in (("a", "left_id"), ("b", "right_id")):
            rows = rows.join(ids[s].withColumnRenamed(f"{s}_id", name), ["group", s, f"{s}_rank"])
        parts.append(written(rows.select(parts[0].columns), "taken"))
        live = live.select("group", "a", "b", "score")
    told = live.select("group", F.lit("p").alias("side"), "a", "b", "score", *(F.lit(None).cast(rows.schema["id"].dataType).alias(f"{s}_id") for s, rows in (("a", a), ("b", b))))
    for s in "ab":
        met = live.select("group", s, F.col(f"{s}_rank").alias("next")).distinct()
        told = told.unionByName(ids[s].join(met, ["group", s]).filter(F.col(f"{s}_rank") >= F.col("next")).select("group", F.lit(s).alias("side"), s, f"{s}_id"), allowMissingColumns=True)
    kinds = {c: used.schema[c].dataType.simpleString() for c in ("group", "left_id", "right_id")}
    scanned = told.groupBy("group").applyInArrow(_scan, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", score double")
    return used.select(scanned.columns).union(scanned).select("group", "left_id", "right_id", F.round("score", 6).alias("score"))


def book_pages(texts: DataFrame, size: int) -> DataFrame:
    """unit, page, text: pages of so many words of each text (unit, text)."""
    pieces = texts.select("unit", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))
    return pieces.select("unit", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice("w", k * size + 1, F.lit(size)), " "))).alias("page", "text"))


def guide_lessons(texts: DataFrame, size: int) -> DataFrame:
    """unit, lesson, text: a guide to a text (unit, text), every other word of each block of so many words."""
    blocks = book_pages(texts, size)
    return blocks.select("unit", F.col("page").alias("lesson"), F.array_join(F.filter(F.split("text", " "), lambda _, i: i % 2 == 0), " ").alias("text"))
