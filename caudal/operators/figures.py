"""Figures of laid-out books: the text blocks around each and its caption, and the lesson and paragraph that each belongs to."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import collapsed, normalised, once, unmarked
from .storage import written

# Words of a body block, body blocks of a side, points over an edge that still count as beside it, share of a block within the figure that makes it a label.
BODY_WORDS, SIDE, TOUCH, LABEL = 6, 3, 2.0, 0.5
# Points between a figure and its caption, words of a caption, pages that make a text a running head; words of a needle, fewest words of an anchor, needles of a side, lessons of one page.
CAPTION_GAP, CAPTION_WORDS, HEAD_PAGES, NEEDLE, FEWEST, NEEDLES, PAGE_LESSONS = 20.0, 25, 3, 8, 4, 8, 3
#: Lessons are found by page in bins of so many pages; so many lessons of a figure's page are looked through before others are sought.
PAGE_BIN, PAGE_TRIES = 16, 16
#: Marks of NEEDLE words, and lines that are hashed at a time.
SPAN, LINES = NEEDLE - FEWEST + 1, 500


def _even(text: Column) -> Column:
    """collapsed(), with no search through texts whose words single spaces part."""
    uneven = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\n", "\r")]
    return F.when(uneven[0] | uneven[1] | uneven[2] | uneven[3], collapsed(text)).otherwise(F.trim(text))


def _bare(text: Column) -> Column:
    """unmarked(), with no search through texts that have no marks; most have none."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(unmarked(text))


def _plain(text: Column) -> Column:
    """normalised() of a text that is worked out already."""
    return F.trim(F.regexp_replace(F.lower(_bare(text)), "[^a-z0-9]+", " "))


def may_be_caption(text: Column) -> Column:
    """Neither a number, nor a list item, nor words that open something else."""
    return (text != "") & ~text.rlike(r"^\p{Nd}+$") & ~text.endswith(":") & ~text.rlike(r"^(?:[•·●▪◦\-–—*]|[0-9]{1,2}[.)])\s")


def _beside(events: Iterator[tuple]) -> Iterator[tuple]:
    """(figure, the nearest body blocks, nearest first, (block, gap, may be a caption) of the nearest block or None) for one page and side, in order of edges.

    An event is (figure or None, edge, x0, y0, x1, y1, block, body, caption); y runs towards the figures. What is held are the last
    blocks and the few within reach of a figure's edge, of which it may take some for its labels.
    """
    bodies, every = deque(), deque()
    for event in events:
        figure, edge, x0, y0, x1, y1, _, body, _ = event
        if figure is None:
            reach = edge - 2 * TOUCH
            if body:
                bodies.append(event)
                while len(bodies) > SIDE and bodies[SIDE][1] < reach:
                    bodies.popleft()
            every.append(event)
            while len(every) > 1 and every[1][1] < reach:
                every.popleft()
            continue

        def outside(block: tuple) -> bool:
            _, _, a0, b0, a1, b1, *_ = block
            area = (a1 - a0) * (b1 - b0)
            within = max(0.0, min(a1, x1) - max(a0, x0)) * max(0.0, min(b1, y1) - max(b0, y0))  # noqa: B023
            return not area or within / area <= LABEL

        near = next(filter(outside, reversed(every)), None)
        yield figure, [b[6] for b in islice(filter(outside, reversed(bodies)), SIDE)], near and (near[6], y0 - near[5], near[8])


def anchors(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """book, figure, before, after, caption of figures (book, page, figure, x0, y0, x1, y1) on pages with blocks (book, page, at, x0, y0, x1, y1, text).

    before and after join up to SIDE body blocks above and below in reading order; a body block has BODY_WORDS words and is no running
    head (a text that, digits apart, stands on HEAD_PAGES pages); blocks that lie mostly within a figure are its labels. Only pages with figures are read, also for running heads. The caption is the next block below, if it is short, near and neither a
    running head nor a list item. Of blocks with equal edges the first by `at` is nearer. One ordered pass for each page and side, which
    holds a few blocks: each text moves once to its page and once more to its figures; running heads are found by numbers alone, which mark
    their blocks. `at` tells a page's blocks apart. Null texts and blank ones are no blocks, figures without an id, page or edge are left out, figures without
    blocks get empty texts, a caption of the empty string means none; a repeated figure (book, figure) is one.
    """
    kind = figures.schema["figure"].dataType.simpleString()
    book_kind = figures.schema["book"].dataType.simpleString()
    box = ["x0", "y0", "x1", "y1"]
    numbers = lambda rows: rows.withColumns({c: F.col(c).cast("double") for c in box})
    asked = written(numbers(figures.select("book", "page", "figure", *box)).dropna(subset=["page", "figure", *box]).dropDuplicates(["book", "figure"]), "figures")
    drawn = asked.select(F.col("book").alias("_book"), F.col("page").alias("_page")).distinct()
    told = _even(F.replace(F.coalesce("text", F.lit("")), F.lit("­"), F.lit("")))
    # a filter of what is told would have it worked out twice
    some = blocks.filter(F.col("text").rlike("[^ \\t\\n\\r\u00AD]"))
    texts = numbers(some.select("book", "page", F.col("at").cast("long").alias("at"), *box, told.alias("told"))).dropna(subset=["at", *box])

    # running heads: numbers only, which mark their blocks on pages with figures
    keyed = texts.select("book", "page", "at", "y0", "y1", F.xxhash64(F.regexp_replace(_plain(F.col("told")), "[0-9]+", "#")).alias("key"))
    facts = written(keyed.join(drawn, F.col("book").eqNullSafe(F.col("_book")) & (F.col("page") == F.col("_page")), "left_semi"), "blocks")
    heads = facts.groupBy(F.col("book").alias("_book"), F.col("key").alias("_key")).agg(F.count_distinct("page").alias("_pages")).filter(F.col("_pages") >= HEAD_PAGES)
    marked = facts.join(heads, F.col("book").eqNullSafe(F.col("_book")) & (F.col("key") == F.col("_key")), "left_semi")

    def rows(frame: DataFrame, rank: int) -> DataFrame:
        """One form for marks of heads (0), blocks (1) and figures (2), in the order in which equal edges meet."""
        mine = [F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in (("figure", kind), ("at", "long"), ("x0", "double"), ("y0", "double"), ("x1", "double"), ("y1", "double"), ("told", "string"))]
        return frame.select("book", "page", F.lit(rank).alias("rank"), *mine)

    whole = rows(texts, 1).union(rows(asked, 2)).union(rows(marked, 0)).repartition("book", "page")
    # both sides of a page, y turned so that it runs towards the figures; made behind the shuffle, so that each text moves once
    drawn_row, sides = F.col("rank") == 2, []
    for below, y0, y1 in ((False, F.col("y0"), F.col("y1")), (True, -F.col("y1"), -F.col("y0"))):
        sides.append(F.struct(F.lit(below).alias("below"), F.when(drawn_row, y0 + TOUCH).otherwise(y1).alias("edge"), y0.alias("y0"), y1.alias("y1")))
    events = whole.withColumn("s", F.explode(F.array(*sides))).select("book", "page", "s.below", "rank", "figure", "at", "s.edge", "x0", "s.y0", "x1", "s.y1", "told", (-F.col("at")).alias("back"))
    dealt = events.sortWithinPartitions("book", "page", "below", "edge", drawn_row, "back", "rank").drop("back")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = [], []

        def read() -> Iterator[tuple]:
            """(book, page, below) and the (rank, at, event)s of each run of rows of one page and side."""
            for batch in batches:
                kinds[:] = [batch.schema.field(i).type for i in (0, 4)]
                keys, (rank, figure, at, *edges, text) = batch.columns[:3], batch.columns[3:]
                plain = lambda column: column.to_numpy(zero_copy_only=False).tolist()
                names = [None] * batch.num_rows
                for i, name in zip(np.flatnonzero(rank.to_numpy() == 2).tolist(), figure.drop_null().to_pylist(), strict=True):
                    names[i] = name
                words = pc.add(pc.count_substring(pc.fill_null(text, ""), " "), 1)
                events = zip(names, *map(plain, edges), plain(text), plain(pc.greater_equal(words, BODY_WORDS)), plain(pc.less_equal(words, CAPTION_WORDS)), strict=True)
                mine = list(zip(plain(rank), plain(at.fill_null(-1)), events, strict=True))
                codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy() if c.type != pa.bool_() else c.to_numpy(zero_copy_only=False) for c in keys]
                firsts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist(), len(mine)]
                for first, end in pairwise(firsts):
                    if end > first:
                        yield tuple(c[first].as_py() for c in keys), mine[first:end]

        def page_events(parts: Iterator[tuple]) -> Iterator[tuple]:
            head = None
            for _, part in parts:
                for rank, at, event in part:
                    if rank == 0:
                        head = at  # its block is the next row
                    elif rank == 2 or at != head:
                        yield event
                    else:
                        yield (*event[:7], False, False)

        def made() -> pa.RecordBatch:
            types = [kinds[0], kinds[1], pa.bool_(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["book", "figure", "below", "told", "caption"])
            out.clear()
            return batch

        for (book, _, below), mine in groupby(read(), key=itemgetter(0)):
            for figure, bodies, near in _beside(page_events(mine)):
                caption = near[0] if below and near and near[2] and near[1] <= CAPTION_GAP else None
                out.append((book, figure, below, " ".join(bodies if below else bodies[::-1]), caption))
                if len(out) == 500:
                    yield made()
        if out:
            yield made()

    found = dealt.mapInArrow(run, f"book {book_kind}, figure {kind}, below boolean, told string, caption string")
    side = lambda below: F.max(F.when(F.col("below") == below, F.col("told")))
    caption = F.max(F.when(may_be_caption(F.col("caption")), F.col("caption")))
    return found.groupBy("book", "figure").agg(side(False).alias("before"), side(True).alias("after"), F.coalesce(caption, F.lit("")).alias("caption"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _needles(words: Column, backwards: bool) -> Column:
    last = F.size(words) - NEEDLE
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(NEEDLE // 2))
    starts = F.concat(F.array(last), F.reverse(steps)) if backwards else F.concat(F.array(F.lit(0)), steps)
    runs = F.array_distinct(F.transform(F.slice(starts, 1, NEEDLES), lambda s: F.array_join(F.slice(words, s + 1, NEEDLE), " ")))
    return F.when(F.size(words) < FEWEST, F.array().cast("array<string>")).when(last <= 0, F.array(F.array_join(words, " "))).otherwise(runs)


def needles(text: Column, backwards: bool) -> Column:
    """Runs of NEEDLE words every half needle, nearest the figure first; a short anchor is one needle, a very short one none."""
    return once(_words(normalised(F.coalesce(text, F.lit("")))), lambda words: _needles(words, backwards))


def _marks(lines: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """For some lines at a time: hashes of each FEWEST neighbouring words of all of them in a row, the least of each NEEDLE words, and where each line's begin and how many it has."""
    for at in range(0, len(lines), LINES):
        words = [x.split() for x in lines.iloc[at : at + LINES]]
        n = np.array([len(w) for w in words], np.int64)
        codes, names = pd.factorize(np.array([w for line in words for w in line], object))
        h = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)[codes]
        out = np.zeros(max(len(h) - FEWEST + 1, 0), np.uint64)
        for i in range(FEWEST if len(out) else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        out = ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        least = np.lib.stride_tricks.sliding_window_view(out, SPAN).min(axis=1) if len(out) >= SPAN else out[:0]
        yield out, least, (np.cumsum(n) - n).tolist(), np.maximum(n - FEWEST + 1, 0).tolist()


@F.pandas_udf(ArrayType(LongType()))
def marks(lines: pd.Series) -> pd.Series:
    return pd.Series([np.unique(every[a : a + n]) for every, _, starts, own in _marks(lines) for a, n in zip(starts, own, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def least_marks(lines: pd.Series) -> pd.Series:
    """The least mark of each NEEDLE words, once each."""
    return pd.Series([np.unique(least[a : a + max(n - SPAN + 1, 0)]) for _, least, starts, own in _marks(lines) for a, n in zip(starts, own, strict=True)], dtype=object)


@F.pandas_udf(LongType())
def mark(needles: pd.Series) -> pd.Series:
    """By which a needle is found: its least mark, of a short one the first."""
    return pd.Series([int(least[a] if n >= SPAN else every[a]) for every, least, starts, own in _marks(needles) for a, n in zip(starts, own, strict=True)], dtype="int64")


def _paragraphs(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _plain)


def _starting(paragraphs: Column, position: Column) -> Column:
    """How many paragraphs start at or before a position (from 0) of the paragraphs in one line with a space on both sides."""
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + (p != "").cast("int")).alias("at"), (acc["n"] + (acc["at"] <= position).cast("int")).alias("n"))
    return F.aggregate(paragraphs, F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")), step)["n"]


def to_lessons(figures: DataFrame, lessons: DataFrame, by_file: bool = False) -> DataFrame:
    """course, figure, lesson, found_by, paragraph of every row of figures (course, figure, file, page, before, after).

    lessons: course, lesson, at (order in the course), unit, text (paragraphs parted by blank lines), first_page, last_page. A figure
    goes to a lesson that holds a needle of its anchors (the text before it first, the nearest needle first): of several to the first
    that covers its page, else the first of the unit that is its file, else the first. Without one, to the first of at most PAGE_LESSONS
    lessons on its page, if pages tell lessons of the course apart. by_file: its own unit's lessons come first in all this, and the
    unit's first lesson is the last resort. found_by is text, page, unit or null. paragraph is the number of paragraphs of the lesson
    before the figure less one (-1: before the first), null unless found by text.

    Anchors and lessons are made plain once and written. The nearest needle is looked for in the lessons of the figure's page first, if
    they are PAGE_TRIES or fewer: no other lesson comes before one of them. For figures left, all needles are cut; they and lessons meet by the least hash of FEWEST neighbouring words; a lesson tells the least hash of each NEEDLE words, a third of
    all. Short needles meet by their first words, for which lessons of their courses tell all hashes. Only what meets is compared in
    full; all fallbacks are one aggregate a figure. Null texts are empty, null or zero pages are unknown, lessons without an id or place are left out;
    a repeated figure (course, figure) is one.
    """
    plain = lambda column: F.coalesce(_plain(F.col(column)), F.lit("")).alias(column)
    once_each = figures.filter("figure IS NOT NULL").select("course", "figure", F.col("file").cast("long").alias("file"), F.nullif(F.col("page"), F.lit(0)).cast("long").alias("page"), "before", "after").dropDuplicates(["course", "figure"])
    asked = written(once_each.select("course", "figure", "file", "page", plain("before"), plain("after")), "figures")
    read = lessons.dropna(subset=["lesson", "at"]).select("course", "lesson", F.col("at").cast("long").alias("at"), F.col("unit").cast("long").alias("unit"), F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"), _paragraphs(F.col("text")).alias("paragraphs"))
    held = written(read, "lessons").withColumn("line", F.concat(F.lit(" "), F.array_join(F.filter("paragraphs", lambda p: p != ""), " "), F.lit(" ")))

    facts = ["course", "lesson", "at"]
    mine = F.col("unit").eqNullSafe(F.col("file"))
    on_page = F.coalesce(F.col("page").between(F.col("first_page"), F.col("last_page")), F.lit(False))

    def by_text(met: DataFrame) -> DataFrame:
        """course, figure, choice: the least of what met (course, figure, file, page, side, turn, needle, lesson, at) holds in full."""
        found = F.instr(F.col("line"), F.concat(F.lit(" "), F.col("needle"), F.lit(" "))) - 1
        hits = met.join(held.select(*facts, "unit", "first_page", "last_page", "paragraphs", "line"), facts).withColumn("position", found).filter("position >= 0")
        behind, ahead = _starting(F.col("paragraphs"), F.col("position") + F.length("needle")) - 1, _starting(F.col("paragraphs"), F.col("position") + 1) - 2
        hits = hits.withColumn("paragraph", F.when(F.col("side") == 0, behind).otherwise(ahead))
        abroad = ~mine if by_file else F.lit(False)
        rank = F.when(on_page, 0).when(mine, 1).otherwise(2)
        choice = F.struct(F.lit(0).alias("way"), "side", "turn", abroad.alias("abroad"), rank.alias("rank"), "at", "lesson", "paragraph")
        return hits.select("course", "figure", choice.alias("choice")).groupBy("course", "figure").agg(F.min("choice").alias("choice"))

    bins = F.sequence(F.floor(F.col("first_page") / PAGE_BIN), F.floor(F.col("last_page") / PAGE_BIN))
    telling = held.groupBy(F.col("course").alias("_course")).agg(F.min("first_page").alias("a"), F.max("first_page").alias("b"), F.min("last_page").alias("c"), F.max("last_page").alias("d")).filter("a < b OR c < d").select("_course")
    paged = held.filter("first_page <= last_page").join(telling, F.col("course") == F.col("_course"), "left_semi").select(*facts, "unit", "first_page", "last_page", F.explode(bins).alias("bin"))
    covering = asked.filter("page IS NOT NULL").select("course", "figure", "file", "page", F.floor(F.col("page") / PAGE_BIN).alias("bin")).join(paged, ["course", "bin"]).filter(on_page & (mine if by_file else F.lit(True)))
    covering = written(covering.select("figure", *facts), "covering")
    first = F.min(F.struct("at", "lesson")).alias("first")
    counted = covering.groupBy("course", "figure").agg(first, F.count("*").alias("n"))

    # the nearest needle of each figure in the lessons of its page
    size = lambda column: F.size(_words(F.col(column)))
    side = F.when(size("before") >= FEWEST, 0).when(size("after") >= FEWEST, 1)
    nearest = F.when(F.col("side") == 0, F.substring_index("before", " ", -NEEDLE)).otherwise(F.substring_index("after", " ", NEEDLE))
    tried = asked.withColumn("side", side).filter("side IS NOT NULL").select("course", "figure", "file", "page", "side", F.lit(0).alias("turn"), nearest.alias("needle"))
    tried = tried.join(counted.filter(F.col("n") <= PAGE_TRIES).select("course", "figure"), ["course", "figure"], "left_semi")
    near = written(by_text(tried.join(covering, ["course", "figure"])), "near")

    # all needles of the others in all lessons
    rest = asked.join(near, ["course", "figure"], "left_anti")
    brief = lambda column: (size(column) >= FEWEST) & (size(column) < NEEDLE)
    few = rest.filter(brief("before") | brief("after")).select(F.col("course").alias("_course")).distinct()
    cut = lambda column, backwards, side: F.struct(F.lit(side).alias("side"), once(_words(F.col(column)), lambda words: _needles(words, backwards)).alias("cut"))
    sought = rest.select("course", "figure", "file", "page", F.explode(F.array(cut("before", True, 0), cut("after", False, 1))).alias("s"))
    sought = sought.select("course", "figure", "file", "page", "s.side", F.posexplode("s.cut").alias("turn", "needle")).withColumns({"mark": mark("needle"), "short": F.size(F.split("needle", " ")) < NEEDLE})
    told = lambda rows, hashes, short: rows.select(*facts, F.explode(hashes("line")).alias("mark"), F.lit(short).alias("short"))
    dense = told(held.join(few, F.col("course") == F.col("_course"), "left_semi"), marks, True)
    met = sought.join(told(held, least_marks, False).union(dense), ["course", "mark", "short"]).drop("mark", "short")

    none = {"side": F.lit(0), "turn": F.lit(0), "abroad": F.lit(False), "rank": F.lit(0)}
    resort = lambda way, at, lesson: F.struct(F.lit(way).alias("way"), *(c.alias(n) for n, c in none.items()), at.alias("at"), lesson.alias("lesson"), F.lit(None).cast("int").alias("paragraph"))
    by_page = counted.filter(F.col("n") <= PAGE_LESSONS).select("course", "figure", resort(1, F.col("first.at"), F.col("first.lesson")).alias("choice"))
    ways = near.union(by_text(met)).union(by_page)
    if by_file:
        units = held.groupBy("course", F.col("unit").alias("file")).agg(first)
        ways = ways.union(asked.join(units, ["course", "file"]).select("course", "figure", resort(2, F.col("first.at"), F.col("first.lesson")).alias("choice")))
    chosen = ways.groupBy("course", "figure").agg(F.min("choice").alias("choice")).select("course", "figure", "choice.way", "choice.lesson", "choice.paragraph")
    way = F.when(F.col("way") == 0, "text").when(F.col("way") == 1, "page").when(F.col("way") == 2, "unit").alias("found_by")
    return asked.select("course", "figure").join(chosen, ["course", "figure"], "left").select("course", "figure", "lesson", way, "paragraph")
