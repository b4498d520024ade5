"""Paragraphs from the physical lines of laid-out books: lines of one sentence joined, labels that cut a word in two moved behind it."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signs that end a sentence, marks of list items, labels that open a chapter, letters that go on with a word or a sentence.
SOFT = "­"
ENDS = re.compile(r"[.!?…:;»”\"')\]]$")
ITEM = re.compile(r"(?:[•·●▪◦‣\-–—*]\s+|\d{1,2}[.)]\s+|[a-z][.)]\s+)")
OPENER = re.compile(r"(?:cap[ií]tulo|unidad|m[oó]dulo)(?:\s+\d+)?[\s.:\-–]*", re.IGNORECASE)
LOWER, GOES_ON = re.compile(r"[a-záéíóúñü]"), re.compile(r"[a-záéíóúñü0-9(«“\"]")
# Lines looked ahead, words of a label, labels of an opening, difference in size; gaps in line heights within an open sentence, between sentences, and beyond any.
AHEAD, LABEL_WORDS, OPENING, SIZE, OPEN_GAP, CLOSED_GAP, ANY_GAP = 40, 4, 4, 0.6, 0.6, 0.3, 0.45


class Line(NamedTuple):
    """A physical line; page_height is 0 where the source has paragraphs instead of lines."""

    page: int
    text: str
    size: float
    y0: float
    y1: float
    page_height: float


def plain(text: str | None) -> str:
    letters = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z0-9]", " ", letters).split())


def ends(text: str) -> bool:
    return bool(ENDS.search(text.rstrip()))


def compound(a: str, b: str) -> bool:
    """Whether a ends in a hyphen within a word that b goes on with; the hyphen stays."""
    return a.endswith("-") and a[-2:-1].isalpha() and b[:1].islower()


def goes_on(a: str, b: str) -> bool:
    """Whether line b goes on with the sentence of line a, whatever lies between them."""
    a = a.rstrip()
    if a.endswith(SOFT):
        return bool(LOWER.match(b))
    return compound(a, b) or not (ends(a) or ITEM.match(b)) and bool(GOES_ON.match(b))


def apart(a: Line, b: Line) -> bool:
    """Whether line b begins a paragraph where it does not go on with a sentence, by its place and size."""
    if ITEM.match(b.text) or not (a.page_height and b.page_height):
        return True
    height, gap = max(a.y1 - a.y0, 1.0), b.y0 - a.y1
    if a.page != b.page or gap < -height:  # another page or column
        return ends(a.text)
    if abs(b.size - a.size) > SIZE:
        return True
    if ends(a.text):
        return gap > CLOSED_GAP * height
    return gap > OPEN_GAP * height


def straightened(lines: Iterator[Line]) -> Iterator[Line]:
    """The lines with labels moved behind the sentence that they interrupt.

    Only where a line ends in a soft hyphen and the next one cannot go on with the word: among the next AHEAD lines the first of the
    same size in lower case goes on with it if only short labels lie between. Held are the lines looked ahead and an interrupted sentence.
    """
    held: deque[Line] = deque()

    def fill(n: int) -> bool:
        while len(held) < n and (line := next(lines, None)) is not None:
            held.append(line)
        return len(held) >= n

    while fill(AHEAD + 1) or held:
        first = held[0]
        if first.page_height and first.text.rstrip().endswith(SOFT) and len(held) > 1 and not LOWER.match(held[1].text.strip()):
            behind = 1
            while behind < min(len(held), AHEAD + 1):
                text = held[behind].text.strip()
                if abs(held[behind].size - first.size) <= SIZE and LOWER.match(text):
                    break
                behind = behind + 1 if len(text.split()) <= LABEL_WORDS else AHEAD + 1
            if behind < min(len(held), AHEAD + 1):
                until = behind
                while fill(until + 1) and not ends(held[until].text):
                    until += 1
                rest = list(held)
                until = min(until + 1, len(rest))
                held = deque([first, *rest[behind:until], *rest[1:behind], *rest[until:]])
        yield held.popleft()


def paragraphs(lines: Iterator[Line], title: str | None = None) -> Iterator[tuple[str, int, int]]:
    """(text, first page, last page) of each paragraph; blank lines, the title alone on a line and opening labels are left out. One paragraph is held."""
    name, opening, before, texts, pages = plain(title), 0, None, [], (0, 0)

    def whole() -> tuple[str, int, int]:
        return re.sub(r"\s{2,}", " ", "".join(texts).replace(SOFT, "")).strip(), *pages

    for line in straightened(x for x in lines if not (name and plain(x.text) == name)):
        text = line.text.strip()
        if not text:
            continue
        if opening < OPENING and OPENER.fullmatch(text):
            opening += 1
            continue
        opening = OPENING
        line = line._replace(text=text)
        if before and (goes_on(before.text, text) or not apart(before, line)):
            whole_word = before.text.endswith(SOFT) and text[:1].islower() or compound(before.text, text)
            texts += [text] if whole_word else [" ", text]
            pages = pages[0], max(pages[1], line.page)
        else:
            if texts:
                yield whole()
            texts, pages = [text], (line.page, line.page)
        before = line
    if texts:
        yield whole()


PARAGRAPHS = "place int, text string, page int, page_end int"


def book_paragraphs(lines: DataFrame) -> DataFrame:
    """book, place, text, page, page_end of lines (book, title, at, page, text, size, y0, y1, page_height), in order of at.

    One ordered pass over each partition: a book is never held, only the lines looked ahead and a paragraph. Null texts are blank lines,
    null numbers 0; the first line of a book tells its title (null: none).
    """
    kind = lines.schema["book"].dataType.simpleString()
    columns = ["book", "title", "page", "text", "size", "y0", "y1", "page_height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book_kind, out = None, []

        def rows() -> Iterator[tuple]:
            nonlocal book_kind
            for batch in batches:
                book_kind = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def told() -> pa.RecordBatch:
            book, place, text, page, end = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(book, book_kind), pa.array(place, pa.int32()), pa.array(text), pa.array(page, pa.int32()), pa.array(end, pa.int32())], names=["book", "place", "text", "page", "page_end"])

        for book, mine in groupby(rows(), key=lambda r: r[0]):
            first = next(mine)
            every = (Line(r[2] or 0, r[3] or "", *(x or 0.0 for x in r[4:])) for part in ([first], mine) for r in part)
            for place, found in enumerate(paragraphs(every, first[1]), 1):
                out.append((book, place, *found))
                if len(out) == 1000:
                    yield told()
                    out.clear()
        if out:
            yield told()

    return lines.select(*columns, "at").repartition("book").sortWithinPartitions("book", "at").drop("at").mapInArrow(run, f"book {kind}, {PARAGRAPHS}")


def typeset(texts: DataFrame, width: int = 60, lines: int = 30) -> DataFrame:
    """Lines of texts (book, text) as a printer sets them: cut every `width` characters with a soft hyphen within words, so many lines a page, with a label of another size after every 17th line."""
    flat = F.regexp_replace(F.col("text"), r"\s+", " ")
    seams = F.regexp_replace(F.regexp_replace(flat, rf"(.{{{width}}})(?=.)", "$1\n"), r"(\p{L})\n(?=\p{L})", f"$1{SOFT}\n")
    cut = texts.select("book", F.posexplode(F.split(seams, "\n")).alias("n", "line")).filter("line <> ''")
    n, y = F.col("n"), (F.col("n") % lines).cast("double") * 13
    common = [F.lit(None).cast("string").alias("title"), (F.floor(n / lines) + 1).cast("int").alias("page")]
    row = cut.select("book", *common, (n * 2).alias("at"), F.col("line").alias("text"), F.lit(12.0).alias("size"), y.alias("y0"), (y + 10).alias("y1"), F.lit(800.0).alias("page_height"))
    label = cut.filter("n % 17 = 16").select("book", *common, (n * 2 + 1).alias("at"), F.concat(F.lit("Label "), n.cast("string")).alias("text"), F.lit(9.0).alias("size"), (y + 11).alias("y0"), (y + 12).alias("y1"), F.lit(800.0).alias("page_height"))
    return row.union(label)
