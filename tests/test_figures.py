"""Figures: anchors and captions against whole pages, lessons against a plain program."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caudal.functions.text import collapsed, normalised
from caudal.operators import figures as G

BLOCKS, FIGURES = "book int, page int, at int, x0 double, y0 double, x1 double, y1 double, text string, figure int", "book int, page int, figure int, x0 double, y0 double, x1 double, y1 double, text string"
LESSONS, ASKED = "course int, lesson int, at int, unit int, text string, first_page int, last_page int, n int", "course int, figure int, file int, page int, before string, after string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def plain(text):
    return " ".join(re.sub(r"[^a-z0-9]", " ", (text or "").lower()).split())


def sides(blocks, figure):
    """before, after, caption of a figure from all blocks of its book."""
    book, page, _, x0, y0, x1, y1, _ = figure
    key = lambda t: re.sub(r"\d+", "#", plain(t))
    pages = {}
    for b in blocks:
        if b[0] == book and b[1] != 2:  # no figure stands on page 2
            pages.setdefault(key(b[7]), set()).add(b[1])
    mine = []
    for b in sorted((b for b in blocks if b[:2] == (book, page) and (b[7] or "").strip()), key=lambda b: b[2]):
        wide, high = min(b[5], x1) - max(b[3], x0), min(b[6], y1) - max(b[4], y0)
        area = (b[5] - b[3]) * (b[6] - b[4])
        if not (area and wide > 0 and high > 0 and wide * high / area > 0.5):
            mine.append((*b[:7], " ".join(b[7].split())))
    body = lambda b: len(b[7].split()) >= 6 and len(pages[key(b[7])]) < 3
    up, down = sorted((b for b in mine if b[6] <= y0 + 2), key=lambda b: -b[6]), sorted((b for b in mine if b[4] >= y1 - 2), key=lambda b: b[4])
    caption = ""
    if down and down[0][4] - y1 <= 20 and len(down[0][7].split()) <= 25 and len(pages[key(down[0][7])]) < 3 and not re.match(r"\d+$|.*:$|(•|\d+\.)\s", down[0][7]):
        caption = down[0][7]
    return " ".join(b[7] for b in [b for b in up if body(b)][:3][::-1]), " ".join(b[7] for b in [b for b in down if body(b)][:3]), caption


def test_anchors_by_whole_pages(spark):
    rng = random.Random(3)
    box = lambda high: (lambda x, y: (x, y, x + rng.choice([0, 40, 90]), y + rng.choice(high)))(float(rng.randrange(0, 60, 10)), float(rng.randrange(0, 90)))
    text = lambda: rng.choice(["Head of page 7 in this long book", "• " + " ".join(rng.choices(WORDS, k=3)), "12", "See:", " ", None, "a  short\ntext"] + [" ".join(rng.choices(WORDS, k=rng.choice([4, 8, 30]))) for _ in range(9)])
    blocks = [(b, p, n, *box([0, 1, 3, 12, 12]), text(), 0) for b in range(4) for p in range(4) for n in range(rng.choice([0, 5, 40]))]
    figures = [(b, p, 10 * p + n, *box([0, 5, 30]), "clash") for b in range(4) for p in (0, 1, 3, 4) for n in range(6)]
    odd = [(1, None, 900, 0.0, 0.0, 1.0, 1.0, ""), (1, 1, None, 0.0, 0.0, 1.0, 1.0, ""), figures[0]]
    got = G.anchors(spark.createDataFrame(blocks + [(0, 1, 9, None, 0.0, 1.0, 1.0, "no box", 0)], BLOCKS), spark.createDataFrame(figures + odd, FIGURES)).collect()
    assert {(r.book, r.figure): (r.before, r.after, r.caption) for r in got} == {(f[0], f[2]): sides(blocks, f) for f in figures}
    assert len(got) == len(figures) and sum(r.caption != "" for r in got) > 5
    assert G.anchors(spark.createDataFrame([], BLOCKS), spark.createDataFrame([], FIGURES)).count() == 0


def test_anchors_hold_few_blocks_of_a_long_page():
    held = []

    def events():
        for n in range(20000):
            yield None, float(n // 2), 0.0, n - 1.0, 9.0, float(n // 2), f"b{n}", n % 3 == 0, True
            held.append(max(len(v) for k, v in frames[0].gi_frame.f_locals.items() if k in ("bodies", "every")))
        yield 1, 9999.0 + G.TOUCH, 0.0, 9999.0, 9.0, 10009.0, None, None, None

    frames = []
    frames.append(G._beside(events()))
    assert [(f, bodies) for f, bodies, _ in frames[0]] == [(1, ["b19998", "b19995", "b19992"])]
    assert max(held) < 20


def cuts(text, backwards):
    words = plain(text).split()
    if len(words) < 4:
        return []
    if len(words) <= 8:
        return [" ".join(words)]
    every = list(range(0, len(words) - 7, 4))
    starts = [len(words) - 8, *every[::-1]] if backwards else [0, *every]
    return list(dict.fromkeys(" ".join(words[s : s + 8]) for s in starts[:8]))


def placed(figure, lessons, by_file):
    """(lesson, found_by, paragraph) of a figure by looking through all lessons of its course."""
    course, _, file, page, before, after = figure
    mine = sorted((x for x in lessons if x[0] == course), key=lambda x: x[2])
    pool = [x for x in mine if x[3] == file] if by_file else mine
    covers = lambda x: bool(page) and x[5] <= page <= x[6]
    for text, backwards in ((before, True), (after, False)):
        for cut in cuts(text, backwards):
            line = lambda x: " " + "".join(p + " " for p in map(plain, (x[4] or "").split("\n\n")) if p)
            found = [x for x in pool if f" {cut} " in line(x)] or [x for x in mine if f" {cut} " in line(x)]
            if found:
                one = next(iter([x for x in found if covers(x)] or [x for x in found if x[3] == file] or found))
                starts, at = [], 1
                for p in map(plain, (one[4] or "").split("\n\n")):
                    starts.append(at)
                    at += len(p) + bool(p)
                where = line(one).find(f" {cut} ")
                return one[1], "text", sum(s <= where + len(cut) for s in starts) - 1 if backwards else sum(s <= where + 1 for s in starts) - 2
    if page and len({x[5:7] for x in mine}) > 1:
        found = [x for x in pool if covers(x)]
        if 0 < len(found) <= 3:
            return found[0][1], "page", None
    if by_file and pool:
        return pool[0][1], "unit", None
    return None, None, None


@pytest.mark.parametrize("by_file", [False, True])
def test_lessons_by_a_plain_program(spark, by_file):
    rng = random.Random(7)
    text = lambda most: " ".join(rng.choices(WORDS[:3], k=rng.randrange(most)))
    lessons = [(c, n, n, n // 3, "\n\n".join(text(14) for _ in range(rng.randrange(5))), n if c else 1, n + rng.choice([0, 1, 40]) if c else 1, 0) for c in range(4) for n in range(10)]
    lessons[4] = (*lessons[4][:4], None, *lessons[4][5:])
    cut = lambda: rng.choice([None, "", "alpha", text(30), text(9), " ".join((rng.choice(lessons)[4] or "").split()[:9])])
    figures = [(c, n, rng.choice([0, 1, 2, 9, None]), rng.choice([None, 0, 3, 12, 60]), cut(), cut()) for c in range(5) for n in range(60)]
    got = G.to_lessons(spark.createDataFrame(figures + figures[:3], ASKED), spark.createDataFrame(lessons, LESSONS), by_file).collect()
    assert {(r.course, r.figure): (r.lesson, r.found_by, r.paragraph) for r in got} == {f[:2]: placed(f, lessons, by_file) for f in figures}
    assert len(got) == len(figures) and {r.found_by for r in got} == {None, "text", "page", *(["unit"] if by_file else [])}
    assert G.to_lessons(spark.createDataFrame([], ASKED), spark.createDataFrame(lessons, LESSONS)).count() == 0
    assert G.to_lessons(spark.createDataFrame(figures, ASKED), spark.createDataFrame([], LESSONS)).filter("lesson IS NULL").count() == len(figures)


def test_texts_are_made_plain_once(spark):
    """One filter of words a text; a column that names its words ten times over has each of them worked out anew."""
    for backwards in (False, True):
        told = G.needles(F.col("before"), backwards)._jc.toString()
        assert told.count("translate(") == 1


def test_marks_are_those_of_each_line_alone(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 4, 7, 8, 9, 40]))) for _ in range(1203)]
    rows = spark.createDataFrame(enumerate(lines), "id int, line string").coalesce(1)
    found = {r.line: (r.every, r.least) for r in rows.select("line", G.marks("line").alias("every"), G.least_marks("line").alias("least")).collect()}
    alone = {}
    for line in set(lines):
        words = line.split()
        starts = range(len(words) - 3)
        alone |= {" ".join(words[i : i + 4]): None for i in starts}
    names = spark.createDataFrame([(x,) for x in alone], "line string").coalesce(1).select("line", G.mark("line").alias("mark")).collect()
    alone = {r.line: r.mark for r in names}
    for line, (every, least) in found.items():
        words = line.split()
        mine = [alone[" ".join(words[i : i + 4])] for i in range(len(words) - 3)]
        assert every == sorted(set(mine)) and least == sorted({min(mine[i : i + 5]) for i in range(len(mine) - 4)})


def test_anchors_move_each_text_once_to_its_page(spark):
    """Marks of heads, blocks and figures meet in one shuffle by page; a join of texts with what figures ask for moved them by place too."""
    blocks = [(b, p, n, 0.0, 10.0 * n, 90.0, 10.0 * n + 8, f"Head {p} of a book that goes on" if n == 0 else " ".join(WORDS[n % 3 :]), 0) for b in (1, None) for p in range(5) for n in range(30)]
    figures = [(b, p, 100 * p + n, 0.0, 10.0 * n + 8.5, 50.0, 10.0 * n + 9.5, "") for b in (1, None) for p in range(5) for n in range(0, 29, 7)]
    found = G.anchors(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(figures, FIGURES))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "told" not in "".join(line for line in plan.splitlines() if "Join" in line)
    assert plan.count("RepartitionByExpression") == 1
    got = found.collect()
    assert {r.before for r in got if r.figure % 100 == 0} == {""}
    assert len(got) == len(figures)


def test_figures_on_their_page_cut_no_other_needles(spark, monkeypatch):
    """What the nearest needle finds on the figure's page comes first, so no mark of its other needles is told."""
    @F.pandas_udf("long")
    def never(needles: pd.Series) -> pd.Series:
        assert not len(needles)
        return pd.Series([], dtype="int64")

    monkeypatch.setattr(G, "mark", never)
    words = [f"word{i}" for i in range(400)]
    lessons = [(1, n, n, 0, " ".join(words[40 * n : 40 * n + 40]) + "\n\nthe end", n + 1, n + 1, 0) for n in range(10)]
    figures = [(1, n, 0, n + 1, " ".join(words[40 * n : 40 * n + 30]), "") for n in range(10)]
    figures += [(1, 10 + n, 0, n + 1, "too short", " ".join(words[40 * n + 5 : 40 * n + 30])) for n in range(10)]
    found = G.to_lessons(spark.createDataFrame(figures, ASKED), spark.createDataFrame(lessons, LESSONS)).collect()
    assert sorted((r.figure, r.lesson, r.found_by, r.paragraph) for r in found) == [(n, n % 10, "text", 0 if n < 10 else -1) for n in range(20)]


def test_plain_and_even_texts(spark):
    texts = ["", " a  b ", "a\tb", "a\n\nb c", "Ça  été ñandú", "á b", "ｆull ½ x", "A, b. C-d", None, "\r", "one two three"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", G._even(F.col("x")).alias("even"), collapsed(F.col("x")).alias("collapsed"), G._plain(F.col("x")).alias("plain"), normalised(F.col("x")).alias("normalised")).collect()
    assert all(r.even == r.collapsed and r.plain == r.normalised for r in rows) and len(rows) == len(texts)
