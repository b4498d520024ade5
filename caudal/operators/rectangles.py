"""Rectangles of a page that overlap or nearly do, made one until nothing changes."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

GAP = 8.0  # Fixed value: rectangles nearer than this are one
Box = tuple[float, float, float, float]


def swept(boxes: list[Box], gap: float) -> list[Box]:
    """One pass from left to right: a box is united with those open ones that it meets.

    The open boxes never meet each other, so they are apart in y where they are alive in x, and those that a new box can meet stand
    next to each other in the order of y; each is met once, since it is then part of the union.
    """
    opened: list[tuple[float, float, float, float]] = []  # (y0, y1, x0, x1) by y0; y1 rises too
    closed: list[Box] = []
    for x0, y0, x1, y1 in sorted(boxes):
        changed = True
        while changed:
            changed = False
            at = bisect_left(opened, (y0 - gap,))
            # the one before may reach into the box from below
            while at > 0 and opened[at - 1][1] > y0 - gap:
                at -= 1
            while at < len(opened) and opened[at][0] < y1 + gap:
                b0, b1, a0, a1 = opened[at]
                if b1 <= y0 - gap:
                    at += 1
                elif a1 <= x0 - gap:
                    closed.append((a0, b0, a1, b1))
                    del opened[at]
                else:
                    del opened[at]
                    x0, y0, x1, y1 = min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1)
                    changed = True
        opened.insert(bisect_left(opened, (y0, y1, x0, x1)), (y0, y1, x0, x1))
    return closed + [(a0, b0, a1, b1) for b0, b1, a0, a1 in opened]


def united(boxes: list[Box], gap: float = GAP) -> list[Box]:
    """Boxes (x0, y0, x1, y1) of which no two meet: unions grow, so passes are repeated until none unites anything.

    Two boxes meet where one, grown by gap on all sides, overlaps the other by an area or a line, not by a touch. What comes out does
    not depend on the order, since boxes that meet still do when one of them has grown.
    """
    while len(fewer := swept(boxes, gap)) < len(boxes):
        boxes = fewer
    return sorted(fewer, key=lambda b: (round(b[1]), b[0], b))


def merged(rows: DataFrame, page: str, gap: float = GAP) -> DataFrame:
    """page, place (by y, then x), x0, y0, x1, y1 of rows (page, x0, y0, x1, y1). A group is one page, numbers only; rows with a null side are left out."""
    sides = ["x0", "y0", "x1", "y1"]

    def run(part: pa.Table) -> pa.Table:
        found = united(list(zip(*(part.column(c).to_pylist() for c in sides), strict=True)), gap)
        columns = {c: pa.array([b[i] for b in found], pa.float64()) for i, c in enumerate(sides)}
        key = part.column(page).slice(0, 1).combine_chunks().take(pa.array([0] * len(found)))
        return pa.table({page: key, "place": pa.array(range(1, len(found) + 1), pa.int32()), **columns})

    whole = rows.select(page, *sides).dropna(subset=sides)
    shape = ", ".join(f"{c} double" for c in sides)
    return whole.groupBy(page).applyInArrow(run, f"{page} {rows.schema[page].dataType.simpleString()}, place int, {shape}")
