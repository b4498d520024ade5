"""Replay of an edit log on course plans: units of lessons that are renamed, moved, merged, split and deleted, with conflicts as rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

# How ids and names of merged, split and new parts are made, and the size of a merged lesson without one of its own.
JOINED, PARTS, NEW_UNIT, CONTINUED, TARGET = "{}+{}", ("{}-a", "{}-b"), "U-{}", "{} (cont.)", 1200
PART_MARK = re.compile(r"\s*—\s*parte\s*\d+\s*$", re.IGNORECASE)
CONTINUED_MARK = re.compile(r"\s*\(cont\.\)\s*$", re.IGNORECASE)
BLANK, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")

FIGURES = "array<struct<id: string, paragraph: int, caption: string, alt: string, gallery: boolean>>"
LESSONS = f"plan string, unit_id string, unit_name string, category string, unit_at int, lesson_id string, name string, text string, first_page int, last_page int, words int, target int, lesson_at int, figures {FIGURES}"
ITEMS = "plan string, item string, at string, accepted boolean, on string, target string, op string, args map<string,string>"
OUTCOMES = "item string, outcome string, reason string, moved_to string"
FIGURE = pa.struct([("id", pa.string()), ("paragraph", pa.int32()), ("caption", pa.string()), ("alt", pa.string()), ("gallery", pa.bool_())])
UNIT_FIELDS, LESSON_FIELDS = ("unit_id", "unit_name", "category"), ("lesson_id", "name", "text", "first_page", "last_page", "words", "target", "figures")


class Conflict(Exception):
    """An edit that no longer fits the plan; its text is the reason."""


def pieces(text: str, pattern: re.Pattern) -> list[str]:
    return [p.strip() for p in pattern.split(text or "") if p.strip()]


def plain_name(name: str) -> str:
    """A lesson's name without marks of being a part; as it is where nothing would be left."""
    return CONTINUED_MARK.sub("", PART_MARK.sub("", name or "")) or name


class Replay:
    """One plan while its log is replayed. Lessons are dicts, so that they keep all their fields wherever they go."""

    def __init__(self, units: list[dict]) -> None:
        self.units = units

    # Where things are.

    def unit(self, unit_id: str | None) -> int:
        for i, u in enumerate(self.units):
            if u["unit_id"] == unit_id:
                return i
        raise Conflict("no_unit")

    def lesson(self, lesson_id: str | None) -> tuple[list[dict], int, int]:
        """The lessons of its unit, its place there, and the unit's place."""
        for i, u in enumerate(self.units):
            for j, x in enumerate(u["lessons"]):
                if x["lesson_id"] == lesson_id:
                    return u["lessons"], j, i
        raise Conflict("no_lesson")

    @staticmethod
    def figure(lesson: dict, figure: str) -> dict:
        for f in lesson["figures"] or []:
            if f["id"] == figure:
                return f
        raise Conflict("no_figure")

    @staticmethod
    def swap(rows: list, i: int, by: str | None) -> None:
        j = i + int(by or 0)
        if j == i or not 0 <= j < len(rows):
            raise Conflict("out_of_range")
        rows[i], rows[j] = rows[j], rows[i]

    # Edits of units: (place of the unit, arguments).

    def unit_rename(self, i: int, args: dict) -> None:
        self.units[i]["unit_name"] = args["name"]

    def unit_category(self, i: int, args: dict) -> None:
        self.units[i]["category"] = args["category"]

    def unit_move(self, i: int, args: dict) -> None:
        self.swap(self.units, i, args.get("by"))

    def unit_merge(self, i: int, args: dict) -> None:
        if i + 1 == len(self.units):
            raise Conflict("no_next")
        self.units[i]["lessons"] += self.units.pop(i + 1)["lessons"]

    def unit_delete(self, i: int, args: dict) -> None:
        self.units.pop(i)

    # Edits of lessons: (lessons of the unit, place there, place of the unit, arguments).

    def lesson_rename(self, rows: list, j: int, i: int, args: dict) -> None:
        rows[j]["name"] = args["name"]

    def lesson_target(self, rows: list, j: int, i: int, args: dict) -> None:
        rows[j]["target"] = int(args["words"])

    def lesson_text(self, rows: list, j: int, i: int, args: dict) -> None:
        text, old = rows[j]["text"] or "", args["find"]
        times = text.count(old) if old else 0
        if times != 1:
            raise Conflict("text_ambiguous" if times else "text_missing")
        rows[j]["text"] = text.replace(old, args.get("replace") or "")
        rows[j]["words"] = len(rows[j]["text"].split())

    def lesson_reorder(self, rows: list, j: int, i: int, args: dict) -> None:
        self.swap(rows, j, args.get("by"))

    def lesson_merge(self, rows: list, j: int, i: int, args: dict) -> None:
        if j + 1 == len(rows):
            raise Conflict("no_next")
        a, b = rows[j], rows[j + 1]
        if args.get("with") and args["with"] != b["lesson_id"]:
            raise Conflict("other_next")
        paged = [x for x in (a, b) if x["first_page"]]
        shift = len(pieces(a["text"], BLANK))
        moved = [{**f, "paragraph": None if f["paragraph"] is None else f["paragraph"] + shift} for f in b["figures"] or []]
        rows[j : j + 2] = [
            {
                **a,
                "lesson_id": JOINED.format(a["lesson_id"], b["lesson_id"]),
                "name": plain_name(a["name"]),
                "text": f"{a['text'] or ''}\n\n{b['text'] or ''}",
                "first_page": min((x["first_page"] for x in paged), default=0),
                "last_page": max((x["last_page"] or x["first_page"] for x in paged), default=0),
                "words": (a["words"] or 0) + (b["words"] or 0),
                "target": max(a["target"] or 0, b["target"] or 0) or TARGET,
                "figures": (a["figures"] or []) + moved if a["figures"] or b["figures"] else a["figures"],
            }
        ]

    def lesson_split(self, rows: list, j: int, i: int, args: dict) -> None:
        x, k = rows[j], int(args["at"])
        paragraphs = pieces(x["text"], BLANK)
        parts = paragraphs if len(paragraphs) > 1 else pieces(x["text"], SENTENCE)
        if not 0 < k < len(parts):
            raise Conflict("bad_cut")
        texts = ["\n\n".join(parts[:k]), "\n\n".join(parts[k:])]
        words = [len(t.split()) for t in texts]
        pages = [(0, 0), (0, 0)]
        if first := x["first_page"]:
            last = x["last_page"] or first
            # the page of the cut in proportion to the words, halves upwards
            middle = (2 * (first * sum(words) + (last - first) * words[0]) + sum(words)) // (2 * sum(words))
            pages = [(first, middle), (middle, last)]
        behind = [f for f in x["figures"] or [] if len(paragraphs) > 1 and f["paragraph"] is not None and f["paragraph"] >= k]
        figures = [[f for f in x["figures"] or [] if f not in behind], [{**f, "paragraph": f["paragraph"] - k} for f in behind]]
        name = plain_name(x["name"])
        names = [name, CONTINUED.format(name)]
        rows[j : j + 1] = [
            {**x, "lesson_id": PARTS[p].format(x["lesson_id"]), "name": names[p], "text": texts[p], "words": words[p], "first_page": pages[p][0], "last_page": pages[p][1], "figures": None if x["figures"] is None else figures[p]}
            for p in (0, 1)
        ]

    def lesson_move(self, rows: list, j: int, i: int, args: dict) -> None:
        to = self.unit(args["unit"])
        if to == i:
            raise Conflict("same_unit")
        # back to an earlier unit's end, on to a later unit's start: the order of the book
        there = self.units[to]["lessons"]
        there.insert(len(there) if to < i else 0, rows.pop(j))

    def lesson_new_unit(self, rows: list, j: int, i: int, args: dict) -> None:
        if j == 0:
            raise Conflict("first_already")
        rest, rows[j:] = rows[j:], []
        name = args.get("name") or plain_name(rest[0]["name"])
        self.units.insert(i + 1, {"unit_id": NEW_UNIT.format((rest[0]["lesson_id"] or "")[2:10]), "unit_name": name, "category": self.units[i]["category"], "lessons": rest})

    def lesson_delete(self, rows: list, j: int, i: int, args: dict) -> None:
        rows.pop(j)

    def lesson_figure_drop(self, rows: list, j: int, i: int, args: dict) -> None:
        rows[j]["figures"].remove(self.figure(rows[j], args["figure"]))

    def lesson_figure_caption(self, rows: list, j: int, i: int, args: dict) -> None:
        f = self.figure(rows[j], args["figure"])
        f["caption"] = args.get("caption") or ""
        if "alt" in args:
            f["alt"] = args["alt"]

    def lesson_figure_move(self, rows: list, j: int, i: int, args: dict) -> None:
        f, (to, at, _) = self.figure(rows[j], args["figure"]), self.lesson(args.get("lesson") or rows[j]["lesson_id"])
        paragraph = int(args["paragraph"]) if args.get("paragraph") is not None else None
        rows[j]["figures"].remove(f)
        placed = {**f, "paragraph": paragraph, "gallery": f["gallery"] if paragraph is None else None}
        to[at]["figures"] = sorted([*(to[at]["figures"] or []), placed], key=lambda g: (g["paragraph"] is None, g["paragraph"] or 0))

    # The log.

    def moved_text(self, target: str | None, args: dict) -> str | None:
        """The lesson that a text edit means whose own lesson is gone: the only one that holds the text, once."""
        lessons = [x for u in self.units for x in u["lessons"]]
        if not args.get("find") or any(x["lesson_id"] == target for x in lessons):
            return None
        holders = [x for x in lessons if args["find"] in (x["text"] or "")]
        if len(holders) != 1 or holders[0]["text"].count(args["find"]) > 1:
            raise Conflict("moved_ambiguous" if holders else "moved_missing")
        return holders[0]["lesson_id"]

    def edit(self, on: str | None, target: str | None, op: str, args: dict) -> str | None:
        """Applies one edit; returns the lesson it was moved to, if it was."""
        kind = "unit" if on == "unit" else "lesson"
        todo: Callable | None = getattr(self, f"{kind}_{op}", None)
        moved = self.moved_text(target, args) if (kind, op) == ("lesson", "text") else None
        place = (self.unit(target),) if kind == "unit" else self.lesson(moved or target)
        if todo is None:
            raise Conflict("unknown_op")
        try:
            todo(*place, args)
        except (KeyError, ValueError, TypeError):
            raise Conflict("bad_args") from None
        self.units = [u for u in self.units if u["lessons"]]
        return moved


def _replay(lessons: pa.Table, items: pa.Table) -> tuple[list[dict], list[dict]]:
    units: list[dict] = []
    for row in lessons.sort_by([("unit_at", "ascending"), ("lesson_at", "ascending"), ("lesson_id", "ascending")]).to_pylist():
        if not units or units[-1]["unit_at"] != row["unit_at"]:
            units.append({**{k: row[k] for k in UNIT_FIELDS}, "unit_at": row["unit_at"], "lessons": []})
        units[-1]["lessons"].append({k: row[k] for k in LESSON_FIELDS})
    plan, outcomes = Replay(units), []
    for row in sorted(items.to_pylist(), key=lambda r: (r["at"] or "", r["item"] or "")):
        out = {"item": row["item"], "outcome": "ignored", "reason": None, "moved_to": None}
        if row["accepted"] and row["op"]:
            try:
                out |= {"moved_to": plan.edit(row["on"], row["target"], row["op"], dict(row["args"] or [])), "outcome": "applied"}
            except Conflict as conflict:
                out |= {"outcome": "conflict", "reason": str(conflict)}
        outcomes.append(out)
    edited = [{**{k: u[k] for k in UNIT_FIELDS}, "unit_at": i, "lesson_at": j, **x} for i, u in enumerate(plan.units, 1) for j, x in enumerate(u["lessons"], 1)]
    return edited, outcomes


def replay(lessons: DataFrame, items: DataFrame) -> DataFrame:
    """plan, and either `lesson` (a lesson of the edited plan, numbered anew) or `outcome` (of an item): all plans' logs replayed.

    lessons is LESSONS (units are told apart by unit_at), items is ITEMS; a plan's items go by (at, item). A group is one plan with its
    log. Not accepted items and those without op are ignored; an edit that does not fit changes nothing and is a conflict with its reason.
    Units left without lessons go. Items of plans without lessons are conflicts; null text counts as ''.
    """
    lesson_kind = pa.struct([(n, {"string": pa.string(), "int": pa.int32()}[t]) for n, t in (f.split() for f in LESSONS.split(", figures")[0].split(", ")) if n != "plan"] + [("figures", pa.list_(FIGURE))])
    outcome_kind = pa.struct([(f.split()[0], pa.string()) for f in OUTCOMES.split(", ")])

    def run(key: tuple, mine: pa.Table, log: pa.Table) -> pa.Table:
        edited, outcomes = _replay(mine, log)
        n, m = len(edited), len(outcomes)
        rows = pa.array(edited + [None] * m, lesson_kind), pa.array([None] * n + outcomes, outcome_kind)
        return pa.table({"plan": pa.array([key[0].as_py()] * (n + m), pa.string()), "lesson": rows[0], "outcome": rows[1]})

    names = [f.split()[0] for f in LESSONS.split(", figures")[0].split(", ")] + ["figures"]
    shape = LESSONS.removeprefix("plan string, ")
    lesson_shape = ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in shape.split(", figures")[0].split(", "))) + f", figures: {FIGURES}"
    outcome_shape = ", ".join(f"{f.split()[0]}: string" for f in OUTCOMES.split(", "))
    asked = items.select(*[f.split()[0] for f in ITEMS.split(", ")])
    return lessons.select(*names).groupBy("plan").cogroup(asked.groupBy("plan")).applyInArrow(run, f"plan string, lesson struct<{lesson_shape}>, outcome struct<{outcome_shape}>")


def edited_lessons(replayed: DataFrame) -> DataFrame:
    return replayed.filter("lesson is not null").select("plan", "lesson.*")


def outcomes(replayed: DataFrame) -> DataFrame:
    return replayed.filter("outcome is not null").select("plan", "outcome.*")
