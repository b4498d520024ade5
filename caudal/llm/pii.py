"""Personal data: exact patterns over whole texts, and a character BiLSTM-CRF that adds what the patterns miss.

The tagger (tagger.py) is trained from labelled spans: those that the patterns find in a bounded sample of the documents, and
MADE_UP numbers and addresses set into such documents' windows, many in forms that the patterns do not cover. The sample's bounds:
TRAIN_DOCS documents (those of the smallest hash), TRAIN_CHARS characters of each, around its first trigger; of these at most
TRAIN_TEXTS texts and TRAIN_WINDOWS windows of each give windows without made-up items. Tagging itself has no bound. A span that passes plausible() holds a digit, an at sign or a spoken at
(AT), so windows are laid, with overlap, over all places near one; words that stand for @ and the dots near them have these
signs' classes. Windows are decoded one by one; one whose span touches its edge is decoded again, longer on that side, until the
span is whole or over LONGEST (the longest address there can be). The spans of a document's windows are then
reconciled: of those that overlap, the set of the greatest total margin stays. A span's
margin is its log-odds against no span in its place, moves between tags included.
A tagger's span is added if it does not touch a pattern's span and its digits pass the kind's check.

Defined cases: null text counts as empty and has no spans; a very long text is cut into windows, never cut off;
repeated rows give repeated results (of rows with one doc_id one text is trained on); a null doc_id is searched and never trained
on; spans of equal start are listed by kind; an empty table gives no rows (and the tagger learns from made-up spans only);
extra columns, whatever their names, are not read by `find_spans` and stay in `mask`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, smallest, tidied
from .tagger import CLASS_OF, KINDS, PAD, Tagger, classes

TRAIN_DOCS, TRAIN_CHARS, TRAIN_TEXTS, TRAIN_WINDOWS, MADE_UP, STEPS = 4000, 600, 1500, 20, 2600, 220
WINDOW, STRIDE, MARGIN = 64, 32, 24
SURE = 1.0
LONGEST = 320
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
NOT_DIGITS = re.compile(r"[^0-9]")
#: Spoken signs: at or dot in brackets, dot as a word, at as a word if a name and a spoken dot follow.
AT = re.compile(r"[\[({]\s?(at)\s?[\])}]|(?<=\s)(at)(?=\s[^\s@]{1,255}\s?(?:\sdot\s|[\[({]\s?dot\s?[\])}]))", re.I)
DOT = re.compile(r"[\[({]\s?(dot)\s?[\])}]|(?<=\s)(dot)(?=\s)", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in re.split(r"[^0-9]+", text)))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern; each at sign's name is read backwards once, so the time is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def coded(text: str) -> np.ndarray:
    """Character classes, with those of @ and . for spoken signs."""
    out = classes(text)
    spoken = [m.span(m.lastindex) for m in AT.finditer(text)]
    for a, b in spoken:
        out[a:b] = CLASS_OF[ord("@")]
    if spoken or "@" in text:
        for m in DOT.finditer(text):
            out[slice(*m.span(m.lastindex))] = CLASS_OF[ord(".")]
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows, STRIDE apart, that cover every trigger (also a spoken at) with MARGIN on both sides."""
    starts, reach = [], -1
    for at in sorted({m.start() for r in (TRIGGER, AT) for m in r.finditer(text)}):
        if at + MARGIN <= reach:
            continue
        start = max(0, at - MARGIN) if not starts or at - MARGIN > reach else starts[-1] + STRIDE
        starts.append(start)
        reach = start + WINDOW
        while at + MARGIN > reach:
            starts.append(starts[-1] + STRIDE)
            reach = starts[-1] + WINDOW
    return starts


def plausible(kind: str, text: str) -> bool:
    """A tagger's span must hold what its kind holds."""
    digits = NOT_DIGITS.sub("", text)
    if kind == "email":
        text = DOT.sub(".", AT.sub("@", text))
        return re.fullmatch(r"[^\s@]+(?:\s?@\s?)[^\s@]+(?:\s?\.\s?[A-Za-z0-9-]+)+", re.sub(r"\s+(?=[@.])|(?<=[@.])\s+", " ", text)) is not None
    if kind == "ip":
        return len(re.findall("[0-9]+", text)) == 4 and small_parts(text.strip("[]() ")) and len(digits) >= 6
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and re.fullmatch(r"(?:\+|00|\()[0-9][0-9\x20()./-]*[0-9]", text) is not None


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping spans the disjoint set with the greatest total score (weighted interval scheduling)."""
    best = {}
    for a, b, kind, score in spans:
        best[a, b, kind] = max(score, best.get((a, b, kind), 0.0))
    order = sorted((b, a, kind, score) for (a, b, kind), score in best.items())
    ends = [b for b, *_ in order]
    total, take = [0.0], []
    for i, (_, a, _, score) in enumerate(order):
        j = int(np.searchsorted(ends[:i], a, "right"))
        take.append((score + total[j] > total[i], j))
        total.append(max(total[i], score + total[j]))
    kept, i = [], len(order)
    while i:
        use, j = take[i - 1]
        if use:
            b, a, kind, score = order[i - 1]
            kept.append((a, b, kind, score))
        i = j if use else i - 1
    return kept[::-1]


def snapped(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """An address does not begin or end within a name: the span grows to the ends of its first and last."""
    if kind == "email":
        while a > 0 and text[a - 1] in LOCAL and text[a] in LOCAL:
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and (text[b].isalnum() or text[b] == "-"):
            b += 1
    return a, b


def tagged(texts: list[str], tagger: Tagger, batch: int = 256) -> list[list[Span]]:
    """The tagger's reconciled spans of each text."""
    codes = [coded(text) for text in texts]
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    todo = {(i, s, s + WINDOW) for i, text in enumerate(texts) for s in windows(text)}
    done = set(todo)
    while todo:
        size = min(e - s for _, s, e in todo)
        places = sorted(p for p in todo if p[2] - p[1] <= 2 * size)
        todo.difference_update(places)
        width, step = max(e - s for _, s, e in places), max(1, batch * WINDOW // (2 * size)) if size > WINDOW else batch
        for at in range(0, len(places), step):
            part = places[at : at + step]
            ids = np.full((len(part), width), PAD)
            for row, (i, s, e) in enumerate(part):
                piece = codes[i][s:e]
                ids[row, : len(piece)] = piece
            tags, margins = tagger.decode(ids)
            for row in np.flatnonzero(tags.any(1)).tolist():
                i, s, e = part[row]
                line, a, n, size = tags[row].tolist(), 0, min(e, len(texts[i])) - s, e - s
                while a < n:
                    if line[a] % 2 == 0:
                        a += 1
                        continue
                    b = a + 1
                    while b < n and line[b] == line[a] + 1:
                        b += 1
                    left, right = a == 0 and s > 0, b == n and s + n < len(texts[i])
                    if not left and not right:
                        kind = KINDS[line[a] // 2]
                        found[i].append((*snapped(texts[i], kind, s + a, s + b), kind, float(margins[row, a : b + (b < n and line[b] == 0)].sum())))
                    elif b - a <= LONGEST:
                        longer = (i, max(0, s - size) if left else s, e + size if right else e)
                        if longer not in done:
                            done.add(longer)
                            todo.add(longer)
                    a = b
    return [[(k, a, b) for a, b, k, score in reconcile(x) if score >= SURE] for x in found]


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, tagged(texts, tagger), strict=True):
        base = base_spans(text)
        added = [s for s in more if plausible(s[0], text[s[1] : s[2]]) and not any(a < s[2] and s[1] < b for _, a, b in base)]
        out.append((base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def made_up(rng: np.random.Generator) -> tuple[str | None, str]:
    """(kind or None, text) of a random item; those without a kind look like numbers that are no personal data."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9)))
    pick = int(rng.integers(0, 10))
    if pick < 2:
        sign = ["@", "@", "@", " @ "][rng.integers(4)]
        if rng.integers(2):  # long or spoken ones
            sign = [" @ ", " at ", " [at] ", "(at)", " (at) ", "@"][rng.integers(6)]
            dot = [" dot ", " dot ", " [dot] ", "(dot)"][rng.integers(4)] if sign in (" at ", "@") or rng.integers(2) else "."
            return "email", "".join([word() for _ in range(rng.integers(1, 3))]) + ["", ".", "_"][rng.integers(3)] + "".join([word() for _ in range(rng.integers(1, 4))]) + sign + dot.join([word() for _ in range(rng.integers(1, 4))] + [["com", "org", "de", "net"][rng.integers(4)]])
        return "email", f"{word()}{['.', '_', '', '-'][rng.integers(4)]}{[digits(2), word()][rng.integers(2)]}{sign}{word()}{digits(int(rng.integers(0, 2)))}.{['com', 'example.com', 'org', 'de'][rng.integers(4)]}"
    if pick < 4:
        return "ip", ".".join(str(x) for x in rng.integers(0, 256, 4))
    if pick < 6:
        body = [int(d) for d in str(int(rng.integers(3, 6))) + digits(14)]
        check = next(c for c in range(10) if luhn("".join(map(str, body)) + str(c)))
        number, gap = "".join(map(str, body)) + str(check), ["", " ", "-", ".", "  "][rng.integers(5)]
        return "card", gap.join(number[i : i + 4] for i in range(0, 16, 4))
    if pick < 8:
        front = [f"+{rng.integers(1, 99)} ", f"00{rng.integers(1, 99)} ", ""][rng.integers(3)]
        gap = [" ", "-", "."][rng.integers(3)]
        return "phone", f"{front}({digits(3)}) {digits(3)}{gap}{digits(4)}"
    hexes = "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(12, 33))))
    return None, [f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", str(rng.integers(1, 99999)), f"20{digits(2)}-0{rng.integers(1, 9)}-1{digits(1)}", f"password={hexes}", f"token = \"{hexes}\"", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}"][rng.integers(8)]


def training_windows(texts: list[str], seed: int = 3, made: int = MADE_UP) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of windows over the texts' own pattern spans and over made-up items set into them."""
    rng, rows = np.random.default_rng(seed), []
    texts = sorted(texts, key=lambda t: (TRIGGER.search(t) is None, t))

    def add(text: str, spans: list[Span], start: int) -> None:
        ids, tags = np.full(WINDOW, PAD), np.zeros(WINDOW, np.int64)
        piece = coded(text)[start : start + WINDOW]
        ids[: len(piece)] = piece
        for kind, a, b in spans:
            if a < start + WINDOW and b > start:
                k = KINDS.index(kind)
                tags[max(a - start, 0) : min(b - start, WINDOW)] = 2 + 2 * k
                tags[max(a - start, 0)] = 1 + 2 * k
        rows.append((ids, tags))

    for text in texts[:TRAIN_TEXTS]:
        spans = base_spans(text)
        for start in windows(text)[:TRAIN_WINDOWS]:
            add(text, spans, start)
    carriers = [t for t in texts if len(t) > 40] or ["so it was said that all of them went home by the river in the end. "]
    for _ in range(made):
        text = carriers[rng.integers(len(carriers))]
        at = int(rng.integers(0, max(1, len(text) - WINDOW)))
        kind, item = made_up(rng)
        before = re.sub("[0-9@+]", "x", text[at : at + int(rng.integers(2, 30))]).rstrip() + " "
        whole = before + item + [" ", ". ", ", ", "\n", ""][rng.integers(5)] + re.sub("[0-9@]", "x", text[at + 40 : at + 90])
        add(whole, [(kind, len(before), len(before) + len(item))] if kind else [], max(0, len(before) - int(rng.integers(min(0, 24 - len(item)), MARGIN + 1))))
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def sampled(text: str) -> str:
    """What training reads of a text: TRAIN_CHARS characters around its first trigger."""
    m = TRIGGER.search(text)
    at = max(0, m.start() - TRAIN_CHARS // 3) if m else 0
    return text[at : at + TRAIN_CHARS]


def fit(docs: DataFrame) -> Tagger:
    """Trains a tagger; only windows of the sampled documents that hold a digit or at sign come to the driver, and short ends of others."""
    chosen = smallest(docs.select("doc_id"), "doc_id", 4, TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sampled(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "piece"])

    pieces = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(tidied(run), "doc_id long, piece string")
    rows = pieces.groupBy("doc_id").agg(F.min("piece").alias("piece")).toArrow().column("piece").to_pylist()
    tagger = Tagger()
    tagger.train(*training_windows(rows), steps=STEPS)
    return tagger


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find_spans(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """FOUND of every row: counts and digest of the pattern spans, all spans, how many the tagger added, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], tagger)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(spans) for _, spans in found], pa.string()), pa.array([len(spans) - len(base) for base, spans in found], pa.int64()), pa.array([len(spans) for _, spans in found], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """text with each span (or run of overlapping spans) replaced by its first kind's name in angle brackets."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with personal data in text replaced; n_chars, if there is such a column, follows the new text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], tagger)
            new = pa.array([None if t is None else masked(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, new)

    out = docs.mapInArrow(tidied(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_spans(docs, fit(docs))
