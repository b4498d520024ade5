"""Chat formatting: a finite-state machine over roles checks turn order, a declarative template emits text segments with loss flags.

`format_turns` works on rows (conv_id, turn, role, text) and returns one row per segment; `read_back` parses
the segments of each conversation again. Both stream over rows sorted by conversation, so a conversation of any
length takes the memory of one batch.

Defined cases: null text or role counts as empty; rows sort by turn (nulls first), role, text, so ties and
repeated rows keep a fixed order and all are formatted; a null conv_id is one conversation; a conversation that
breaks the turn order is formatted all the same and flagged `valid = false`; extra columns are dropped; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are learned, and which role may follow which ("" is the start).

    head and tail are control strings; escape marks them inside texts, itself included.
    """

    head: str = "### "
    colon: str = ":\n"
    tail: str = "</turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for mark in self.control:
            text = text.replace(mark, self.escape + mark)
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def role_name(self, role: str) -> str:
        """A role inside a head: its colon and line ends are escaped, so that the head has one end."""
        return self.escaped(role).replace(":", self.escape + ":")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(f"{self.head}{self.role_name(role)}{self.colon}", False), (self.escaped(text), role in self.learned), (self.tail, False)]


SEGMENTS = "conv_id long, place long, part int, text string, loss boolean, allowed boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, place (of the turn), part (0 head, 1 text, 2 tail), text, loss, allowed (the machine's step)."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("allowed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, state, place = object(), "", 0
            for conv_id, role, text in _columns(batches):
                if conv_id != conv:
                    conv, state, place = conv_id, "", 0
                allowed = role in template.follows.get(state, ())
                for part, (piece, loss) in enumerate(template.segments(role, text)):
                    yield conv_id, place, part, piece, loss, allowed
                state, place = role, place + 1

        yield from _batches(rows(), schema)

    kept = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from the formatted text alone (and the loss mask that goes with it)."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
    mark = re.escape(template.escape)
    head = re.compile(re.escape(template.head) + f"((?:{mark}.|[^{mark}:])*)" + re.escape(template.colon), re.S)
    body = re.compile(f"((?:{mark}.|(?!{re.escape(template.tail)})[^{mark}])*)" + re.escape(template.tail), re.S)

    class Reader:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = 0
            self.held, self.valid, self.last = "", True, ""

        def take(self, text: str, loss: bool, allowed: bool) -> None:
            self.chars += len(text)
            self.valid &= allowed
            if loss:
                plain = template.unescaped(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
            self.held += text
            if text == template.tail:
                self.parse()

        def parse(self) -> None:
            found = head.match(self.held)
            if not found:
                raise ValueError(f"conversation {self.conv_id}: no turn starts at {self.held[:40]!r}")
            rest = body.fullmatch(self.held, found.end())
            if not rest:
                raise ValueError(f"conversation {self.conv_id}: a turn has no end")
            self.last = template.unescaped(found[1])
            self.turns.update(f"{self.last}\n{template.unescaped(rest[1])}\n".encode())
            self.n, self.held = self.n + 1, ""

        def row(self) -> tuple:
            if self.held:
                raise ValueError(f"conversation {self.conv_id}: text after the last turn")
            return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last in template.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            reader = None
            for conv_id, text, loss, allowed in _columns(batches):
                if reader is None or conv_id != reader.conv_id:
                    if reader is not None:
                        yield reader.row()
                    reader = Reader(conv_id)
                reader.take(text, loss, allowed)
            if reader is not None:
                yield reader.row()

        yield from _batches(rows(), schema)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
    return ordered.select("conv_id", "text", "loss", "allowed").mapInArrow(run, READ)


PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 4000)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(table(format_turns(rows.unionByName(extra)), "chat"))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS safe_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM turns),
steps AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY place), '') AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY place) IS NULL AS is_last FROM shaped)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + length(safe_role) + 14)::BIGINT AS formatted_chars,
  bool_and((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))
    AND bool_or(is_last AND role = 'assistant') AS valid
FROM steps GROUP BY conv_id
"""
