"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are cut every CAPACITY ids; the pieces are dealt to groups by a hash of document, piece and the row's place in the
table, so that each group is a random sample of about GROUP_PIECES pieces whatever the order or skew of the input (also
where many rows share a doc_id or have none), and each group is packed by itself. Only (doc_id, start, length, ...) rows
move; token ids stay where they were made.

Defined cases: a null or empty text has one id, END; a null doc_id is packed like any other; repeated rows and equal
doc_ids are packed row by row (`sequences` needs unique doc_ids); pieces of equal length go in order of doc_id and start;
a very long text gives full pieces and one rest; an empty table gives no rows; extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, tidied
from .textkit import LOWER, SPACE, mix, ranges, span_hashes, utf8

CAPACITY, END, GROUP_PIECES = 4096, 2, 8192
CACHED_SPANS = 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
PIECE = re.compile(rb"[0-9]|[^0-9]+")
CHUNK_SALT = np.uint64(0x5851F42D4C957F2D)


class SpanCache:
    """Ids of texts by a tokenizer that never joins what white space separates, nor letters with other ASCII characters.

    A text is cut into spans, runs of letters and runs of anything else. A span with an apostrophe (which may start a
    contraction) or with non-ASCII characters that are no letters does not stand alone: its whole chunk, what white space
    encloses, is one span then. Each distinct span is encoded once, many at a time as one text, which is parted again
    after the ids that end a word (marked by `</w>` in the vocabulary); all texts of a batch are put together from them by
    array code. Spans are told apart by 64-bit hashes (two are taken for equal with a chance of about 5e-20 a pair).
    Texts that hold one of the tokenizer's added tokens (as <|endoftext|>) are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # rising
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # place of its ids in pool; size -1: never stands alone
        self.pool = np.zeros(0, np.uint32)

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _together(self, spans: list[bytes], words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of spans, each of which has so many ids that end a word, and how many ids each has."""
        ids, sizes = [], [np.zeros(0, np.int64)]
        for at in range(0, len(spans), 500):
            part = spans[at : at + 500]
            found = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends, last = np.flatnonzero(self.is_end[found]) + 1, np.cumsum(words[at : at + 500])
            if len(ends) == last[-1]:
                ids.append(found)
                sizes.append(np.diff(ends[last - 1], prepend=0))
            else:
                ids += (one := self._plain(part))
                sizes.append(np.array([len(x) for x in one]))
        return ids, np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, spans: list[bytes], whole: bool) -> None:
        """Adds spans that are not known yet."""
        if whole:
            ids = self._plain(spans)
            size = np.array([len(x) for x in ids], np.int64)
        else:
            words = np.fromiter(map(self._words, spans), np.int64, len(spans))
            alone = np.flatnonzero(words)
            size = np.full(len(spans), -1, np.int64)
            ids, size[alone] = self._together([spans[i] for i in alone.tolist()], words[alone])
        first = len(self.pool) + np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
        self.pool = np.concatenate([self.pool, *ids])
        keys, first, size = (np.concatenate(x) for x in ((self.keys, keys), (self.first, first), (self.size, size)))
        order = np.argsort(keys)
        self.keys, self.first, self.size = keys[order], first[order], size[order]

    @staticmethod
    def _words(span: bytes) -> int:
        """Words of the tokenizer in a span: letters are one, a digit is one, a run of other characters is one. 0: it does not stand alone."""
        if span.isalpha() or (not span.isascii() and (text := span.decode()).isalpha() and text.lower().isalpha()):
            return 1
        return 0 if b"'" in span or not span.isascii() else len(PIECE.findall(span))

    def _found(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes, whole: bool) -> np.ndarray:
        """Place of each span in keys, after the new ones are learnt."""
        coded = pa.array(keys).dictionary_encode()
        code, values = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.minimum(np.searchsorted(self.keys, values), max(0, len(self.keys) - 1))
        missing = np.flatnonzero(self.keys[at] != values) if len(self.keys) else np.arange(len(values))
        if len(missing):
            one = np.zeros(len(values), np.int64)
            one[code] = np.arange(len(code))
            places = one[missing]
            self._learn(values[missing], [raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)], whole)
            at = np.searchsorted(self.keys, values)
        return at[code]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """For each text (null counts as empty) its ids, those of the plain call without special tokens added."""
        if len(self.keys) > CACHED_SPANS:
            self._clear()
        data, offsets = utf8(column)
        plain = LOWER[data]
        # A capital before a mark is left to the tokenizer, which puts the two together before it makes them small.
        marked = np.flatnonzero(data[1:] >= 0x80)
        plain[marked] = data[marked]
        raw, kind = plain.tobytes(), KIND[plain]
        edge, new = np.zeros(len(plain) + 1, bool), np.ones(len(plain) + 1, bool)
        edge[offsets] = True
        new[1:-1] = kind[1:] != kind[:-1]
        new |= edge
        starts, ends = np.flatnonzero(new[:-1] & (kind > 0)), np.flatnonzero(new[1:] & (kind > 0)) + 1
        keys = span_hashes(plain, starts, ends)
        at = self._found(keys, starts, ends, raw, False)
        broken = self.size[at] < 0
        if broken.any():
            opens = np.ones(len(starts), bool)
            opens[1:] = (starts[1:] != ends[:-1]) | edge[starts[1:]]
            chunk = np.cumsum(opens) - 1
            bad = np.zeros(chunk[-1] + 1, bool)
            bad[chunk[broken]] = True
            kept = opens | ~bad[chunk]
            closes = np.append(opens[1:], True)
            ends_of = ends[closes][chunk]
            swap = kept & bad[chunk]
            first, last = starts[swap], ends_of[swap]
            keys[swap] = mix(span_hashes(plain, first, last) ^ CHUNK_SALT)
            self._found(keys[swap], first, last, raw, True)
            keys, starts = keys[kept], starts[kept]
            at = np.searchsorted(self.keys, keys)
        size = self.size[at]
        ids = self.pool[ranges(self.first[at], size)]
        places = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        out = np.split(ids, places[1:-1]) if len(offsets) > 1 else []
        if any(x in raw for x in self.added):
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(x in raw[a:b] for x in self.added):
                    out[row] = self._plain([data[a:b].tobytes()])[0]
        return out


CACHES: dict[str, SpanCache] = {}


def span_cache(path: str) -> SpanCache:
    """One for each tokenizer file and worker process: later tasks of a reused worker find most spans known."""
    if path not in CACHES:
        CACHES[path] = SpanCache(path)
    return CACHES[path]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows of PIECES (and ids, an array of ints, if asked for) of docs (doc_id, text); path: a tokenizer file that all workers can read."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = span_cache(path)
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), cache.encode(batch.column(1)), strict=True):
                ids = found.astype("<u4").tobytes() + last
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4) + ((np.frombuffer(piece, "<i4"),) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), PIECES + ", ids array<int>" * with_ids)


class Tournament:
    """Bins in order of opening under a tree of maxima, so that the first bin with room is found in log time."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room for size."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had, bin_ = room[at], at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal sizes go in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        bins[i], had = tree.put(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be cheap to read twice (a table), since they are counted first."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(part.column("length").to_numpy(), capacity)
        group = part.column("bunch")[0].as_py()
        return part.drop_columns(["bunch"]).append_column("sequence_id", pa.array(bins + (group << 32), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    # The row's place keeps equal rows (as those of null doc_ids) apart.
    dealt = pieces.withColumn("bunch", F.pmod(F.xxhash64(F.lit(9), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("bunch").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def sequences(packed: DataFrame, with_ids: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id and ids of each sequence, padded to capacity unless its length is a power of two. with_ids: tokenize(..., with_ids=True)."""
    rows = packed.join(with_ids.select("doc_id", "start", "ids"), ["doc_id", "start"])
    whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    return whole.select("sequence_id", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(capacity) - n))).alias("ids"))


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    small_batches(spark, 300)
    return pack(table(tokenize(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
