"""BPE encoding and decoding through a table of distinct words.

Texts are split into words: at white space, and where ASCII letters and other ASCII characters meet, since no token of the
tokenizers meant here joins what lies on the two sides. The rows of a few megabytes of texts make a chunk: its distinct
words, commonest first, are its dictionary, and a text is kept as its words' places there, a byte or two a word. The
dictionaries of all chunks are dealt and sorted by word, which gives the table of distinct words with the places of each:
every distinct word is encoded once, and its ids go back to its places. A chunk's words and texts meet by chunk, and each
text's ids are put together by position. Ids are decoded by a join with the vocabulary's id-to-piece table, which each
worker holds whole (its size is the vocabulary's). A common word is one row a chunk, not one an occurrence; no group is
larger than a chunk.

The tokenizers meant are those of the `tokenizers` library with the splitting pattern PATTERN and no decoder, so that
decoding joins pieces by one space (as word_bpe_49k.json); other files raise ValueError. Strings of added tokens inside a
text are ids of their own, as in the library.

docs is read twice and must give its rows in the same order both times, as a table does; a chunk that was read in two
ways raises ValueError.

Defined cases: a null or empty text, and one of white space alone, has no ids and decodes to ''; a word that has no ids
(as a lone next-line sign) leaves nothing, also no space; repeated rows, null and repeated doc_ids stay row by row; a
text beyond a chunk's size is a chunk by itself, and a word is as long as its text may be; ids that the vocabulary
lacks decode to nothing, and null ids to ''; an empty table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .textkit import LOWER, ranges, slices, spelt, utf8, words

CHUNK, PART = 16 << 20, 2 << 20  # bytes of text: of a chunk, and at once
#: Fixed value: the splitting pattern for which words may be taken apart as below.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TOKENIZERS = {}


def _merged(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The places up to most that are in a or b, rising."""
    there = np.zeros(most + 1, bool)
    there[a] = there[b] = True
    return np.flatnonzero(there)


class Splitter:
    """Cuts texts into words whose ids, one after another, are the text's."""

    def __init__(self, path: str) -> None:
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        added = [t["content"] for t in rules["added_tokens"]]
        splits = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if rules.get("decoder") or splits[:1] != [PATTERN] or any(t["lstrip"] or t["rstrip"] for t in rules["added_tokens"]) or any(c.isspace() for a in added for c in a):
            raise ValueError(f"{path} does not encode and decode word by word")
        byte = np.arange(256)
        self.letter = np.isin(byte, [*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)])
        # No cut beside an apostrophe (it may start a contraction), nor beside a sign that an added token has beside a letter.
        self.glue = np.isin(byte, [ord("'"), *(ord(c) for a in added for c in a if ord(c) < 128 and not c.isalpha())])
        self.bars = self.glue.copy()
        self.bars[ord("'")] = False
        self.other = (byte > 0x20) & (byte < 0x80) & ~self.letter & ~self.glue

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all rows, and how many each row has. Case is kept where lower case could tell otherwise: beside bytes that are not ASCII and in words with signs of added tokens."""
        starts, ends, _ = words(data, offsets)
        letter, other = self.letter[data], self.other[data]
        cuts = np.flatnonzero((letter[:-1] & other[1:]) | (other[:-1] & letter[1:])) + 1
        starts, ends = _merged(starts, cuts, len(data)), _merged(ends, cuts, len(data))
        low = LOWER[data]
        beside = np.flatnonzero(data[1:] >= 0x80)
        low[beside] = data[beside]
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(self.bars[data]), "right") - 1).tolist():
            low[starts[i] : ends[i]] = data[starts[i] : ends[i]]
        return spelt(low, starts, ends), np.diff(np.searchsorted(starts, offsets))


def _packed(codes: np.ndarray) -> bytes:
    """Codes as bytes, seven bits a byte, the lowest first and the last one's top bit clear, compressed."""
    size = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21) + (codes >= 1 << 28)
    ends = np.cumsum(size)
    raw = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for byte in range(5):
        more = size > byte
        raw[(ends - size)[more] + byte] = (codes[more] >> 7 * byte & 127) | np.where(size[more] > byte + 1, 128, 0)
    return len(raw).to_bytes(8, "little") + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    data = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    codes = np.zeros(len(last), np.int64)
    for byte in range(5):
        at = first + byte
        more = at <= last
        codes[more] |= (data[at[more]] & 127).astype(np.int64) << 7 * byte
    return codes


def _chunked(splitter: Splitter, told):
    """Calls told(chunk, doc_ids, codes, sizes, dictionary) for each chunk of a task's rows (doc_id, text).

    A chunk is named by the task's partition, its number there and a sum of its dictionary, so that a chunk made of other rows has another name.
    """

    def made(held: list[pa.RecordBatch], first: int) -> Iterator[tuple]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(held).combine_chunks()
        data, offsets = utf8(rows.column("text"))
        for n, (a, b) in enumerate(slices(offsets, 2 * CHUNK), first):
            parts = [splitter.split(data[offsets[a + i] : offsets[a + j]], offsets[a + i : a + j + 1] - offsets[a + i]) for i, j in slices(offsets[a : b + 1] - offsets[a], PART)]
            found = pa.chunked_array([p[0] for p in parts], pa.large_string()).combine_chunks().dictionary_encode()
            sizes = np.concatenate([p[1] for p in parts])
            codes = found.indices.to_numpy()
            order = np.argsort(-np.bincount(codes, minlength=len(found.dictionary)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            dictionary = found.dictionary.take(pa.array(order))
            bytes_, ends = utf8(dictionary)
            name = TaskContext.get().partitionId() << 40 | n << 28 | zlib.crc32(bytes_.tobytes(), zlib.crc32(ends.tobytes())) >> 4
            yield n, told(name, rows.column("doc_id").combine_chunks().slice(a, b - a), rank[codes], sizes, dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = -1, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                for last, rows in made(held, last + 1):
                    yield rows
                held, size = [], 0
        if held:
            for _, rows in made(held, last + 1):
                yield rows

    return run


def _told_words(name: int, doc_ids: pa.Array, codes: np.ndarray, sizes: np.ndarray, dictionary: pa.Array) -> pa.RecordBatch:
    n = len(dictionary)
    return pa.RecordBatch.from_arrays([dictionary.cast(pa.string()), pa.array(np.full(n, name)), pa.array(np.arange(n), pa.int32())], names=["word", "part", "code"])


def _told_texts(name: int, doc_ids: pa.Array, codes: np.ndarray, sizes: np.ndarray, dictionary: pa.Array) -> pa.RecordBatch:
    ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
    return pa.RecordBatch.from_arrays([pa.array([name]), ids, pa.array([sizes], pa.list_(pa.int64())), pa.array([_packed(codes)], pa.binary()), pa.array([len(dictionary)])], names=["chunk", "doc_ids", "sizes", "codes", "known"])


def _tokenizer(path: str):
    """The tokenizer of a file and its pieces by id, once a worker."""
    if path not in TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        pieces = [None] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            pieces[i] = piece
        TOKENIZERS[path] = tokenizer, pa.array(pieces, pa.string())
    return TOKENIZERS[path]


def _id_kind(pieces: pa.Array) -> str:
    return "<u2" if len(pieces) <= 1 << 16 else "<u4"


def _encoded(path: str):
    """Rows (part, code, ids) of rows (word, part, code) sorted by word; a word that goes on in the next batch is not encoded again. ids are bytes, of the kind that holds the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokenizer, pieces), last, last_ids = _tokenizer(path), None, None
        kind = _id_kind(pieces)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            found = coded.dictionary.to_pylist()
            known = found[0] == last
            ids = ([last_ids] if known else []) + [np.array(x.ids, kind).tobytes() for x in tokenizer.encode_batch_fast(found[known:], add_special_tokens=False)]
            last, last_ids = found[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ids, pa.binary()).take(coded.indices)], names=["part", "code", "ids"])

    return run


def spoken(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """The text of each list of ids: the ids are joined with their pieces (unknown ones drop out), which are put together with one space between."""
    flat = ids.flatten()
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    real = pc.and_(pc.less(flat, len(pieces)), pc.greater_equal(flat, 0))
    found = pieces.take(pc.if_else(real, flat, None))
    kept = found.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.drop_null() if found.null_count else found), " ")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (key, ids array<int>) with text, what the ids decode to. No shuffle: the id-to-piece table, as large as the vocabulary, is in each worker."""
    Splitter(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("text", spoken(batch.column("ids"), _tokenizer(path)[1]))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{shape}, text string")


def _together(kind: pa.DataType, path: str):
    """The texts of a chunk, put together by position from the ids of its words."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if texts.num_rows != 1 or texts.column("known")[0].as_py() != found.num_rows:
            raise ValueError("documents came in another order when they were read again; write them as a table first")
        found = found.sort_by("code")
        codes, sizes = _unpacked(texts.column("codes")[0].as_py()), texts.column("sizes").combine_chunks().flatten().to_numpy()
        pieces = _tokenizer(path)[1]
        data, places = utf8(found.column("ids").combine_chunks().view(pa.string()))
        ids, places = data.view(_id_kind(pieces)), places // np.dtype(_id_kind(pieces)).itemsize
        counts = np.diff(places)[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[ranges(places[codes], counts)], pa.int32()))
        return pa.table({"doc_id": texts.column("doc_ids").combine_chunks().flatten().cast(kind), "ids": whole, "text": spoken(whole, pieces)})

    return run


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> (of the text), text (what the ids decode to), one row a row of docs (doc_id, text)."""
    splitter = Splitter(path)
    small_batches(spark)
    name = docs.schema["doc_id"].dataType.simpleString()
    kind = {"string": pa.string(), "int": pa.int32()}.get(name, pa.int64())
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = slim.mapInArrow(_chunked(splitter, _told_words), "word string, part long, code int").repartition("word").sortWithinPartitions("word")
    found = lexicon.mapInArrow(_encoded(path), "part long, code int, ids binary")
    texts = slim.mapInArrow(_chunked(splitter, _told_texts), f"chunk long, doc_ids array<{name}>, sizes array<long>, codes binary, known long")
    return texts.groupBy("chunk").cogroup(found.groupBy("part")).applyInArrow(_together(kind, path), f"doc_id {name}, ids array<int>, text string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
