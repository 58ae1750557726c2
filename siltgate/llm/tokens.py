"""Token ids of whole texts in Simple-8b files.

Documents are dealt by ranges of (id, text's hash) to shards, sorted, and encoded; each shard's ids form a stream that
is cut into files of rows: a row holds the ids of some whole documents as Simple-8b words, the word offset of every
block of ids, and the documents' ids and lengths. Readers decode by these offsets, and a document's ids from its
blocks alone (``simple8b.between``). Rows that are equal in both may go to any of several shards, in any order. The rows are written as Parquet by Spark, so that a
lost executor's shard is written again and only committed files count, and any store that Spark knows will do.

The vocabulary lower-cases and splits at white space before anything else, so the ids of a text are the ids of
its white-space-separated words one after the other; each Python worker therefore encodes a distinct word once
with the tokenizer, and keeps a bounded memory of words. :func:`pieces` makes more words equal. New words of
letters are encoded in one string, and told apart by the ids that end words. :func:`word_wise` tells whether a
tokenizer works so; texts of other tokenizers are encoded whole.

Defined results: null texts are empty; an empty text has only the end id; very long texts are encoded whole, as a file
row of their own; repeated rows are each encoded, and rows of one id are in the order of their texts' hashes; rows with
a null id come first; an empty table gives files without rows and an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgate.llm import flat, simple8b
from siltgate.llm.common import fresh_path, map_texts

END = 1
#: Distinct words that a worker remembers, at most; beyond that it starts anew.
MEMORY = 1_000_000


def word_wise(path: str) -> bool:
    """True for a tokenizer file whose text is split at white space, which is dropped, before pieces are found."""
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    blank = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" and "^\\s" in s["pattern"].get("Regex", "") for s in splits)
    return blank and drops


#: Classes of bytes that :func:`pieces` looks at; other bytes have class 0 and are never cut from a neighbour.
_LETTER, _DIGIT, _MARK, _QUOTE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("'")] = _QUOTE
#: Where a space may be put in without changing the pieces that the split pattern finds. Not after an apostrophe,
#: which begins pieces such as 's, and not inside runs of marks, which are one piece.
_CUT = np.zeros((5, 5), np.bool_)
for _x, _ys in ((_LETTER, (_DIGIT, _MARK, _QUOTE)), (_DIGIT, (_LETTER, _DIGIT, _MARK, _QUOTE)), (_MARK, (_LETTER, _DIGIT))):
    _CUT[_x, list(_ys)] = True
_CUT = _CUT.ravel()


def pieces(column: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and spaces between letters, digits and marks: the same ids, fewer distinct words.

    Lower-casing before composition differs from the tokenizer's order only for letters with combining marks;
    arrays with any of those (lead bytes CC and CD) keep their case.
    """
    raw, off = flat.buffers(column)
    if not len(raw):
        return column
    wide = raw.max() >= 0x80
    if not (wide and ((raw == 0xCC) | (raw == 0xCD)).any()):
        raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)
    kind = _CLASS[raw]
    if wide:
        # Latin-1 letters, but for the signs of multiplication and division.
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(raw), np.bool_)
    cut[1:] = _CUT[kind[:-1] * 5 + kind[1:]]
    inner = off[1:-1]
    cut[inner[inner < len(raw)]] = False
    at = np.flatnonzero(cut)
    kept = np.ones(len(raw) + len(at), np.bool_)
    kept[at + np.arange(len(at))] = False
    out = np.full(len(kept), 0x20, np.uint8)
    out[kept] = raw
    moved = np.searchsorted(at, off) + off
    if moved[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(column), pa.py_buffer(moved.astype(np.int32)), pa.py_buffer(out))
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(moved), pa.py_buffer(out))


def _names(distinct: pa.Array) -> list[str]:
    """Words as Python strings: none has a space, so one long string is made and split, unless that would be too long."""
    if not len(distinct) or not pa.types.is_string(distinct.type) or distinct.nbytes > 1 << 28:
        return distinct.to_pylist()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py().split(" ")


class Encoder:
    """Ids of texts, with the memory of words that one worker keeps."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), word_wise(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        # Whether an id ends a word: then words of letters can be encoded in one string and told apart again.
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), np.bool_)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.size, self.off, self.n = np.zeros(1 << 20, np.uint32), 0, np.zeros(MEMORY + 1, np.int64), 0

    def _encoded(self, names: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has."""
        if joined:
            lines = [" ".join(names[i : i + 256]) for i in range(0, len(names), 256)]
            ids = np.concatenate([np.array(got.ids, np.uint32) for got in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(names) and last[-1] == len(ids) - 1:
                return ids, np.diff(np.concatenate([[-1], last]))
        each = [got.ids for got in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _learn(self, names: list[str]) -> None:
        """Adds new words: those of letters only, which are one piece each, together; then the others one by one."""
        plain = [w for w in names if w.isalpha()] if self.ends is not None else []
        rest = [w for w in names if not w.isalpha()] if self.ends is not None else names
        for group, joined in ((plain, True), (rest, False)):
            if not group:
                continue
            ids, many = self._encoded(group, joined)
            while self.size + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.size : self.size + len(ids)] = ids
            self.off[self.n + 1 : self.n + 1 + len(group)] = self.size + np.cumsum(many)
            self.place.update(zip(group, range(self.n, self.n + len(group)), strict=True))
            self.n += len(group)
            self.size += len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by END, and offsets by text."""
        if not self.by_word:
            each = [np.array([*got.ids, END], np.uint32) for got in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)])
        raw = flat.buffers(column)[0].tobytes()
        if not any(t in raw for t in self.special):
            column = pieces(column)
        word, at = flat.words(column)
        code, distinct = flat.codes(word)
        names = _names(distinct)
        place = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            if self.n + len(unknown) > MEMORY:
                self.forget()
                unknown = np.arange(len(names))
                if len(names) > MEMORY:
                    self.off = np.zeros(len(names) + 1, np.int64)
            new = [names[i] for i in unknown.tolist()]
            self._learn(new)
            place[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        begin, size = self.off[place], self.off[place + 1] - self.off[place]
        # The end id stands after the words of each text: as a word of its own, whose id is put in afterwards.
        n = len(at) - 1
        stop = at[1:] + np.arange(n)
        words = np.ones(len(code) + n, np.bool_)
        words[stop] = False
        start, many = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        start[words], many[words] = begin[code], size[code]
        total = np.concatenate([[0], np.cumsum(many)])
        kind = np.int32 if max(total[-1], self.size) < 1 << 31 else np.int64
        source = np.repeat((start - total[:-1]).astype(kind), many)
        source += np.arange(total[-1], dtype=kind)
        ids = self.ids.take(source)
        ends = total[stop]
        ids[ends] = END
        return ids, np.concatenate([[0], ends + 1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes the ids of all texts, in ascending order of doc_id, as files under ``path``."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType()),
        T.StructField("docs", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()), T.StructField("block_offsets", T.ArrayType(T.LongType())), T.StructField("n_ids", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, row, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for piece in flat.slices(batch):
                ids, off = own.encode(flat.texts(piece.column("text")))
                words, blocks = simple8b.encode(ids)
                id_list = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([row], pa.int64()), id_list, pa.array([np.diff(off)], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([blocks], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64())],
                    [f.name for f in schema],
                )
                row += 1

    # One id, or one row many times over, may be a third of the table: ranges cut it by hash, and equal rows by place.
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    map_texts(ordered, run, schema).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 for every document.

    Where a shard starts follows from the totals of the shards before it (one row per shard); where a file row
    starts follows within its shard, in the rows' order.
    """
    rows = spark.read.parquet(path)
    in_shard = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    shards = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(shards):
        before[shard], total = total, total + shards[shard]
    first = spark.createDataFrame(sorted(before.items()), "shard int, shard_start long")
    # The window sees the rows' sizes only; their words are read where they are decoded.
    starts = rows.select("shard", "row", "n_ids").withColumn("in_shard", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0)))
    starts = starts.join(F.broadcast(first), "shard").select("shard", "row", (F.col("shard_start") + F.col("in_shard")).alias("row_start"))
    id_type = rows.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = batch.slice(i, 1)
                ids = simple8b.decode(np.frombuffer(got.column("words")[0].as_buffer(), "<u8"), got.column("block_offsets").flatten().to_numpy()).astype("<u4")
                lengths = got.column("lengths").flatten().to_numpy()
                off = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, got.column("shard")[0].as_py()), pa.int32()), pa.array(np.full(n, got.column("row")[0].as_py()), pa.int64()), got.column("docs").flatten(), pa.array(off[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], [f.name for f in schema])

    decoded = rows.select("shard", "row", "docs", "lengths", "words", "block_offsets").mapInArrow(run, schema)
    return decoded.join(starts, ["shard", "row"]).select("doc_id", (F.col("row_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
