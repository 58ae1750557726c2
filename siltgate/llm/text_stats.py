"""Per-text statistics, computed a slice of texts at a time with Arrow and numpy.

Null and empty texts have zeros everywhere. The work is linear in the bytes of text (hash tables over the
words of a slice), whatever the share of repeats, and each text's numbers depend on that text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltgate.llm import flat
from siltgate.llm.common import map_texts

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

STATS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_top_word",
    "n_upper", "n_digits", "n_pipe", "n_bang", "n_stop", "n_same_next",
)


def repeated_windows(ids: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Marks words in a window of ``width`` words (a power of two) that its text has at least twice.

    Windows get integer names that are equal only for equal windows: a name for each pair of neighbouring
    words, then for each pair of those names, and so on. No hashing is involved that could collide.
    """
    covered = np.zeros(len(ids), np.bool_)
    names, own = ids, flat.owners(offsets)
    step = 1
    while step < width:
        if len(names) <= step:
            return covered
        top = int(names.max()) + 1
        names, _ = flat.codes(pa.array(names[:-step] * top + names[step:]))
        step *= 2
    n = len(names)
    whole = np.flatnonzero(own[:n] == own[width - 1 : width - 1 + n])
    if not len(whole):
        return covered
    keyed, _ = flat.codes(pa.array(own[whole] * (int(names.max()) + 1) + names[whole]))
    starts = whole[np.bincount(keyed)[keyed] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:-1] > 0


def duplicate_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines split at newline, and lines with a word that equal an earlier line of the text."""
    split = pc.split_pattern(column, "\n")
    lines, off = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    own = flat.owners(off)
    worded = pc.not_equal(pc.binary_length(pc.ascii_trim(lines, WHITE)), 0).to_numpy(zero_copy_only=False)
    n_lines = np.diff(off)
    if not len(lines) or not worded.any():
        return n_lines, np.zeros(len(column), np.int64)
    line, names = flat.codes(lines)
    keyed, _ = flat.codes(pa.array((own * len(names) + line)[worded]))
    seen_before = np.ones(len(keyed), np.bool_)
    _, at = np.unique(keyed, return_index=True)
    seen_before[at] = False
    return n_lines, np.bincount(own[worded], weights=seen_before, minlength=len(column)).astype(np.int64)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All of STATS for an array of texts without nulls."""
    n = len(column)
    raw, off = flat.buffers(column)
    out: dict[str, np.ndarray] = {}
    lead = (raw & 0xC0) != 0x80
    out["n_chars"] = flat.segments(lead, off)
    out["word_chars"] = out["n_chars"] - flat.byte_count(raw, off, WHITE)
    out["n_symbols"] = flat.byte_count(raw, off, SYMBOLS)
    out["n_pipe"] = flat.byte_count(raw, off, "|")
    out["n_bang"] = flat.byte_count(raw, off, "!")
    out["n_digits"] = flat.byte_count(raw, off, "0123456789")
    out["n_upper"] = flat.byte_count(raw, off, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out["n_stop"] = flat.byte_count(raw, off, ".,;:?")
    out["n_lines"], out["n_dup_lines"] = duplicate_lines(column)
    word, at = flat.words(column)
    out["n_words"] = np.diff(at)
    ids, names = flat.codes(word)
    own = flat.owners(at)
    if len(ids):
        out["n_repeat_words"] = flat.segments(repeated_windows(ids, at), at)
        pair = np.unique(own * len(names) + ids, return_counts=True)
        who = pair[0] // len(names)
        out["n_distinct_words"] = np.bincount(who, minlength=n)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, who, pair[1])
        out["n_top_word"] = top
        same = np.zeros(len(ids), np.bool_)
        same[1:] = (ids[1:] == ids[:-1]) & (own[1:] == own[:-1])
        out["n_same_next"] = flat.segments(same, at)
    else:
        out |= {k: np.zeros(n, np.int64) for k in ("n_repeat_words", "n_distinct_words", "n_top_word", "n_same_next")}
    return out


def with_stats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """``id_column``, then a long column for each of STATS, one row per row of ``docs``; other columns are not read."""
    cols = [id_column, text_column] if keep_text else [id_column]
    schema = T.StructType([docs.schema[c] for c in cols] + [T.StructField(s, T.LongType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.slices(batch, text_column):
                found = measure(flat.texts(piece.column(text_column)))
                arrays = [piece.column(c) for c in cols] + [pa.array(found[s], pa.int64()) for s in STATS]
                yield pa.RecordBatch.from_arrays(arrays, [*cols, *STATS])

    return map_texts(docs.select(id_column, text_column), run, schema)
