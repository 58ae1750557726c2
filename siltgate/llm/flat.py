"""Vectorised text arrays for Arrow batches: slices of bounded size, words, lines, byte classes.

A word is a longest run of characters other than space and U+0009 to U+000D. All offsets are kept per
text, so whole texts are always processed; a slice never cuts one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltgate.llm.common import SLICE_BYTES


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into pieces of about ``size`` bytes of text."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def texts(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as empty."""
    column = column.cast(pa.large_string()) if pa.types.is_large_string(column.type) else column.cast(pa.string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def segments(per: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``per`` between neighbouring offsets."""
    sums = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the offset of each text's first word."""
    split = pc.ascii_split_whitespace(column)
    flat, off = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    counts = segments(full.to_numpy(zero_copy_only=False), off)
    return flat.filter(full), np.concatenate([[0], np.cumsum(counts)])


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of values, and the distinct values they stand for."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element, the number of the text that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def byte_count(raw: np.ndarray, offsets: np.ndarray, chars: str) -> np.ndarray:
    """Per text, how many bytes are one of the given ASCII characters."""
    hit = np.zeros(256, np.bool_)
    hit[[ord(c) for c in chars]] = True
    return segments(hit[raw], offsets)


def plain_words(column: pa.Array, digits: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of letters (and digits); ASCII, Latin-1 and general punctuation separates them.

    Separators are blanked in the UTF-8 bytes themselves, character by character, so nothing is re-encoded.
    """
    column = pc.utf8_lower(column)
    raw, off = buffers(column)
    keep = np.zeros(256, np.bool_)
    keep[ord("a") : ord("z") + 1] = True
    keep[0x80:] = True
    if digits:
        keep[ord("0") : ord("9") + 1] = True
    clean = np.where(keep[raw], raw, 0x20).astype(np.uint8)
    if len(raw) and raw.max() >= 0x80:
        latin = np.flatnonzero(raw == 0xC2)
        for k in (0, 1):
            clean[latin + k] = 0x20
        wide = np.flatnonzero((raw == 0xE2) | (raw == 0xE3))
        wide = wide[raw[wide + 1] == 0x80]
        for k in (0, 1, 2):
            clean[wide + k] = 0x20
    made = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(clean))
    return words(made)
