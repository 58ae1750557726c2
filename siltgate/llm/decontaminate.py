"""Benchmark decontamination: windows of documents within an edit distance of benchmark items.

Texts are sequences of lower-case words (letters and digits). A document contains an item if some run of its
words is within ``1 - SIMILARITY`` of the item's length in word edits (insert, delete, replace).

1. Windows. Cutting an item of n words by at most k edits leaves a run of at least (n - k) / (k + 1) words whole,
   so every window that matters has one of the item's word grams of that length (at most GRAM) in it; the gram's
   place in the item says where a window of the item's size starts. No other window can match: nothing is lost.
2. CGK embedding. Each repetition walks over a window word by word; a random bit for each (step, word) says
   whether the walk goes on or reads the word again. Words that edits shift fall back into step, so that edit
   distance becomes Hamming distance between the walks' outputs.
3. Bit sampling. A repetition samples a few output places; equal samples make a window a candidate for an item.
   Their number follows, by item length, from the collisions that random edits at the threshold show on the items
   themselves, so that RECALL of such windows collide at least once; an exact copy always does. Lengths that would
   need more than REPEATS repetitions are not sampled: k edits leave at least n - g + 1 - k g of an item's grams
   of g words whole, at places that shift by at most k, and every run with so many is a candidate: nothing is lost.
4. Candidates are verified by the exact edit distance of the item to any run around the window.

Items are read in blocks of ``ITEM_BLOCK`` items or ``BLOCK_BYTES`` of text (a stated query set against all rows); a
block's words and grams are what workers hold. Work is linear in the text, whatever the number of copies or the length of a document.

Defined results: null and empty texts contain nothing; items with fewer than MIN_WORDS words are matched as
whole runs without edits; empty items match nothing; of several runs that match an item the least edits are reported,
once; repeated documents or items are each reported; very long texts are searched whole, in a slice of their own;
without documents or items nothing is found; extra columns are not read by :func:`matches` and are passed on by
:func:`keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltgate.llm import flat
from siltgate.llm.common import map_texts, unique_name

SIMILARITY = 0.8
#: Longest word gram that places windows.
GRAM = 4
#: Items with fewer words are matched without edits: at 0.8 an edit more would join common phrases.
MIN_WORDS = 8
#: Output places that a repetition samples, the recall that repetitions must reach, and how many there are at most
#: before an item's windows are found by counting grams.
SAMPLED, RECALL, REPEATS = 3, 0.99, 64
#: Edited copies that the repetitions are sized on, and item lengths that are sized together (as the longest of them).
TRIED, LENGTHS = 200, 8
#: Items that a pass over the documents compares with, and bytes of their texts: either ends a block, so that what is
#: broadcast has a bound (a longer item is a block of its own).
ITEM_BLOCK, BLOCK_BYTES = 20_000, 8 << 20
#: Window cells (windows by words) that are embedded or verified at a time.
CELLS = 1 << 19
#: Bytes of text that are searched at a time: the walks of a slice's few windows share their steps.
SLICE = 6 << 20


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return 0 if n < MIN_WORDS else int((1 - similarity) * n + 1e-9)


def gram_length(n: int, similarity: float = SIMILARITY) -> int:
    """Length of a run of words that any text within the allowed edits has in common with the item."""
    k = edits_allowed(n, similarity)
    return max(1, min(GRAM, -(-(n - k) // (k + 1))))


@lru_cache(maxsize=4096)
def plan(n: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """For items of n words: which steps each repetition samples (steps by repetitions), and the walks' salts."""
    steps = 2 * n
    wanted = np.zeros((steps, repeats), np.bool_)
    for r in range(repeats):
        rng = np.random.default_rng((n, r))
        wanted[rng.choice(steps, size=min(SAMPLED, steps), replace=False), r] = True
    salt = _hash(np.arange(steps)[:, None] * 4096 + np.arange(repeats)[None, :], 11)
    return wanted[: int(np.flatnonzero(wanted.any(axis=1)).max()) + 1], salt


def embed(rows: np.ndarray, repeats: int) -> np.ndarray:
    """CGK walks over rows of word codes (padded by -1), a column for each repetition: the words read at the
    steps that it samples, hashed to one key."""
    n, width = rows.shape
    wanted, salt = plan(width, repeats)
    at, key, r = np.zeros((n, repeats), np.int64), np.zeros((n, repeats), np.uint64), np.arange(n)[:, None]
    padded = np.concatenate([rows, np.full((n, 1), -1, rows.dtype)], axis=1)
    for step, now in enumerate(wanted):
        word = padded[r, np.minimum(at, width)].astype(np.uint64)
        if now.any():
            key[:, now] = _hash(key[:, now] ^ (word[:, now] * np.uint64(2) + np.uint64(1)), step)
        walk = (word ^ salt[step]) * np.uint64(0xBF58476D1CE4E5B9)
        walk ^= walk >> np.uint64(32)
        walk *= np.uint64(0x94D049BB133111EB)
        at += (walk >> np.uint64(50)).astype(np.int64) & 1
    return key


def sellers(item: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each row of ``runs`` (word codes, -1 beyond the text), the least edits from the item to a run in it.

    The items are rows too; -2 pads them at the end. Rows are compared in parallel, one word of the run a step.
    """
    n, m = item.shape
    real = (item != -2).sum(axis=1)
    cost = np.tile(np.arange(m + 1, dtype=np.int32), (n, 1))
    rows = np.arange(n)
    best = real.astype(np.int32)
    ramp = np.arange(m + 1, dtype=np.int32)
    for j in range(runs.shape[1]):
        word = runs[:, j : j + 1]
        new = np.empty_like(cost)
        new[:, 0] = 0
        np.minimum(cost[:, :-1] + ((item != word) | (word == -1)), cost[:, 1:] + 1, out=new[:, 1:])
        # Deletions run along the item: new[i] = min over h <= i of new[h] + (i - h).
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best = np.minimum(best, cost[rows, real])
    return best


@dataclass
class Items:
    """A block of items, ready to be looked for."""

    ids: list
    words: pa.Array
    codes: list[np.ndarray]
    repeats: dict[int, int]
    similarity: float

    @classmethod
    def of(cls, ids: list, texts: list[str], similarity: float = SIMILARITY) -> Items:
        word, at = flat.plain_words(pa.array(texts, pa.string()), digits=True)
        code, names = flat.codes(word)
        rows = [code[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        kept = [(i, r) for i, r in zip(ids, rows, strict=True) if len(r)]
        made = cls([i for i, _ in kept], names.cast(pa.string()), [r for _, r in kept], {}, similarity)
        made.repeats = made._needed()
        return made

    def _needed(self) -> dict[int, int]:
        """By item length, the repetitions for RECALL of random edits at the threshold on the items themselves; 0 if more than REPEATS."""
        rng, by_length, out, enough = np.random.default_rng(5), {}, {}, True
        for code in self.codes:
            by_length.setdefault(len(code), []).append(code)
        lengths = sorted(by_length)
        for n in lengths:
            of = max(m for m in lengths if (m - 1) // LENGTHS == (n - 1) // LENGTHS)
            if of in out:
                out[n] = out[of]
                continue
            if not edits_allowed(of, self.similarity):
                out[n] = 1
                continue
            # What a length needs rises with it.
            out[n] = out[of] = self._repeats(by_length[of], rng) if enough else 0
            enough = out[n] > 0
        return out

    def _repeats(self, codes: list[np.ndarray], rng: np.random.Generator) -> int:
        n = len(codes[0])
        pair = np.full((2 * TRIED, n), -1, np.int64)
        for t in range(TRIED):
            code = codes[t * len(codes) // TRIED if len(codes) > TRIED else t % len(codes)]
            changed = list(code)
            for _ in range(edits_allowed(n, self.similarity)):
                p, kind = int(rng.integers(len(changed))), int(rng.integers(3))
                if kind == 0:
                    changed[p] = -1
                elif kind == 1 and len(changed) > 1:
                    del changed[p]
                else:
                    changed.insert(p, -1)
            pair[t], pair[TRIED + t, : min(n, len(changed))] = code, changed[:n]
        key = embed(pair, REPEATS)
        recall = np.logical_or.accumulate(key[:TRIED] == key[TRIED:], axis=1).mean(axis=0)
        reached = np.flatnonzero(recall >= RECALL)
        return int(reached[0]) + 1 if len(reached) else 0

    def prepare(self) -> None:
        """Grams and sampled keys of the items, on the worker."""
        self.length = np.array([len(c) for c in self.codes], np.int64)
        by_gram: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        counted: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, c in enumerate(self.codes):
            g = gram_length(len(c), self.similarity)
            o = np.arange(len(c) - g + 1)
            if not self.repeats[len(c)]:
                counted.setdefault(g, []).append((self.grams(c, g), np.full(len(o), i), o))
                continue
            by_gram.setdefault(g, []).append((self.grams(c, g), np.full(len(o), len(c)), o))
        self.places = {}
        for g, parts in by_gram.items():
            key, n, o = (np.concatenate(p) for p in zip(*parts, strict=True))
            # One entry for each (gram, item size, place in the item).
            triple = np.unique(np.rec.fromarrays([key, n, o]))
            key = triple.f0
            bits = np.zeros(1 << 22, np.bool_)
            bits[(key & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.places[g] = (key, triple.f1, triple.f2, bits)
        self.counted = {}
        for g, parts in counted.items():
            key, item, o = (np.concatenate(p) for p in zip(*parts, strict=True))
            by = np.argsort(key, kind="stable")
            self.counted[g] = (key[by], item[by], o[by])
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.length):
            if not self.repeats[int(n)]:
                continue
            own = np.flatnonzero(self.length == n)
            rows = np.stack([self.codes[i] for i in own])
            for seed, key in enumerate(embed(rows, self.repeats[int(n)]).T):
                by = np.argsort(key, kind="stable")
                self.tables[int(n), seed] = (key[by], own[by])

    @staticmethod
    def grams(code: np.ndarray, g: int) -> np.ndarray:
        """Hashes of all runs of g words."""
        key = _hash(code, 1)
        out = key[: max(len(code) - g + 1, 0)].copy()
        for k in range(1, g):
            out = _hash(out ^ key[k : len(code) - g + 1 + k], k + 1)
        return out

    def windows(self, code: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(size, starts): the windows of each item size that some gram of an item of that size places."""
        found: dict[int, list[np.ndarray]] = {}
        for g, (key, size, offset, bits) in self.places.items():
            if len(code) < g:
                continue
            have = self.grams(code, g)
            at = np.flatnonzero(bits[(have & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = at[(own[at] == own[at + g - 1])]
            low, high = np.searchsorted(key, have[at], "left"), np.searchsorted(key, have[at], "right")
            n = high - low
            at = np.repeat(at, n)
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(at))
            for s in np.unique(size[entry]):
                of = size[entry] == s
                found.setdefault(int(s), []).append((at[of] - offset[entry[of]]) * (1 << 31) + own[at[of]])
        for s, keys in found.items():
            yield s, np.unique(np.concatenate(keys))

    def runs(self, code: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, texts, items, starts) for items that are not sampled: enough of an item's grams are whole with starts
        (a gram's place less its place in the item) within the allowed edits of each other, the least of them among
        the ``edits + 1`` places from the start given."""
        for g, (key, item, offset) in self.counted.items():
            if len(code) < g:
                continue
            have = self.grams(code, g)
            at = np.flatnonzero(own[: len(have)] == own[g - 1 :])
            low, high = np.searchsorted(key, have[at], "left"), np.searchsorted(key, have[at], "right")
            n = high - low
            at = np.repeat(at, n)
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(at))
            text, of, start = own[at], item[entry], at - offset[entry]
            by = np.lexsort((start, of, text))
            text, of, start = text[by], of[by], start[by]
            size = self.length[of]
            k = np.array([edits_allowed(m, self.similarity) for m in range(int(size.max(initial=0)) + 1)])[size]
            least = np.maximum(1, size - g + 1 - k * g)
            pair = np.cumsum(np.concatenate([[0], (text[1:] != text[:-1]) | (of[1:] != of[:-1])])) if len(text) else text
            # Starts lie in (-longest item, words): one number for a pair and its start.
            wide = len(code) + 2 * int(self.length.max()) + 2
            place = pair * wide + start + int(self.length.max())
            many = np.searchsorted(place, place + np.minimum(k, wide), "right") - np.arange(len(place)) >= least
            found = np.unique(np.stack([size[many], text[many], of[many], start[many] // (k[many] + 1) * (k[many] + 1)]), axis=1)
            for s in np.unique(found[0]):
                yield int(s), *found[1:, found[0] == s]

    def matches(self, code: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, edits) of every text and item within the item's allowed edits, the least for each pair."""
        own = flat.owners(off)
        best: dict[tuple[int, int], int] = {}
        for size, keys in self.windows(code, own):
            start, text = keys >> 31, keys & ((1 << 31) - 1)
            k = edits_allowed(size, self.similarity)
            piece = max(1, CELLS // size)
            for a in range(0, len(start), piece):
                s, t = start[a : a + piece], text[a : a + piece]
                place = s[:, None] + np.arange(size)
                inside = (place >= off[t][:, None]) & (place < off[t + 1][:, None])
                rows = np.where(inside, code[np.clip(place, 0, len(code) - 1)], -1)
                pairs = []
                for seed, have in enumerate(embed(rows, self.repeats[size]).T):
                    key, item = self.tables[size, seed]
                    low, high = np.searchsorted(key, have, "left"), np.searchsorted(key, have, "right")
                    n = high - low
                    w = np.repeat(np.arange(len(have)), n)
                    pairs.append(w * len(self.codes) + item[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(w))])
                pair = np.unique(np.concatenate(pairs))
                w, item = pair // len(self.codes), pair % len(self.codes)
                step = max(1, CELLS // (size + 2 * k + 1))
                for b in range(0, len(w), step):
                    ww, ii = w[b : b + step], item[b : b + step]
                    wide = s[ww][:, None] + np.arange(-k, size + k)
                    inside = (wide >= off[t[ww]][:, None]) & (wide < off[t[ww] + 1][:, None])
                    runs = np.where(inside, code[np.clip(wide, 0, len(code) - 1)], -1)
                    edits = sellers(np.stack([self.codes[i] for i in ii]), runs)
                    for x in np.flatnonzero(edits <= k):
                        who = (int(t[ww[x]]), int(ii[x]))
                        best[who] = min(best.get(who, size), int(edits[x]))
        for size, text, item, start in self.runs(code, own):
            k = edits_allowed(size, self.similarity)
            step = max(1, CELLS // (size + 3 * k + 1))
            for a in range(0, len(text), step):
                t, ii = text[a : a + step], item[a : a + step]
                wide = start[a : a + step, None] + np.arange(-k, size + 2 * k + 1)
                inside = (wide >= off[t][:, None]) & (wide < off[t + 1][:, None])
                edits = sellers(np.stack([self.codes[i] for i in ii]), np.where(inside, code[np.clip(wide, 0, len(code) - 1)], -1))
                for x in np.flatnonzero(edits <= k):
                    who = (int(t[x]), int(ii[x]))
                    best[who] = min(best.get(who, size), int(edits[x]))
        return [(text, item, e) for (text, item), e in sorted(best.items())]


def blocks(benchmark: DataFrame, similarity: float = SIMILARITY, size: int = ITEM_BLOCK) -> Iterator[Items]:
    """The items, block by block in order of their id; the driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        more = len(row[1].encode())
        if block and (len(block) == size or held + more > BLOCK_BYTES):
            yield Items.of([r[0] for r in block], [r[1] for r in block], similarity)
            block, held = [], 0
        block.append(row)
        held += more
    if block:
        yield Items.of([r[0] for r in block], [r[1] for r in block], similarity)


def _found(docs: DataFrame, items: Items, item_type: T.DataType, columns: list[str], name: str = "found") -> DataFrame:
    """The columns and an array of (item_id, edits, n_words) for every row."""
    entry = T.StructType([T.StructField("item_id", item_type), T.StructField("edits", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(name, T.ArrayType(entry))])
    shared = docs.sparkSession.sparkContext.broadcast(items)
    ready: list[Items] = []
    entries = to_arrow_type(entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            shared.value.prepare()
            ready.append(shared.value)
        own = ready[0]
        for batch in batches:
            for piece in flat.slices(batch, size=SLICE):
                word, off = flat.plain_words(flat.texts(piece.column("text")), digits=True)
                code = pc.fill_null(pc.index_in(word, own.words.cast(word.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                got = own.matches(code, off) if len(code) and own.codes else []
                count = np.bincount([g[0] for g in got], minlength=piece.num_rows) if got else np.zeros(piece.num_rows, np.int64)
                values = pa.array([{"item_id": own.ids[i], "edits": e, "n_words": len(own.codes[i])} for _, i, e in got], entries)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in columns] + [lists], [*columns, name])

    return map_texts(docs.select(*dict.fromkeys([*columns, "text"])), run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, edits, n_words: a row for each document and each item that it contains."""
    kind, out = benchmark.schema["item_id"].dataType, None
    for items in blocks(benchmark, similarity):
        part = _found(docs, items, kind, ["doc_id"]).select("doc_id", F.inline("found"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("edits"), F.lit(0).alias("n_words")).where(F.lit(False))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of the rows that contain no item."""
    kind = benchmark.schema["item_id"].dataType
    for items in blocks(benchmark, similarity):
        name = unique_name(docs, "found")
        docs = _found(docs, items, kind, docs.columns, name).where(F.size(name) == 0).drop(name)
    return docs
