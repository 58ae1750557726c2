"""Simple-8b coding of unsigned ids in 64-bit words, vectorised over many blocks.

A word has a selector in its four high bits; the selector says how many ids of how many bits fill the other
60 bits, lowest first. Selector 15 is an escape: the next word is one id of up to 64 bits as it is. Ids are
coded in blocks of ``BLOCK``; each block starts a word, so blocks decode alone from their offsets.
"""

from __future__ import annotations

import numpy as np

#: Ids to a word, and bits to an id, by selector. Fixed values of the format.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
BLOCK = 1_024


def _runs(holds: np.ndarray, count: int) -> np.ndarray:
    """Whether ``count`` elements from each one on hold; beyond the end none does."""
    out, have = holds, 1
    while have < count:
        step = min(have, count - have)
        out = np.concatenate([out[:-step] & out[step:], np.zeros(min(step, len(out)), np.bool_)])
        have += step
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): block i of the ids is ``words[offsets[i]:offsets[i + 1]]``."""
    given, ids = ids, ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // block)
    ends = np.minimum((np.arange(blocks) + 1) * block, n)
    # For each id the best selector for a word that starts with it. Where the ids of one selector fit, those of
    # every selector with fewer and wider ids do, so each step only takes away from what the step before left over.
    choice, fits = np.full(n, ESCAPE, np.int8), np.ones(n, np.bool_)
    left = np.tile(np.arange(block, 0, -1, dtype=np.int32), blocks)[:n]
    left[(blocks - 1) * block :] = np.arange(n - (blocks - 1) * block, 0, -1)
    largest = int(ids.max())
    for s in range(len(COUNTS) - 1, -1, -1):
        fits &= left >= COUNTS[s]
        limit = (1 << int(BITS[s])) - 1
        if largest > limit:
            fits &= _runs(given <= limit, int(COUNTS[s]))
        if not fits.any():
            break
        choice[fits] = s
    # All blocks go forward one word at a time.
    at, lane = np.arange(blocks) * block, np.arange(blocks)
    heads, lanes = [], []
    step = np.ones(16, np.int64)
    step[: len(COUNTS)] = COUNTS
    while len(at):
        heads.append(at)
        lanes.append(lane)
        at = at + step[choice[at]]
        on = at < ends[lane]
        at, lane = at[on], lane[on]
    head, lane = np.concatenate(heads), np.concatenate(lanes)
    by = np.argsort(head, kind="stable")
    head, lane = head[by], lane[by]
    chosen = choice[head].astype(np.int64)
    size = 1 + (chosen == ESCAPE)
    place = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(place[-1], np.uint64)
    words[place[:-1]] = chosen.astype(np.uint64) << np.uint64(60)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[place[escaped] + 1] = ids[head[escaped]]
    for s in np.unique(chosen[chosen != ESCAPE]):
        own = np.flatnonzero(chosen == s)
        packed = np.zeros(len(own), np.uint64)
        for k in range(int(COUNTS[s])):
            packed |= ids[head[own] + k] << np.uint64(k * int(BITS[s]))
        words[place[own]] |= packed
    per = np.bincount(lane, weights=size, minlength=blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per)])


def decode(words: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks that ``offsets`` cut ``words`` into, in order: all blocks decoded at once, each from its own start.

    ``offsets`` may begin anywhere, so a run of blocks decodes without the words before it.
    """
    words, offsets = words[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # A word after an escape is an id; runs that look like escapes are resolved from their first word, or their block's.
    maybe = selector == ESCAPE
    raw = np.zeros(n, np.bool_)
    if maybe.any():
        run_start = maybe.copy()
        run_start[1:] &= ~maybe[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        run_start[begins] = maybe[begins]
        first = np.maximum.accumulate(np.where(run_start, np.arange(n), 0))
        head = maybe & ((np.arange(n) - first) % 2 == 0)
        raw[1:] = head[:-1]
    counts = np.zeros(n, np.int64)
    plain = ~raw & ~maybe
    counts[plain] = COUNTS[selector[plain]]
    counts[raw] = 1
    place = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(place[-1], np.uint64)
    out[place[:-1][raw]] = words[raw]
    for s in np.unique(selector[plain]):
        own = np.flatnonzero(plain & (selector == s))
        bits, mask = int(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[place[own] + k] = (words[own] >> np.uint64(k * bits)) & mask
    per = np.diff(place[offsets])
    if (per[:-1] != block).any() or per[-1] > block:
        raise ValueError("a block does not hold the ids that its offset promises")
    return out


def between(words: np.ndarray, offsets: np.ndarray, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """The ids from ``start`` to before ``stop``; only the blocks that hold them are decoded."""
    first, last = start // block, -(-stop // block)
    if first >= last:
        return np.zeros(0, np.uint64)
    return decode(words, offsets[first : last + 1], block)[start - first * block : stop - first * block]
