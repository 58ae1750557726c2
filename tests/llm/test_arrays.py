"""The vectorised helpers against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from siltgate.llm import flat, simhash, simple8b, text_stats, tokens

ODD = ["", " ", "\n\n", "a\x1cb c d", "É é x", "\ta\x0b\x0c\r\nb", "日本 語", "word " * 50]
TEXT = st.lists(st.sampled_from(["ab ", "é ", "\n", "c# ", " \x0b", "x y ", "|", "a long line\n", "ÀÉ", "\x1c"]), max_size=80).map("".join)


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def plain_stats(t):
    w = plain_words(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(plain_words(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_stats_equal_plain_python(texts):
    got = text_stats.measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_stats(t)


def test_stats_do_not_depend_on_neighbours():
    random.seed(2)
    texts = ODD + ["".join(random.choices(["ab ", "cd ", "\n"], k=90)) for _ in range(40)]
    together = text_stats.measure(pa.array(texts))
    for i, t in enumerate(texts):
        alone = text_stats.measure(pa.array([t]))
        assert all(alone[k][0] == together[k][i] for k in text_stats.STATS)


def test_words_and_slices():
    word, off = flat.words(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert word.slice(off[i], off[i + 1] - off[i]).to_pylist() == plain_words(t)
    batch = pa.record_batch([pa.array(["x" * 30, None, "y" * 5, "z" * 100])], ["text"])
    pieces = list(flat.slices(batch, size=32))
    assert sum(p.num_rows for p in pieces) == 4 and len(pieces) > 1
    assert list(flat.slices(batch.slice(0, 0))) == []


def test_plain_words_split_punctuation():
    word, off = flat.plain_words(pa.array(["“Idiot”, «moron»… x1 É", ""]))
    assert word.to_pylist() == ["idiot", "moron", "x", "é"] and off.tolist() == [0, 4, 4]
    word, _ = flat.plain_words(pa.array(["a1-B2"]), digits=True)
    assert word.to_pylist() == ["a1", "b2"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**16), st.integers(0, 2**64 - 1), st.integers(0, 1)), max_size=400), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    words, off = simple8b.encode(ids, block)
    assert (simple8b.decode(words, off, block) == ids).all()
    for i in range(len(off) - 1):
        assert (simple8b.decode(words, off[i : i + 2], block) == ids[i * block : (i + 1) * block]).all()


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(4, 2**64 - 1, np.uint64))[0]) == 8


def plain_fingerprint(t, n):
    w = plain_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [3, 5])
def test_fingerprints_equal_plain_python(n):
    texts = ODD + ["A b", "Ünï ÉÀ x y z", "a b c d e f g a b c", "w1 " * 40]
    got = simhash.majority(*simhash.shingle_hashes(pa.array(texts), n))
    assert [int(x) for x in got] == [plain_fingerprint(t, n) for t in texts]


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_bk_forest_finds_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    v = np.concatenate([base, *(base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 4)), base])
    shard = rng.integers(0, 3, len(v))
    forest = simhash.BKForest(v, shard)
    got = set()
    for a, found in forest.within(v, shard, radius, block=50):
        got |= set(zip(a.tolist(), found.tolist(), strict=True))
    want = {(i, int(v[j])) for i in range(len(v)) for j in range(len(v)) if shard[i] == shard[j] and int(v[i] ^ v[j]).bit_count() <= radius}
    assert got == want
    none = simhash.BKForest(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert list(none.within(v, shard, 2)) == []


def test_sketch_similarity_is_exact_for_few_shingles():
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(3, 50))
    hashes, off = simhash.shingle_hashes(pa.array([a, b, ""]), 5)
    least, keys = simhash.sketches(hashes, off)
    assert simhash.similar(least[:1], least[1:2], 43 / 46)[0] and not simhash.similar(least[:1], least[1:2], 43.1 / 46)[0]
    assert not keys[2].any()


def test_trees_find_all_pairs_of_a_shard_within_a_wide_radius(monkeypatch):
    """Copies of fingerprints, rows of several shards, trees and queries apart: each pair once, as all pairs have it."""
    rng = np.random.default_rng(11)
    n, rows = 120, 400
    fp = rng.integers(0, 2**64, n, np.uint64)
    fp[n // 2 :] = fp[rng.integers(0, n // 2, n - n // 2)] ^ np.uint64(0b1011)
    fp[:10] = fp[0]
    at = np.unique(np.stack([rng.integers(0, n, rows), rng.integers(0, 3, rows)]), axis=1)
    place, shard = at[0], at[1]
    whole = np.ones(len(place), np.bool_)
    half = place % 2 == 0
    for visited, compared in ((1 << 19, 1 << 20), (64, 16)):
        monkeypatch.setattr(simhash, "VISITED", visited)
        monkeypatch.setattr(simhash, "COMPARED", compared)
        for radius in (3, 24):
            for tree, asked in ((whole, whole), (half, ~half)):
                want = sorted((min(a, b), max(a, b)) for i, a in enumerate(place) for j, b in enumerate(place) if shard[i] == shard[j] and tree[i] and asked[j] and (i < j or not tree[j]) and int(fp[a] ^ fp[b]).bit_count() <= radius)
                got = sorted((min(a, b), max(a, b)) for x, y in simhash.tree_pairs(place, fp, shard, tree, asked, radius) for a, b in zip(x.tolist(), y.tolist(), strict=True))
                assert got == want and want


def test_names_are_the_words():
    for words in ([], ["a"], ["é", "x\x00y", "一二", "\u3000z", "a"]):
        assert tokens._names(pa.array(words, pa.string())) == words
        assert tokens._names(pa.array(words, pa.large_string())) == words


def test_runs_and_greedy_words():
    """Every word holds as many of the ids from its first one on as any selector can, within the block."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 59, 60, 61, 300):
        holds = rng.random(n) < 0.8
        for count in (1, 2, 3, 7, 60):
            assert simple8b._runs(holds, count).tolist() == [i + count <= n and bool(holds[i : i + count].all()) for i in range(n)]
    for kind, block in ((np.uint32, 64), (np.uint64, 100)):
        ids = (2.0 ** rng.integers(0, 32, 700) * rng.random(700)).astype(kind)
        ids[100:400] //= 1 << 20
        words, at = simple8b.encode(ids, block)
        for k in range(len(at) - 1):
            rest, mine = ids[k * block : (k + 1) * block].tolist(), words[at[k] : at[k + 1]].tolist()
            for word in mine:
                best = next(s for s, (c, b) in enumerate(zip(simple8b.COUNTS, simple8b.BITS, strict=True)) if c <= len(rest) and max(rest[:c]) < 1 << int(b))
                assert word >> 60 == best
                rest = rest[simple8b.COUNTS[best] :]
            assert not rest
