"""SimHash near-duplicates with BK-trees.

A fingerprint has bit i set if more than half of a text's shingle hashes have it. Documents whose fingerprints
differ in at most ``RADIUS`` bits are linked; a document's component is the smallest id that links reach.

Search works on distinct fingerprints (copies collapse before anything else). Of RADIUS + 1 blocks that the 64
bits are cut into, two linked fingerprints share one whole block, so each (block, value) is a shard, and a
BK-tree is grown for each shard: a child hangs below its parent at the key of their Hamming distance, and a
query follows only edges within the radius of its own distance. Shards go to tasks by their key; a shard that
is larger than ``TREE`` is cut into trees of at most that many fingerprints, each tree meets the shard's
fingerprints in pieces of that size, and pieces are tasks' rows of their own, so a hot shard spreads over
many tasks. Trees hold at most ``TREE`` fingerprints of 8 bytes; no task or driver holds all.

A shard yields a star per group that it finds (not the pairs of a group), and the stars of all shards are
joined into components by alternating large and small stars on tables in the shared folder.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; texts with fewer
words than a shingle have one shingle, the whole sequence; very long texts are hashed whole, in a slice of their
own; a bit that exactly half of the hashes have is 0; repeated rows each get a row; rows with a null id take no part
in ids' minima, and if nothing else is in a component its id is null; an empty table gives an empty result; other
columns are not read by :func:`clusters` and are passed on by :func:`keep_one`, in which rows are told apart by id
and text, of a component the row with the smallest (id, text's hash) stays, once, and rows without an id all stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgate.llm import flat
from siltgate.llm.common import map_texts, scratch, stored, unique_name

SEED = 42
RADIUS = 2
#: Fingerprints of one tree, at most.
TREE = 8_192
#: Fingerprints, counted once for each work item that they are in, that a Python worker has at a time, about.
GROUP_ROWS = 40_000
#: Nodes of BK-trees that a block of queries visits at a wide radius, at most, about.
VISITED = 1 << 19
#: Shingles that are hashed at a time.
HASHED = 1 << 17


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of each text (A-Z lower-cased, repeats included), and offsets by text."""
    word, at = flat.words(pc.ascii_lower(column))
    n = np.diff(at)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    many = np.maximum(n - words + 1, (n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(many)])
    own = flat.owners(off)
    start = at[own] + (np.arange(off[-1]) - off[own])
    end = np.minimum(start + words, at[own + 1])
    # Words joined by one space, as one byte string: a shingle is a slice of it.
    lengths = pc.binary_length(word).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(word)], pa.int32()), word.cast(pa.string())), " ")[0].as_buffer()
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    first, last, out = place[start], place[end] - 1, np.empty(len(start), np.uint64)
    # A piece at a time: as Python numbers places take ten times the room.
    for x in range(0, len(out), HASHED):
        out[x : x + HASHED] = [hashed(view[a:b], SEED) for a, b in zip(first[x : x + HASHED].tolist(), last[x : x + HASHED].tolist(), strict=True)]
    return out, off


def majority(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its hashes."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, off[:-1][some], axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * sums > n[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns and ``fp`` (the fingerprint as a signed long) for every row."""
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.slices(batch):
                fp = majority(*shingle_hashes(flat.texts(piece.column("text")), words))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in columns] + [pa.array(fp.view(np.int64))], [*columns, "fp"])

    return map_texts(docs.select(*dict.fromkeys([*columns, "text"])), run, schema)


class BKForest:
    """BK-trees of 64-bit fingerprints as flat arrays: one tree for each shard number, grown and searched together.

    Children are kept sorted by (parent, distance to the parent), so the edges within a radius are one range.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        by = np.argsort(shard, kind="stable")
        self.values, shard = values[by], shard[by]
        self.shards, root, self.sizes = np.unique(shard, return_index=True, return_counts=True)
        self.roots = root.astype(np.int64)
        n = len(values)
        parent, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        # All fingerprints descend together: those at a node hang below it by distance; the first of each
        # (node, distance) becomes the child there and the others go on from that child.
        left = np.ones(n, np.bool_)
        left[root] = False
        left = np.flatnonzero(left)
        at = self.roots[np.searchsorted(self.shards, shard[left])]
        while len(left):
            d = np.bitwise_count(self.values[at] ^ self.values[left]).astype(np.int64)
            _, first, group = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = left[first]
            parent[child], key[child] = at[first], d[first]
            rest = np.ones(len(left), np.bool_)
            rest[first] = False
            at, left = child[group][rest], left[rest]
        self.order = np.argsort(parent * 65 + key, kind="stable")
        self.edges = (parent * 65 + key)[self.order]

    def within(self, queries: np.ndarray, shard: np.ndarray, radius: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (query number, found fingerprint) of all pairs of a shard within the radius, a block of queries at a time."""
        for q, node in self.nodes_within(queries, shard, radius, block):
            yield q, self.values[node]

    def nodes_within(self, queries: np.ndarray, shard: np.ndarray, radius: int, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As :meth:`within`, with numbers of fingerprints (those of a shard together, in the given order).

        Without ``block``, which a wide radius asks for, a block's queries have VISITED nodes in their trees, about.
        """
        tree = np.searchsorted(self.shards, shard)
        known = np.flatnonzero((tree < len(self.shards)) & (self.shards[np.minimum(tree, len(self.shards) - 1)] == shard)) if len(self.shards) else np.zeros(0, np.int64)
        if block:
            cuts = [*range(0, len(known), block), len(known)]
        else:
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(self.sizes[tree[known]]) // VISITED)) + 1).tolist(), len(known)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            q = known[x:y]
            node = self.roots[tree[q]]
            while len(q):
                d = np.bitwise_count(self.values[node] ^ queries[q]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                q = np.repeat(q, n)
                ends = np.cumsum(n)
                node = self.order[np.repeat(low - (ends - n), n) + np.arange(len(q))]


#: Pairs that are checked at a time; pairs whose ends are already in one group need no check.
CHECKED = 5_000


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], holds: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The smallest member's number of each one's group, for links between numbers below ``n``.

    With ``holds``, a pair counts only if that says so; it is asked about pairs that groups do not join yet.
    """
    root = np.arange(n)
    for some_a, some_b in pairs:
        for at in range(0, len(some_a), CHECKED if holds else max(len(some_a), 1)):
            a, b = some_a[at : at + CHECKED] if holds else some_a, some_b[at : at + CHECKED] if holds else some_b
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if holds and len(a):
                true = holds(a, b)
                a, b = a[true], b[true]
            while len(a):
                ra, rb = root[a], root[b]
                low, high = np.minimum(ra, rb), np.maximum(ra, rb)
                open_ = low != high
                if not open_.any():
                    break
                a, b = a[open_], b[open_]
                np.minimum.at(root, high[open_], low[open_])
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    return root


def shard_links(fp: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, in_query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest member) of the groups that links between a shard's queries and its tree make."""
    forest = BKForest(fp[in_tree], shard[in_tree])
    both = np.unique(fp)
    place = np.searchsorted(both, fp[in_query])
    root = _roots(len(both), ((place[a], np.searchsorted(both, v)) for a, v in forest.within(fp[in_query], shard[in_query], radius)))
    some = np.flatnonzero(root != np.arange(len(both)))
    return both[some], both[root[some]]


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Stars (u, v), v < u, over distinct fingerprints ``fp``: connected exactly as all links within the radius are."""
    width = -(-64 // (radius + 1))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1)).alias("value")) for i in range(radius + 1)])
    cells = distinct.select("fp", F.explode(blocks).alias("b")).select("fp", "b.*")
    # A shard's size decides how many trees it has; sizes are counted with map-side combining.
    # Within a shard a fingerprint's piece follows from its hash.
    sizes = stored(cells.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("pieces", F.ceil(F.col("n") / tree).cast("int")), "simhash-shards")
    total = sizes.agg(F.sum(F.col("n") * F.col("pieces"))).first()[0] or 0
    sized = cells.join(sizes, ["block", "value"])
    piece = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("pieces")).cast("int")
    # Work item (i, j), i <= j, of a shard has the tree of piece i and the queries of piece j.
    own = sized.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "fp", (F.col("block") * F.lit(1 << width) + F.col("value")).alias("shard"), F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"),
        (F.col("piece") <= F.col("other")).alias("in_tree"), (F.col("piece") >= F.col("other")).alias("in_query"),
    )
    groups = max(1, -(-total // GROUP_ROWS))

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        col = {c: rows.column(c).to_numpy() for c in ("fp", "shard", "i", "j", "in_tree", "in_query")}
        side = int(col["j"].max()) + 1
        shard = (col["shard"] * side + col["i"]) * side + col["j"]
        u, v = shard_links(col["fp"].view(np.uint64), shard, col["in_tree"], col["in_query"], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    # Work items are dealt by hash to groups of about GROUP_ROWS rows; a group grows all of its trees at once.
    return own.groupBy(F.pmod(F.xxhash64("shard", "i", "j"), F.lit(groups)).alias("g")).applyInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): alternating large and small stars until nothing changes.

    Each round is a table in the shared folder, so lineage stays short and a lost executor costs a task; it is
    deleted once the next one stands.
    """
    canon = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with ExitStack() as held:
        now, state = held.enter_context(scratch(edges.sparkSession))(canon(edges), "simhash-edges"), None
        for _ in range(rounds):
            ends = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = ends.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = canon(large)
            small_low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
            following = ExitStack()
            now = following.enter_context(scratch(edges.sparkSession))(canon(small), "simhash-edges")
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            held.close()
            held.push(following)
            if tuple(seen) == state:
                break
            state = tuple(seen)
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        return stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct()), "simhash-components")


def clusters(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    marked = stored(fingerprints(docs, words), "simhash-fingerprints")
    rooted, least = _rooted(marked, F.col("doc_id"), lambda distinct: links(distinct, radius))
    return _with_component(marked, rooted, least)


def _rooted(marked: DataFrame, low: Column, linked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(f, low, root) of each distinct ``fp`` in ``marked``, and (root, low) of each component: ``low`` is the smallest there.

    ``linked`` gives the stars between distinct fingerprints.
    """
    with scratch(marked.sparkSession) as put:
        per = put(marked.groupBy("fp").agg(F.min(low).alias("low")), "simhash-distinct")
        found = components(linked(per.select("fp")))
        rooted = stored(per.join(found, per["fp"] == found["node"], "left").select(per["fp"].alias("f"), "low", F.coalesce("root", per["fp"]).alias("root")), "simhash-rooted")
    # A table of its own: a component of a third of all fingerprints is then a skewed side that the join can split.
    return rooted, stored(rooted.groupBy("root").agg(F.min("low").alias("low")), "simhash-least")


def _with_component(marked: DataFrame, rooted: DataFrame, least: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp) with component_id."""
    named = rooted.select("f", "root").join(least, "root").select("f", F.col("low").alias("component_id"))
    return marked.join(named, marked["fp"] == named["f"], "left").select(*marked.columns, "component_id")


#: Of the near-duplicate stage: five-word shingles and a similarity of 0.8.
WORDS, SIMILARITY = 5, 0.8
#: Shards of the stage: BANDS keys of ROWS minima each. Texts of similarity 0.8 miss each other in all of
#: them once in 460 (0.36 to the power 6).
BANDS, ROWS = 6, 2
#: Smallest shingle hashes that a text keeps, and the similarity that they must show for whole sets to be compared:
#: at 0.8 the estimate's standard error is 0.04, so that about one true pair in 10,000 is below.
SKETCH, LOOSE = 96, 0.65
#: Bits that fingerprints of distinct shingles differ in, at most, for whole sets to be compared. By the exact odds for
#: independent hashes a pair at 0.8 is beyond that once in 8,000 (four shingles of five) to 300,000 (hundreds).
NEAR_RADIUS = 24
#: Bytes of shingle hashes of one piece of a group whose whole sets are compared, at most, about.
PIECE_BYTES = 16 << 20
#: Shingle hashes that are compared at a time.
COMPARED = 1 << 20
_NONE = np.uint64(2**64 - 1)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """A different order of the hashes for each ``i``."""
    x = (h ^ np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in rising order, and offsets by text."""
    own = flat.owners(off)
    by = np.lexsort((hashes, own))
    h, o = hashes[by], own[by]
    first = np.ones(len(h), np.bool_)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=len(off) - 1))]).astype(np.int64)


def set_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for each set of hashes: equal for equal sets, zero for the empty one."""
    out, some = np.zeros(len(off) - 1, np.uint64), np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = _mixed(np.add.reduceat(_mixed(h, BANDS * ROWS), off[:-1][some]), BANDS * ROWS + 1)
    return out


def sketches(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the SKETCH smallest distinct hashes (padded with all ones), and BANDS shard keys."""
    n = len(off) - 1
    least, keys = np.full((n, SKETCH), _NONE), np.zeros((n, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(off))
    if not len(some):
        return least, keys
    h, at = shingle_sets(hashes, off)
    o = flat.owners(at)
    rank = np.arange(len(o)) - at[o]
    low = rank < SKETCH
    least[o[low], rank[low]] = h[low]
    for b in range(BANDS):
        key = np.full(len(some), b, np.uint64)
        for r in range(ROWS):
            key = _mixed(key ^ np.minimum.reduceat(_mixed(h, b * ROWS + r), at[:-1][some]), b)
        keys[some, b] = key
    return least, keys


def similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of sketches have a Jaccard similarity of at least ``least``, from the union's smallest hashes."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != _NONE
    twin = np.zeros(both.shape, np.bool_)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1)
    inside = (rank <= SKETCH) & real
    shared, union = (twin & inside).sum(axis=1), (inside & ~twin).sum(axis=1)
    return shared >= least * union - 1e-9


class Sets:
    """Sets of shingle hashes (sorted, by offsets), for exact comparisons."""

    def __init__(self, h: np.ndarray, off: np.ndarray):
        self.names, self.code = np.unique(h, return_inverse=True)
        self.off, self.size = off, np.diff(off)

    def similar(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether pairs of sets have a Jaccard similarity of at least ``least``."""
        out = np.zeros(len(a), np.bool_)
        both = self.size[a] + self.size[b]
        piece = np.cumsum(both) // COMPARED
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(a)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            one = np.concatenate([a[x:y], b[x:y]])
            n = self.size[one]
            at = np.repeat(self.off[one] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair = np.repeat(np.tile(np.arange(y - x), 2), n)
            key = np.sort(pair * len(self.names) + self.code[at])
            shared = np.bincount(key[1:][key[1:] == key[:-1]] // max(len(self.names), 1), minlength=y - x)
            out[x:y] = shared >= least * (both[x:y] - shared) - 1e-9
        return out


def _marks(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per sketch 256 bits that its hashes set (by their lowest byte), and how many hashes it has."""
    bits = np.zeros((len(sketch), 256), np.bool_)
    row, col = np.nonzero(sketch != _NONE)
    bits[row, (sketch[row, col] & np.uint64(255)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64), np.bincount(row, minlength=len(sketch))


def _bounds(size: np.ndarray, sketch: np.ndarray, similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of places are not too unlike in size and could pass :func:`similar`: no pair that passes the check fails."""
    marks, count = _marks(sketch)

    def could(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        unlike = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64)
        alike = unlike <= count[a] + count[b] - 2 * LOOSE * np.maximum(count[a], count[b]) + 1e-9
        return alike & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)

    return could


def tree_pairs(place: np.ndarray, fp: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, in_query: np.ndarray, radius: int = NEAR_RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that meet in a shard with fingerprints within the radius, each once: found in the shards' BK-trees.

    ``fp`` is by place, the rest by row. Places with one fingerprint are one node of a tree.
    """
    asked, own = np.flatnonzero(in_query), np.flatnonzero(in_tree)
    own = own[np.lexsort((fp[place[own]], shard[own]))]
    f, s = fp[place[own]], shard[own]
    first = np.ones(len(own), np.bool_)
    first[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
    start = np.flatnonzero(first)
    many = np.diff(np.append(start, len(own)))
    for q, node in BKForest(f[start], s[start]).nodes_within(fp[place[asked]], shard[asked], radius):
        n = many[node]
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // COMPARED)) + 1).tolist(), len(q)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            ends = np.cumsum(n[x:y])
            a = np.repeat(asked[q[x:y]], n[x:y])
            b = own[np.repeat(start[node[x:y]] - (ends - n[x:y]), n[x:y]) + np.arange(len(a))]
            # Where a row is in the tree and asked too, both orders of a pair are found.
            once = ~in_tree[a] | (a < b)
            yield place[a[once]], place[b[once]]


def _met(place: np.ndarray, size: np.ndarray, sketch: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, in_query: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places that meet in a shard and are within :func:`_bounds`. ``size`` and ``sketch`` are by place, the rest by row."""
    could = _bounds(size, sketch, similarity)
    by = np.lexsort((size[place], shard))
    place, s, t, q = place[by], shard[by], in_tree[by], in_query[by]
    left = np.arange(len(by))
    for d in range(1, len(by)):
        left = left[left + d < len(by)]
        # Sizes rise within a shard: a row whose next one is too large is done.
        left = left[(s[left] == s[left + d]) & (size[place[left]] >= similarity * size[place[left + d]] - 1e-9)]
        if not len(left):
            return
        cross = (t[left] & q[left + d]) | (q[left] & t[left + d])
        a, b = place[left[cross]], place[left[cross] + d]
        near = could(a, b)
        yield a[near], b[near]


def _dealt(held: DataFrame, total: int, a_group: int) -> tuple[DataFrame, Column]:
    """``held`` (node, shard, pieces, ...) by work item: item (i, j), i <= j, has the pieces i and j of a shard; and the items' group."""
    piece = F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int")
    own = held.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        *[c for c in held.columns if c != "pieces"], F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"),
        (F.col("piece") <= F.col("other")).alias("in_tree"), (F.col("piece") >= F.col("other")).alias("in_query"),
    )
    return own, F.pmod(F.xxhash64("shard", "i", "j"), F.lit(max(1, -(-total // a_group)))).alias("g")


def _item(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Distinct nodes, a row of each, each row's place among the nodes, the columns, and each row's shard in its work item."""
    col = {c: rows.column(c).to_numpy() for c in ("node", "shard", "i", "j", "in_tree", "in_query")}
    side = int(col["j"].max()) + 1
    shard = (np.unique(col["shard"], return_inverse=True)[1] * side + col["i"]) * side + col["j"]
    both, at, place = np.unique(col["node"], return_index=True, return_inverse=True)
    return both, at, place, col, shard


def _stars(both: np.ndarray, root: np.ndarray) -> pa.Table:
    some = np.flatnonzero(root != np.arange(len(both)))
    return pa.table({"u": both[some], "v": both[root[some]]})


def loose_links(distinct: DataFrame, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, tree: int = TREE) -> DataFrame:
    """Stars (u, v) over nodes (node, n, print, sketch, bands): linked if a shard's BK-trees find their fingerprints
    within the radius and their sketches show LOOSE."""
    cells = distinct.select("node", F.explode("bands").alias("shard"))
    sizes = stored(cells.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("pieces", F.ceil(F.col("n") / tree).cast("int")), "simhash-shards")
    total = sizes.agg(F.sum(F.col("n") * F.col("pieces"))).first()[0] or 0
    # Sketches travel once by node, and then only those of nodes that share a shard with another.
    shared = cells.join(sizes.select("shard", "pieces"), "shard").groupBy("node").agg(F.collect_list(F.struct("shard", "pieces")).alias("shards"))
    held = shared.join(distinct.select("node", "n", "print", "sketch"), "node").select("node", "n", "print", "sketch", F.explode("shards").alias("s")).select("node", "n", "print", "sketch", "s.*")
    own, group = _dealt(held, total, GROUP_ROWS)

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        both, at, place, col, shard = _item(rows)
        sketch = np.frombuffer(b"".join(rows.column("sketch").take(pa.array(at)).to_pylist()), np.uint64).reshape(len(both), SKETCH)
        could = _bounds(rows.column("n").to_numpy()[at], sketch, similarity)
        pairs = tree_pairs(place, rows.column("print").to_numpy()[at].view(np.uint64), shard, col["in_tree"], col["in_query"], radius)

        def holds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            true = could(a, b)
            true[true] = similar(sketch[a[true]], sketch[b[true]], LOOSE)
            return true

        return _stars(both, _roots(len(both), pairs, holds))

    return own.groupBy(group).applyInArrow(run, "u long, v long")


def exact_links(docs: DataFrame, distinct: DataFrame, groups: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, tree: int = TREE) -> DataFrame:
    """Stars (u, v) over the nodes of loose ``groups`` (node, root): connected as all pairs in a group are whose whole
    shingle sets have the similarity. The sets are made again from the texts, once for a node."""
    mine = distinct.join(groups, "node").select("node", F.col("root").alias("shard"), "n", "a", "b")
    cost = F.greatest(F.count("*") / tree, F.sum("n") * 8 / PIECE_BYTES)
    sizes = stored(mine.groupBy("shard").agg(F.sum("n").alias("hashes"), F.ceil(cost).cast("int").alias("pieces")), "simhash-groups")
    total = sizes.agg(F.sum(F.col("hashes") * 8 * F.col("pieces"))).first()[0] or 0
    chosen = mine.join(sizes.select("shard", "pieces"), "shard").select("node", "shard", "pieces", "a", "b")
    held = _keyed(docs).join(chosen, ["a", "b"]).select("node", "shard", "pieces", "text").dropDuplicates(["node"])
    own, group = _dealt(held, total, 2 * PIECE_BYTES)

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        both, at, place, col, shard = _item(rows)
        text = rows.column("text").take(pa.array(at)).combine_chunks()
        hashes, off = shingle_hashes(flat.texts(text), words)
        sketch, sets = sketches(hashes, off)[0], Sets(*shingle_sets(hashes, off))
        pairs = _met(place, sets.size, sketch, shard, col["in_tree"], col["in_query"], similarity)

        def holds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            true = similar(sketch[a], sketch[b], LOOSE)
            true[true] = sets.similar(a[true], b[true], similarity)
            return true

        return _stars(both, _roots(len(both), pairs, holds))

    return own.groupBy(group).applyInArrow(run, "u long, v long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's hash of 128 bits as ``a`` and ``b``."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def _near(docs: DataFrame, low: Column, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, a, b, fp of every row, and what :func:`_rooted` gives for links between texts of at least that similarity.

    Texts with equal shingle sets are one node, and ``fp`` is the set's number. Each node has a fingerprint (``print``) of
    its distinct shingles, as the similarity is of those. Blocks of its bits make no shards at this similarity; minima of
    the shingle hashes do. A shard's BK-trees find the pairs within NEAR_RADIUS, which are compared on their texts'
    smallest shingle hashes, loosely; whole shingle sets then decide every pair of the groups that this makes.
    """
    fields = [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("print", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    keep = ["doc_id", "a", "b"]
    keyed = _keyed(docs)
    schema = T.StructType([*(keyed.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.slices(batch):
                hashes, off = shingle_hashes(flat.texts(piece.column("text")), words)
                least, keys = sketches(hashes, off)
                h, at = shingle_sets(hashes, off)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                bands = pc.if_else(pa.array(np.diff(at) == 0), pa.scalar([], bands.type), bands)
                made = [pa.array(set_ids(h, at).view(np.int64)), pa.array(np.diff(at)), pa.array(majority(h, at).view(np.int64)), pa.array([row.tobytes() for row in least], pa.binary()), bands]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + made, schema.names)

    made = stored(map_texts(keyed, run, schema), "simhash-sketches")
    with scratch(docs.sparkSession) as put:
        one = F.min_by(F.struct("n", "print", "sketch", "bands", "a", "b"), F.struct("a", "b")).alias("s")
        distinct = put(made.groupBy(F.col("fp").alias("node")).agg(one).select("node", "s.*"), "simhash-distinct-sketches")
        groups = components(loose_links(distinct, similarity))
        return made, *_rooted(made, low, lambda _: exact_links(docs, distinct, groups, words, similarity))


def near_clusters(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, fp, component_id for every row: components of links between texts of at least that similarity."""
    made, rooted, least = _near(docs, F.col("doc_id"), words, similarity)
    return _with_component(made.select("doc_id", "fp"), rooted, least)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of one row of each component, that with the smallest id, and of its texts the one with the smallest
    hash; rows without an id stay as they are."""
    low = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "a", "b"))
    *_, least = _near(docs, low, words, similarity)
    names = [unique_name(docs, n) for n in ("kept_id", "kept_a", "kept_b")]
    kept = least.where(F.col("low").isNotNull()).select(*[F.col(f"low.{c}").alias(n) for c, n in zip(("doc_id", "a", "b"), names, strict=True)])
    one = docs.join(kept, [F.col("doc_id") == F.col(names[0]), F.xxhash64("text") == F.col(names[1]), F.xxhash64(F.lit(1), "text") == F.col(names[2])])
    return one.dropDuplicates(names).select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def hex_digits(fp: str) -> Column:
    """Sixteen lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
