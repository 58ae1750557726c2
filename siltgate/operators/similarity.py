"""Similarity to registered texts: exact cosine, top k, and hits over a threshold. Vectors come from outside.

One side is broadcast in blocks of at most CORPUS_ROWS rows and BLOCK_BYTES; the other side streams past it. Scores are
computed a tile at a time and only each tile's best are kept, so a task holds a tile and k candidates for each query.
Where every row is a query nothing is broadcast: a task holds a block of the rows, and all rows are shuffled past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgate.schema import HITS, empty, hit

CORPUS_ROWS, BLOCK_BYTES = 50_000, 64 << 20
#: Queries and rows of a tile of scores.
TILE = (512, 2_048)
#: How far a matrix product's scores, whose last bits depend on the tile's shape, may be from those that rank; and pairs
#: that are scored at a time.
SLACK, SCORED = 1e-9, 1 << 14
#: Queries of a task at least, where every row is a query and there are more rows than this.
LEAST_ROWS = 1_024
MATCHES = "array<struct<doc_id:string,chunk_id:string,score:double>>"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return _unit(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1)))


def _scores(q: np.ndarray, base: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Scores of some pairs, summed in the vectors' order: copies tie in whatever tiles and tasks they are."""
    out = np.empty(len(row))
    for x in range(0, len(row), SCORED):
        out[x : x + SCORED] = np.cumsum(q[row[x : x + SCORED]] * base[col[x : x + SCORED]], axis=1)[:, -1:].sum(axis=1)
    return out


def nearest(asked: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows, best first; of equal scores (to twelve digits) the first rows."""
    parts = []
    for a in range(0, len(asked), TILE[0]):
        q = asked[a : a + TILE[0]]
        row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(base), TILE[1]):
            sims = q @ base[b : b + TILE[1]].T
            most = min(k, sims.shape[1])
            least = np.partition(sims, sims.shape[1] - most, axis=1)[:, sims.shape[1] - most]
            r, c = np.nonzero(sims >= least[:, None] - SLACK)
            row, col, score = np.concatenate([row, r]), np.concatenate([col, b + c]), np.concatenate([score, _scores(q, base, r, b + c)])
            by = np.lexsort((col, -np.round(score, 12), row))
            row, col, score = row[by], col[by], score[by]
            kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            row, col, score = row[kept], col[kept], score[kept]
        parts.append((a + row, col, score))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of a matrix, by its bytes, and which of these a row is."""
    rows = np.ascontiguousarray(x)
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, group.ravel()


class Best:
    """The k best rows of each query, best first, among all rows given so far; of equal scores (to twelve digits) those given first.

    Copies among the queries are asked once; of copies in a tile the first k are scored, since no later one can be among the best.
    """

    def __init__(self, asked: np.ndarray, k: int) -> None:
        first, self.copy_of = _copies(asked)
        self.asked, self.k = asked[first], k
        self.single = self.asked.astype(np.float32)
        self.ranked, self.score = np.full((len(first), k), -np.inf), np.zeros((len(first), k))
        self.ids: np.ndarray | None = None

    def add(self, base: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.empty(self.ranked.shape, ids.dtype)
        _, group = _copies(base)
        by = np.argsort(group, kind="stable")
        few = np.sort(by[np.arange(len(by)) - np.searchsorted(group[by], group[by], "left") < self.k])
        base, ids = base[few], ids[few]
        # Padded to whole words of the mask, with scores that no query reaches.
        wide = -len(base) % 8 + len(base)
        turned = np.zeros((base.shape[1], wide), np.float32)
        turned[:, : len(base)] = base.T
        # Twice what single precision can be off by in a product of unit vectors.
        slack = (base.shape[1] + 8) * 2.0**-23
        most = min(self.k, len(base))
        for a in range(0, len(self.asked), TILE[0]):
            sims = self.single[a : a + TILE[0]] @ turned
            sims[:, len(base) :] = -np.inf
            known = self.ranked[a : a + TILE[0], -1]
            least = known.copy()
            if len(new := np.flatnonzero(np.isinf(known))):
                least[new] = np.partition(sims[new], wide - most, axis=1)[:, wide - most]
            found = (sims >= (least - slack).astype(np.float32)[:, None]).ravel()
            words = np.flatnonzero(found.view(np.uint64))
            at = (words[:, None] * 8 + np.arange(8)).ravel()
            row, col = np.divmod(at[found[at]], wide)
            score = _scores(self.asked[a : a + TILE[0]], base, row, col)
            better = np.round(score, 12) > known[row]
            self._merge(a + row[better], score[better], ids[col[better]])

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        own = np.unique(row)
        row = np.concatenate([np.repeat(own, self.k), row])
        ranked = np.concatenate([self.ranked[own].ravel(), np.round(score, 12)])
        score, ids = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.ids[own].ravel(), ids])
        by = np.lexsort((-ranked, row))  # stable: rows given earlier stay before
        row = row[by]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        by, row, place = by[place < self.k], row[place < self.k], place[place < self.k]
        self.ranked[row, place], self.score[row, place], self.ids[row, place] = ranked[by], score[by], ids[by]

    def of(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) for some of the queries."""
        own = self.copy_of[start:end]
        row, place = np.nonzero(np.isfinite(self.ranked[own]))
        return start + row, self.ids[own[row], place], self.score[own[row], place]


def _blocks(rows: DataFrame, vector: int) -> Iterator[list]:
    """Rows of a frame on the driver, a block at a time."""
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append(row)
        held += 8 * len(row[vector])
        if len(block) == CORPUS_ROWS or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _ranked(parts: list[DataFrame], empty_of: DataFrame, schema: T.StructType, k: int, query_id: str, *ties: str) -> DataFrame:
    if not parts:
        return empty_of.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = Window.partitionBy(query_id).orderBy(F.round("score", 12).desc(), *ties)
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, doc_id, chunk_id, score, rank: the k best registered rows of every query, ties by document and chunk.

    Rows without a vector have no matches. Scores are full doubles; :func:`matches` rounds them.
    """
    known = corpus.where(F.col(vector).isNotNull()).select("doc_id", "chunk_id", vector).orderBy("doc_id", "chunk_id")
    schema = T.StructType([queries.schema[query_id], corpus.schema["doc_id"], corpus.schema["chunk_id"], T.StructField("score", T.DoubleType())])

    def compared(rows: list) -> DataFrame:
        names = [pa.array([r[i] for r in rows], type=_arrow(schema[i + 1])) for i in (0, 1)]
        shared = queries.sparkSession.sparkContext.broadcast((_unit(np.array([r[2] for r in rows], np.float64)), names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, ids = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, TILE[0]):
                    part = batch.slice(at, TILE[0])
                    row, col, score = nearest(_matrix(part.column(vector)), base, k)
                    yield pa.RecordBatch.from_arrays([part.column(query_id).take(pa.array(row)), *(n.take(pa.array(col)) for n in ids), pa.array(score)], [f.name for f in schema])

        return queries.where(F.col(vector).isNotNull()).select(query_id, vector).mapInArrow(run, schema)

    return _ranked([compared(rows) for rows in _blocks(known, 2)], queries, schema, k, query_id, "doc_id", "chunk_id")


def top_k_of_all(queries: DataFrame, rows: DataFrame, k: int = 5, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank: for a stated, bounded set of queries the k best of all rows, ties by doc_id.

    Here the queries travel. A task keeps each query's k best of the rows that it has seen and gives them once, at its end.
    """
    schema = T.StructType([queries.schema[query_id], rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def compared(some: list) -> DataFrame:
        names = pa.array([r[0] for r in some], type=_arrow(schema[0]))
        shared = rows.sparkSession.sparkContext.broadcast((_unit(np.array([r[1] for r in some], np.float64)), names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, ids = shared.value
            best = None
            for batch in batches:
                part = batch.take(pa.compute.sort_indices(batch.column("doc_id")))
                row, col, score = nearest(asked, _matrix(part.column(vector)), k)
                new = pa.table({"q": row, "doc": part.column("doc_id").take(pa.array(col)), "score": score, "order": -np.round(score, 12)})
                both = new if best is None else pa.concat_tables([best, new])
                both = both.take(pa.compute.sort_indices(both, [("q", "ascending"), ("order", "ascending"), ("doc", "ascending")])).combine_chunks()
                q = both.column("q").to_numpy()
                best = both.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q, "left") < k))
            if best is not None and len(best):
                best = best.combine_chunks()
                made = [names_of(ids, best.column("q")), best.column("doc").combine_chunks(), best.column("score").combine_chunks()]
                yield from pa.table(dict(zip([f.name for f in schema], made, strict=True))).to_batches(max_chunksize=10_000)

        return rows.where(F.col(vector).isNotNull()).select("doc_id", vector).mapInArrow(run, schema)

    known = queries.where(F.col(vector).isNotNull()).select(query_id, vector).orderBy(query_id)
    return _ranked([compared(some) for some in _blocks(known, 1)], queries, schema, k, query_id, "doc_id")


def top_k_of_each(rows: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank: for every row the k best of all rows, itself among them, ties by doc_id.

    Rows are dealt to blocks by their content; a task holds a block of at most about CORPUS_ROWS rows and BLOCK_BYTES as
    queries, and all rows stream past it in the order of doc_id. So the rows are shuffled once for every block, and every
    pair of them is scored: work grows with the square of the rows.
    """
    known = rows.where(F.col(vector).isNotNull()).select("doc_id", vector)
    schema = T.StructType([T.StructField("query_id", known.schema["doc_id"].dataType), known.schema["doc_id"], T.StructField("score", T.DoubleType())])
    n, size = known.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    held = max(1, min(CORPUS_ROWS, BLOCK_BYTES // (8 * max(size, 1))))
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    # No more blocks than rows are worth, else as many as tasks run at a time, or a multiple where blocks would be too large.
    blocks = max(min(tasks, -(-n // LEAST_ROWS)), -(-n // held)) or 1
    blocks = -(-blocks // tasks) * tasks if blocks > tasks else blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, best = [], [], None
        for batch in batches:
            asks = pa.compute.sum(batch.column("asks")).as_py() or 0
            if asks:
                names.append(batch.column("doc_id").slice(0, asks))
                vectors.append(_matrix(batch.column(vector).slice(0, asks)))
            if asks == batch.num_rows or not names:
                continue
            if best is None:
                best, vectors = Best(np.concatenate(vectors), k), []
            for at in range(asks, batch.num_rows, TILE[1]):
                part = batch.slice(at, TILE[1])
                best.add(_matrix(part.column(vector)), part.column("doc_id").to_numpy(zero_copy_only=False))
        if best is not None:
            ids = pa.concat_arrays(names)
            for at in range(0, len(ids), TILE[1]):
                row, doc, score = best.of(at, at + TILE[1])
                made = [ids.take(pa.array(row)), pa.array(doc, type=_arrow(schema[1])), pa.array(score)]
                yield pa.RecordBatch.from_arrays(made, [f.name for f in schema])

    asking = known.select(F.pmod(F.xxhash64("doc_id", vector), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("asks"), "doc_id", vector)
    asked = known.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asks"), "doc_id", vector)
    dealt = asking.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions(F.desc("asks"), "doc_id")
    return _ranked([dealt.select("asks", "doc_id", vector).mapInArrow(run, schema)], rows, schema, k, "query_id", "doc_id")


def names_of(ids: pa.Array, number: pa.ChunkedArray) -> pa.Array:
    return ids.take(number.combine_chunks())


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def matches(best: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, similar: the matches of a query in order, scores rounded to four digits."""
    each = F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.round("score", 4).alias("score"))
    ordered = F.transform(F.sort_array(F.collect_list(each)), lambda m: F.struct(m["doc_id"].alias("doc_id"), m["chunk_id"].alias("chunk_id"), m["score"].alias("score")))
    return best.groupBy(query_id).agg(ordered.cast(MATCHES).alias("similar"))


def best_score(similar: Column) -> Column:
    """The largest similarity; zero without matches."""
    return F.coalesce(F.array_max(F.transform(similar, lambda m: m["score"])), F.lit(0.0))


def two_digits(x: Column) -> Column:
    """A double with two decimals, rounded by its exact binary value (halves to even), as C and Python print it.

    ``format_string`` rounds the shortest decimal form instead: 0.345, which is a little less than that, becomes 0.35.
    """
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    mask, half = F.lit((1 << 31) - 1), F.lit(1 << 30)

    def hundredths(n: Column) -> Column:
        """Of n / 2**62, in two halves of 31 bits each."""
        low = n.bitwiseAND(mask) * 100
        high = F.shiftright(n, 31) * 100 + F.shiftright(low, 31)
        down, rest, more = F.shiftright(high, 31), high.bitwiseAND(mask), low.bitwiseAND(mask) > 0
        return down + F.when((rest > half) | ((rest == half) & (more | (down % 2 == 1))), F.lit(1)).otherwise(F.lit(0))

    def made(v: Column) -> Column:
        # Both parts are exact: below 2**-10, where the cast drops digits, there are no hundredths.
        part = bind(((F.abs(v) - F.floor(F.abs(v))) * float(1 << 62)).cast("long"), hundredths)
        text = bind(F.floor(F.abs(v)) * 100 + part, lambda c: F.format_string("%s%d.%02d", F.when(v < 0, "-").otherwise(""), F.floor(c / 100), c % 100))
        return F.when(F.abs(v) < float(1 << 40), text).otherwise(F.format_string("%.2f", v))

    return bind(x, made)


def similarity_hits(similar: Column, threshold: float, action: str, path: Column) -> Column:
    """One hit from the best match, if it reaches the threshold; a label in place of text, and no place."""
    score = best_score(similar)
    best = F.element_at(F.filter(similar, lambda m: m["score"] == score), 1)
    made = hit(
        "L3.7", F.concat(F.lit("rag:"), best["doc_id"], F.lit("#"), best["chunk_id"]), "PROPRIETARY_SIMILARITY", F.lit(-1), F.lit(-1),
        F.format_string("sim=%s doc=%s", two_digits(score), best["doc_id"]), action, F.lit("normalized"), path, score,
    )
    return F.when((F.size(similar) > 0) & (score >= threshold), F.array(made).cast(HITS)).otherwise(empty(HITS))
