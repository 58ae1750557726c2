"""Line dedup: lines that many documents share go from all of them.

Lines are exploded and normalised to keys (white space stripped at both ends, A-Z lower-cased), keys are hashed
to 128 bits, distinct documents are counted per hash, lines whose key is in at least ``min_docs`` documents are
dropped, and the rest is put together again by position.

Counting moves hashes and positions only; texts move once, to meet their document's dropped positions. A line in a
third of all documents is one row per document and partition after the first combining, counted in two steps, and its
join is by broadcast when the counted shared keys are within ``BROADCAST_ROWS``, else salted.

Defined results: null and empty texts are one empty line; very long texts are split whole; keys shorter than
``min_chars`` code points are never dropped; a key in exactly ``min_docs`` documents is; repeated rows with one id count
as one document and each get a row; rows with a null id count as one document together; an empty table gives an empty
result; extra columns are not read by :func:`drop_shared_lines` and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgate.llm.common import stored

#: White space that is stripped; newline cannot occur inside a line.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shared keys (24 bytes each) that are broadcast, at most.
BROADCAST_ROWS = 200_000
SALT = 64


def key(line: Column) -> Column:
    """The normalised line."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, t (the text's hash), pos, a, b (the key's hash) of every line with a key of at least ``min_chars``."""
    each = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keyed = each.select("doc_id", "t", "pos", key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select("doc_id", "t", "pos", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(7), F.col("k")).alias("b"))


def shared_keys(hashes: DataFrame, min_docs: int) -> DataFrame:
    """a, b, n_docs of the keys in at least ``min_docs`` documents."""
    return hashes.select("doc_id", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept ``text`` for every row of ``docs``."""
    hashes = stored(line_hashes(docs, min_chars), "line-hashes")
    shared = stored(shared_keys(hashes, min_docs), "line-shared")
    if shared.count() <= BROADCAST_ROWS:
        hits = hashes.join(F.broadcast(shared), ["a", "b"])
    else:
        dealt = hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALT)))
        hits = dealt.join(shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["a", "b", "salt"])
    drops = hits.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("drop"))
    d, t = F.col("d.doc_id"), F.xxhash64(F.coalesce("d.text", F.lit("")))
    found = docs.select("doc_id", "text").alias("d").join(drops.alias("x"), d.eqNullSafe(F.col("x.doc_id")) & (t == F.col("x.t")), "left")
    split = found.select(d.alias("doc_id"), lines(F.col("d.text")).alias("ls"), F.coalesce("x.drop", F.array().cast("array<int>")).alias("drop"))
    kept = F.when(F.size("drop") == 0, F.col("ls")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "drop"), lambda i: F.get("ls", i)))
    return split.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
