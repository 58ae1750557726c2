"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the words of the text and the
probabilities that the earlier links gave. While training, those probabilities are out-of-fold, so that a
later link never learns from an earlier link's fit to its own rows. The last link is the labelled category.

The words that the models look at are the ``VOCABULARY`` with the largest chi-square against the label in a
bounded labelled sample (``FIT_ROWS`` of each class, by hash). The categories before the last come from the same
sample, in whatever languages it has: the words that speak for the label are grouped by the texts that they share
(``CATEGORIES`` groups), and a labelled text that has a word of a group is in its category. Whole texts are scored.

Defined results: null and empty texts have no words and get the intercepts' probabilities; very long texts are read
whole, in a slice of their own; words of equal weight are taken in the order of their letters; without labelled rows
of both classes every probability is 0 and nothing is toxic; where fewer words speak for the label than there are
categories, the others are empty and have the probability 0; repeated rows each get a row; an empty table gives an
empty result; further columns are not read by the scorer and are passed on by :func:`keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgate.llm import flat
from siltgate.llm.common import map_texts, scratch

#: Labelled rows of each class that the driver fits on, at most.
FIT_ROWS = 3_000
#: Words that the linear models may weigh, at most.
VOCABULARY = 1_024
#: Smallest chi-square with one degree of freedom: by chance one word in a hundred thousand exceeds it.
LEAST_CHI = 20.0
FOLDS = 4
#: Categories that the words which speak for the label are grouped to.
CATEGORIES = 3
TARGET = "toxic"


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights of the vocabulary, then of the earlier links' probabilities."""

    category: str
    intercept: float
    words: np.ndarray
    earlier: np.ndarray


@dataclass(frozen=True)
class Chain:
    """The models, and the words of the categories that come before the label."""

    vocabulary: tuple[str, ...]
    links: tuple[Link, ...]
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def categories(self) -> list[str]:
        return [k.category for k in self.links]

    def probabilities(self, n: int, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """One column per category for ``n`` texts; text ``doc[i]`` has the vocabulary's word ``word[i]``."""
        out = np.zeros((n, len(self.links)))
        for j, k in enumerate(self.links):
            z = k.intercept + np.bincount(doc, k.words[word], minlength=n) + out[:, :j] @ k.earlier
            out[:, j] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out


def distinct_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Pairs (text number, word) of the distinct words of each text."""
    word, off = flat.plain_words(column)
    ids, names = flat.codes(word)
    if not len(ids):
        return np.zeros(0, np.int64), word
    pair = np.unique(flat.owners(off) * len(names) + ids)
    return pair // len(names), names.take(pa.array(pair % len(names)))


@dataclass(frozen=True)
class Presence:
    """Which of ``n_words`` words ``n`` texts have, as pairs (doc, word)."""

    n: int
    n_words: int
    doc: np.ndarray
    word: np.ndarray

    def rows(self, keep: np.ndarray) -> Presence:
        """The texts in ``keep`` (a mask), numbered anew."""
        number = np.cumsum(keep) - 1
        some = keep[self.doc]
        return Presence(int(keep.sum()), self.n_words, number[self.doc[some]], self.word[some])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.word], minlength=self.n)

    def gathered(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, g[self.doc], minlength=self.n_words)


def _logistic(x: Presence, more: np.ndarray, y: np.ndarray, ridge: float = 3e-4, steps: int = 300) -> tuple[float, np.ndarray, np.ndarray]:
    """Ridge logistic regression on words and further columns by accelerated gradient descent; both classes weigh the same.

    Gives the intercept, the words' weights and the further columns' weights.
    """
    cut = 1 + x.n_words
    pos = y.mean()
    weight = np.where(y == 1, 0.5 / max(pos, 1e-9), 0.5 / max(1 - pos, 1e-9)) / x.n
    forward = lambda w: w[0] + x.times(w[1:cut]) + more @ w[cut:]
    back = lambda g: np.concatenate([[g.sum()], x.gathered(g), g @ more])
    v = np.ones(cut + more.shape[1])
    for _ in range(20):
        v = back(weight * forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(back(weight * forward(v))) / 4 * 1.05 + ridge)
    w, z, t = np.zeros(len(v)), np.zeros(len(v)), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(z), -35, 35)))
        grad = back(weight * (p - y)) + ridge * z
        grad[0] -= ridge * z[0]
        new = z - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:cut], w[cut:]


def fit_chain(vocabulary: list[str], x: Presence, y: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """The chain over the categories of ``y`` in order, from word presence ``x``."""
    links, before = [], np.zeros((x.n, 0))
    for category, label in y.items():
        if label.min() == label.max():
            links.append(Link(category, 35.0 if label.min() else -35.0, np.zeros(len(vocabulary)), np.zeros(len(links))))
            before = np.hstack([before, np.full((x.n, 1), float(label.min()))])
            continue
        out = np.zeros(x.n)
        for f in np.unique(folds):
            rest = folds != f
            if label[rest].min() == label[rest].max():
                out[~rest] = label[rest].mean()
                continue
            b, w, e = _logistic(x.rows(rest), before[rest], label[rest])
            out[~rest] = 1 / (1 + np.exp(-np.clip(b + x.rows(~rest).times(w) + before[~rest] @ e, -35, 35)))
        b, w, e = _logistic(x, before, label)
        links.append(Link(category, b, w, e))
        before = np.hstack([before, out[:, None]])
    return Chain(tuple(vocabulary), tuple(links))


def word_groups(strength: np.ndarray, x: Presence, n: int, rounds: int = 20) -> np.ndarray:
    """For each word its group (0 to n - 1), or -1 if its ``strength`` is not above 0.

    Words are directions over the texts of ``x`` that have them; groups grow around the strongest word and then, n - 1
    times, the word least like all chosen so far, and each word joins the most similar group's mean until none moves.
    """
    out, speak = np.full(x.n_words, -1), np.flatnonzero(strength > 0)
    if not len(speak):
        return out
    has = np.zeros((len(speak), x.n))
    at = np.full(x.n_words, -1)
    at[speak] = np.arange(len(speak))
    some = at[x.word] >= 0
    has[at[x.word[some]], x.doc[some]] = 1
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1e-12)
    chosen = [int(np.argmax(strength[speak]))]
    while len(chosen) < min(n, len(speak)):
        like = (has @ has[chosen].T).max(axis=1)
        like[chosen] = np.inf
        # Of the words least like the chosen ones, the strongest.
        least = np.flatnonzero(like <= like.min() + 1e-12)
        chosen.append(int(least[np.argmax(strength[speak][least])]))
    mean, own = has[chosen], None
    for _ in range(rounds):
        new = np.argmax(np.round(has @ mean.T, 12), axis=1)
        if own is not None and (new == own).all():
            break
        own = new
        mean = np.stack([has[own == g].sum(axis=0) if (own == g).any() else mean[g] for g in range(len(chosen))])
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    out[speak] = own
    return out


def train(docs: DataFrame, labels: DataFrame, target: str = TARGET, categories: int = CATEGORIES, rows: int = FIT_ROWS) -> Chain:
    """Fits the chain on at most ``rows`` labelled ids of each class, those with the smallest hash of their id."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    half = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), "text")
    schema = T.StructType([*(texts.schema[c] for c in ("doc_id", "label", "h")), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.slices(batch):
                doc, word = distinct_words(flat.texts(piece.column("text")))
                off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=piece.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), word.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "label", "h")), lists], schema.names)

    names = [f"category_{i + 1}" for i in range(categories)]
    with scratch(docs.sparkSession) as put:
        # Texts become words where they are read; only words are dealt out. Copies of one text would make its chance words
        # look significant: each distinct text counts once.
        first = F.min_by(F.struct("doc_id", "label", "words"), "doc_id").alias("r")
        sample = put(map_texts(texts, run, schema).groupBy("h").agg(first).select("r.*"), "toxicity-sample")
        sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            return Chain((), tuple(Link(c, -35.0, np.zeros(0), np.zeros(j)) for j, c in enumerate([*names, target])))
        pos, all_rows = sizes[1], sizes[0] + sizes[1]
        counted = sample.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
        gap = F.col("k") - F.col("n") * (pos / all_rows)
        chi = gap * gap / (F.col("n") * (pos / all_rows) * (1 - pos / all_rows))
        top = counted.where("n >= 3").where(chi >= LEAST_CHI).orderBy(chi.desc(), "word").limit(VOCABULARY)
        strength = {r["word"]: r["s"] for r in top.select("word", F.when(gap > 0, chi).otherwise(F.lit(0.0)).alias("s")).collect()}
        vocabulary = sorted(strength)
        got = sample.select("doc_id", "label", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).alias("fold"), F.array_intersect("words", F.lit(vocabulary).cast("array<string>")).alias("words")).orderBy("doc_id").collect()
    at = {w: j for j, w in enumerate(vocabulary)}
    pairs = np.array([(i, at[w]) for i, r in enumerate(got) for w in r["words"]], np.int64).reshape(-1, 2)
    x = Presence(len(got), len(vocabulary), pairs[:, 0], pairs[:, 1])
    label = np.array([r["label"] for r in got], float)
    group = word_groups(np.array([strength[w] for w in vocabulary]), x.rows(label > 0), categories)
    y = {c: label * (x.times((group == i).astype(float)) > 0) for i, c in enumerate(names)}
    chain = fit_chain(vocabulary, x, y | {target: label}, np.array([r["fold"] for r in got]))
    return replace(chain, groups={c: tuple(w for w, g in zip(vocabulary, group, strict=True) if g == i) for i, c in enumerate(names)})


def _added(docs: DataFrame, model: Chain, columns: list[str], keep: bool) -> DataFrame:
    """The given columns and one probability per category, whole texts; with ``keep`` only rows under the threshold."""
    names = [f"p_{c}" for c in model.categories]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(n, T.DoubleType()) for n in names])
    vocabulary, links = pa.array(model.vocabulary, pa.string()), model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.slices(batch):
                word, off = flat.plain_words(flat.texts(piece.column("text")))
                index = pc.fill_null(pc.index_in(word, vocabulary.cast(word.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = index >= 0
                pair = np.unique(flat.owners(off)[hit] * max(len(vocabulary), 1) + index[hit])
                p = links.probabilities(piece.num_rows, pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1))
                out = pa.RecordBatch.from_arrays([piece.column(c) for c in columns] + [pa.array(p[:, j]) for j in range(p.shape[1])], [*columns, *names])
                yield out.filter(pa.array(p[:, -1] < THRESHOLD)) if keep else out

    return map_texts(docs.select(*dict.fromkeys([*columns, "text"])), run, schema)


THRESHOLD = 0.5


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, a probability per category, and ``toxic`` for every row."""
    out = _added(docs, model, ["doc_id"], False)
    return out.withColumn("toxic", F.col(f"p_{model.categories[-1]}") >= THRESHOLD)


def keep_clean(docs: DataFrame, model: Chain) -> DataFrame:
    """All columns of the rows that the chain does not call toxic."""
    return _added(docs, model, docs.columns, True).select(*docs.columns)
