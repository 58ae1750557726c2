"""Quality classifier as a sparse rule ensemble.

Shallow boosted trees over text statistics are grown on a bounded labelled sample; every path from the root
to a node becomes one conjunctive rule; a lasso logistic regression keeps the rules that matter; what is left
is compiled into one Spark column expression. Scoring reads only the text.

Defined results: null and empty texts are scored like any text (all statistics zero); without labelled rows
the score is 0.5 everywhere; with one class only it is the class's smoothed rate; repeated rows each get
their own row, and of an id with several texts the smallest is learned from; very long texts are measured whole, in a
slice of their own; of equal gains the first feature and the lowest cut make a split, and rows with equal statistics
have equal scores; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgate.llm.text_stats import with_stats

#: Largest number of labelled rows that the driver fits on: those with the smallest hash of their id.
FIT_ROWS = 12_000


def _ratio(over: str, under: str) -> Column:
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def features() -> dict[str, Column]:
    """What rules may test, as expressions over the columns of ``with_stats``."""
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "pipes_per_word": _ratio("n_pipe", "n_words"),
        "bangs_per_word": _ratio("n_bang", "n_words"),
        "stops_per_word": _ratio("n_stop", "n_words"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "digit_share": _ratio("n_digits", "word_chars"),
        "distinct_share": _ratio("n_distinct_words", "n_words"),
        "top_word_share": _ratio("n_top_word", "n_words"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "stutter_share": _ratio("n_same_next", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_above, threshold) tests, and the weight it adds to the log odds."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), np.bool_)
        for name, above, cut in self.tests:
            v = x[:, names.index(name)]
            out &= v > cut if above else v <= cut
        return out

    def column(self) -> Column:
        parts = [F.col(n) > F.lit(c) if above else F.col(n) <= F.lit(c) for n, above, c in self.tests]
        both = parts[0]
        for p in parts[1:]:
            both = both & p
        return both


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1 over the columns of ``features()``."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 12) -> list[Rule]:
    """Paths of boosted regression trees on the logistic loss, as rules; splits lie midway between quantiles of a feature."""
    steps = [np.unique(np.quantile(x[:, j], np.linspace(0.005, 0.995, bins))) for j in range(x.shape[1])]
    cuts = [(v[:-1] + v[1:]) / 2 for v in steps]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (1e-6, -1, -1)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g**2 / (total_h + 1)
        for j, c in enumerate(cuts):
            size = len(c) + 1
            if size < 2:
                continue
            at = binned[rows, j]
            gl = np.cumsum(np.bincount(at, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(at, h[rows], size))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=size))[:-1]
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - base
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        return best

    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = y - p, p * (1 - p)
        open_nodes: list[tuple[np.ndarray, tuple]] = [(np.arange(len(y)), ())]
        for _ in range(depth):
            below = []
            for rows, path in open_nodes:
                _, j, k = split(rows, g, h)
                if j < 0:
                    margin[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                left = binned[rows, j] <= k
                for side, above in ((rows[left], False), (rows[~left], True)):
                    tests = (*path, (names[j], above, float(cuts[j][k])))
                    found.setdefault(frozenset(tests), Rule(tests))
                    below.append((side, tests))
            open_nodes = below
        for rows, _ in open_nodes:
            margin[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
    return list(found.values())


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 0.004, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean logistic loss plus ``penalty`` times the sum of |weights|."""
    n, m = r.shape
    one = np.hstack([np.ones((n, 1)), r])
    v = np.ones(m + 1)
    for _ in range(30):
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(np.linalg.norm(one @ v) ** 2, 1e-9) / 1.02
    w = np.zeros(m + 1)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        grad = one.T @ (_sigmoid(one @ z) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.004) -> RuleEnsemble:
    """The rule ensemble for feature rows ``x`` and labels ``y`` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    rules = grow(x, y.astype(float), names)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    r = np.stack([k.holds(x, names) for k in rules], axis=1).astype(float)
    b, w = lasso_logistic(r, y.astype(float), penalty)
    return RuleEnsemble(b, tuple(Rule(k.tests, float(c)) for k, c in zip(rules, w, strict=True) if abs(c) > 1e-9))


def held_out(id_column: str = "doc_id") -> Column:
    """True for rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int = FIT_ROWS, id_column: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids that are not held out, those with the smallest hash; one row per id."""
    some = labels.where(~held_out(id_column) & F.col(id_column).isNotNull() & F.col(label).isin(0, 1))
    one = some.groupBy(F.col(id_column)).agg(F.max(F.col(label)).cast("int").alias("label"))
    return one.orderBy(F.xxhash64(id_column), F.col(id_column)).limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> RuleEnsemble:
    """Fits on the bounded labelled sample; the statistics are computed on the executors, whole texts each."""
    chosen = labelled_sample(labels, label, rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    f = features()
    # Labels join again after the statistics: the statistics pass reads ids and texts only.
    got = with_stats(known.select("doc_id", "text")).select("doc_id", *[c.alias(n) for n, c in f.items()]).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    x = np.array([[r[n] for n in f] for r in got], float).reshape(len(got), len(f))
    y = np.array([r["label"] for r in got], int)
    return fit(x, y, list(f))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    f = features()
    rated = with_stats(docs).select("doc_id", *[c.alias(n) for n, c in f.items()])
    return rated.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
