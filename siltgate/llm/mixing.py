"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier over hashed words, counted on a bounded labelled sample, gives every document a posterior
over domains. Each document gets a nonnegative rate such that the expected tokens of every domain,
``sum(rate * tokens * posterior)``, match the target: least squares over relative domain errors, solved by projected
gradient steps. A step needs only the domain totals under the current rates (one row for the driver); a
document's rate is a fold over the totals of all steps so far, so that no state but those few numbers is carried
from step to step, and a lost executor costs a task.

With tokens as the metric, the gradient of a document is ``sum(posterior * error)``, in which the curvature of every
domain is at most 1: steps of size 1 never diverge, and with sharp posteriors a few suffice.

Rates become copies by rounding with the document's hash: floor(rate), and one more with the probability of the
rest. With the default targets no rate is below 1, so no document is lost and scarce domains repeat.

The fit tells what it reached: :class:`Fit` has the goal and the reached totals. A fit that does not settle, or misses
its goal by more than CLOSE where nothing keeps rates up, warns; with a ``tolerance`` a larger miss stops the job.

Defined results: null and empty texts have no tokens, the prior as posterior and rate 1; very long texts are read
whole; rows without a domain label are not learned from; without labelled rows everything is one domain and all rates
are 1; of the labelled domains the DOMAINS - 1 largest (ties by name) have their own name and all others are one,
REST; repeated rows are rated alike; a target for an unknown domain is an error; a domain without tokens is left out
of the fit; an empty table gives an empty result; extra columns pass through :func:`mixed`.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgate.llm.common import drop_stored, stored, unique_name

#: Labelled documents that the classifier is counted on, about: those with the smallest hashes of their ids, by domain
#: in proportion, but EACH of a domain that has so many.
FIT_ROWS, EACH = 4_000, 50
#: Buckets that words are hashed to, and domains, at most; the name of what is beyond them.
BUCKETS, DOMAINS, REST = 2_048, 64, "(other)"
SPACE = r"[\x20\x09-\x0D]+"
STEPS, CLOSE = 40, 1e-4
#: Share of the posterior that is the same for all domains: a text of many words is not taken for certain.
DOUBT = 1e-6


def words(text: Column) -> Column:
    """The words of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Membership:
    """Domains, log priors, and for each domain the log odds of every bucket against the buckets' mean."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def posterior(self, buckets: Column) -> Column:
        """Array of probabilities in the order of ``domains``, from the array of a text's buckets."""
        if len(self.domains) == 1:
            return F.array(F.lit(1.0))
        # One literal per domain, folded once by the optimiser; a text is scored by lookups in it.
        def log_odds(prior: float, w: tuple[float, ...]) -> Column:
            table = F.from_json(F.lit(json.dumps(w)), "array<double>")
            return F.aggregate(buckets, F.lit(prior), lambda s, b: s + F.get(table, b))

        return F.array(*map(log_odds, self.priors, self.weights))


def sharpened(logs: Column) -> Column:
    """Probabilities from log odds, with DOUBT spread over all domains."""
    top = F.array_max(logs)
    up = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(up, F.lit(0.0), lambda s, x: s + x)
    return F.transform(up, lambda x: x / total * (1 - DOUBT) + DOUBT / F.size(logs))


def train(docs: DataFrame, labels: DataFrame, domain: str = "lang", rows: int = FIT_ROWS) -> Membership:
    """Counts words by domain over the labelled sample; the driver gets one number per domain and bucket."""
    known = labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    named = docs.where(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"))
    # Ids and domains only: the texts of the sample are read once it is known.
    found = stored(named.join(known, "doc_id").distinct(), "mixing-labelled")
    many = [(r["domain"], r["n"]) for r in found.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(DOMAINS).collect()]
    if not many:
        drop_stored(found)
        return Membership(("all",), (0.0,), ((0.0,) * BUCKETS,))
    total = found.count()
    own = dict(many if len(many) < DOMAINS else many[: DOMAINS - 1])
    if len(own) < len(many):
        own[REST] = total - sum(own.values())
    share = {d: min(1.0, max(rows / total, EACH / n)) for d, n in own.items()}
    at = F.from_json(F.lit(json.dumps({d: share[d] for d in own})), "map<string,double>")
    label = F.when(F.col("domain").isin(*own), F.col("domain")).otherwise(F.lit(REST))
    # A number in [0, 1) that only the document decides.
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    chosen = found.select("doc_id", label.alias("domain")).where(place < F.try_element_at(at, F.col("domain"))).distinct()
    fit = docs.select("doc_id", F.col(domain).cast("string").alias("said"), "text").join(F.broadcast(chosen), "doc_id")
    fit = fit.where((F.col("said") == F.col("domain")) | ((F.col("domain") == REST) & F.col("said").isNotNull() & ~F.col("said").isin(*own)))
    words_of = fit.select("domain", F.explode(words(F.col("text"))).alias("w"))
    table = {d: [0.5] * BUCKETS for d in own}
    for r in words_of.groupBy("domain", bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect():
        table[r["domain"]][r["b"]] += r["n"]
    drop_stored(found)
    logs = {d: [math.log(n / sum(t)) for n in t] for d, t in table.items()}
    mean = [sum(logs[d][b] for d in logs) / len(logs) for b in range(BUCKETS)]
    return Membership(
        tuple(own),
        tuple(math.log(n / total) for n in own.values()),
        tuple(tuple(round(logs[d][b] - mean[b], 4) for b in range(BUCKETS)) for d in own),
    )


def membership(docs: DataFrame, model: Membership, names: tuple[str, str]) -> DataFrame:
    """``docs`` with its tokens (words) and posterior under the given names."""
    tokens, posterior = names
    at = unique_name(docs, "buckets")
    first = docs.withColumn(at, F.transform(words(F.col("text")), bucket))
    logs = first.withColumn(posterior, model.posterior(F.col(at))).withColumn(tokens, F.size(at).cast("long"))
    kept = logs.drop(at)
    return kept.withColumn(posterior, sharpened(F.col(posterior))) if len(model.domains) > 1 else kept


def _rate(posterior: Column, history: list[list[float]], least: float = 0.0) -> Column:
    """The rate after the steps so far: from 1, each step takes off the posterior-weighted errors, never below ``least``."""
    if not history:
        return F.lit(1.0)
    steps = F.from_json(F.lit(json.dumps(history)), "array<array<double>>")
    dot = lambda e: F.aggregate(F.zip_with(posterior, e, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(steps, F.lit(1.0), lambda r, e: F.greatest(F.lit(least), r - dot(e)))


def default_targets(base: dict[str, float], power: float = 0.85) -> dict[str, float]:
    """Target tokens: shares raised to ``power``, scaled so that no domain gets fewer tokens than it has."""
    some = {d: n for d, n in base.items() if n > 0}
    raised = {d: n**power for d, n in some.items()}
    scale = max((some[d] / raised[d] for d in some), default=1.0)
    return {d: r * scale for d, r in raised.items()}


@dataclass(frozen=True)
class Fit:
    """The rate as a column, the errors of each step, and by domain the tokens wanted and reached."""

    rate: Column
    history: list[list[float]]
    domains: tuple[str, ...]
    goal: list[float]
    reached: list[float]
    settled: bool

    @property
    def miss(self) -> float:
        """The largest gap between a domain's goal and what was reached, as a share of the whole goal."""
        return max((abs(a - b) for a, b in zip(self.goal, self.reached, strict=True)), default=0.0) / (sum(self.goal) or 1.0)


def solve(scored: DataFrame, domains: tuple[str, ...], names: tuple[str, str], targets: dict[str, float] | None = None, weights: dict[str, float] | None = None, steps: int = STEPS, tolerance: float | None = None) -> Fit:
    """The fit over ``scored``.

    ``targets`` are tokens by domain, ``weights`` shares of the present total; with neither, the default applies, and
    no rate is below 1.
    """
    unknown = sorted(set(targets or weights or ()) - set(domains))
    if unknown:
        raise ValueError(f"no labelled document has the domain {', '.join(map(repr, unknown))}")
    tokens, posterior = names
    slim = scored.select(F.col(tokens).cast("double").alias("n"), F.col(posterior).alias("p"))
    least = 0.0 if targets or weights else 1.0

    def totals(history: list[list[float]]) -> list[float]:
        rated = slim.withColumn("m", F.col("n") * _rate(F.col("p"), history, least))
        row = rated.agg(*[F.sum(F.col("m") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(len(domains))]).first()
        return [float(x or 0.0) for x in row]

    base = totals([])
    by = dict(zip(domains, base, strict=True))
    if weights:
        share = sum(weights.get(d, 0.0) for d in domains) or 1.0
        targets = {d: sum(base) * weights.get(d, 0.0) / share for d in domains}
    wanted = targets or default_targets(by)
    goal = [wanted.get(d, n) for d, n in by.items()]
    history: list[list[float]] = []
    now, before, settled = base, None, False
    for _ in range(steps + 1):
        error = [(x - g) / b if b > 0 else 0.0 for x, g, b in zip(now, goal, base, strict=True)]
        # Done if the goal is met, or if a step changes nothing any more: then bounded rates keep it from being met.
        settled = max(map(abs, error), default=0.0) < CLOSE or before is not None and all(abs(x - y) <= CLOSE / 10 * b for x, y, b in zip(now, before, base, strict=True))
        if settled or len(history) == steps:
            break
        history.append(error)
        before, now = now, totals(history)
    out = Fit(_rate(F.col(posterior), history, least), history, domains, goal, now, settled)
    if tolerance is not None and out.miss > tolerance:
        raise ValueError(f"the mix misses its targets by {out.miss:.4f} of all tokens, more than {tolerance}")
    if not settled or (not least and out.miss > CLOSE):
        logging.getLogger(__name__).warning("the mix misses its targets by %.4f of all tokens after %d steps", out.miss, len(history))
    return out


def rated(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, weights: dict[str, float] | None = None, carry: list[str] | None = None, tolerance: float | None = None) -> tuple[DataFrame, dict[str, str], Fit]:
    """The columns ``carry`` of ``docs`` (all, if not given) with tokens, posterior, rate and copies, the names that these
    have, and the fit.

    What is carried is stored with the posteriors, so that texts are classified once; without the text that is little.
    """
    model = train(docs, labels, domain)
    names = {n: unique_name(docs, n) for n in ("n_tokens", "posterior", "rate", "copies")}
    pair = (names["n_tokens"], names["posterior"])
    carry = docs.columns if carry is None else carry
    scored = stored(membership(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])), model, pair).select(*dict.fromkeys([*carry, "doc_id"]), *pair), "mixing")
    fit = solve(scored, model.domains, pair, targets, weights, tolerance=tolerance)
    out = scored.withColumn(names["rate"], F.when(F.col(pair[0]) == 0, F.lit(1.0)).otherwise(F.round(fit.rate, 3)))
    # A uniform number in [0, 1) that only the document decides.
    luck = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn(names["copies"], F.floor(F.col(names["rate"]) + luck).cast("long")), names, fit


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The columns of ``docs``, each row as many times as it has copies."""
    out, names, _ = rated(docs, labels, domain, targets, weights)
    many = F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))
    copy = unique_name(out, "copy")
    return out.where(F.col(names["copies"]) > 0).withColumn(copy, many).select(*docs.columns)
