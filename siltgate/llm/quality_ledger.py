"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text; the ledger keeps the measurements and one bit per failed rule. A policy
is a versioned set of bits: applying it, or asking what a policy without one of its rules would keep, is
arithmetic on the stored mask and never looks at a text again.

Defined results: a null or empty text has no words and fails the length rule; very long texts are measured whole;
a count that equals its limit does not fail (rules compare integers, so there are no other ties); repeated rows each
have a ledger row; columns of the table other than id and text are not read; an empty table gives an empty ledger
and no ablations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgate.llm.text_stats import with_stats


@dataclass(frozen=True)
class QualityRule:
    """A bit of the mask; ``fails`` is true for texts that break the rule. Counts are compared as integers."""

    bit: int
    name: str
    fails: Column


#: The rules' names, by bit.
NAMES = ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "one_word_rules", "shouting", "stutter")


def rules() -> list[QualityRule]:
    """Bits are never reused: a changed rule gets a new bit, so that old ledgers keep their meaning."""
    c = F.col
    return [
        QualityRule(0, NAMES[0], c("n_words") < 20),
        QualityRule(1, NAMES[1], 100 * c("n_repeat_words") > 30 * c("n_words")),
        QualityRule(2, NAMES[2], 100 * c("n_symbols") > 20 * c("n_words")),
        QualityRule(3, NAMES[3], 100 * c("n_dup_lines") > 40 * c("n_lines")),
        QualityRule(4, NAMES[4], (c("word_chars") > 14 * c("n_words")) | (2 * c("word_chars") < 3 * c("n_words"))),
        QualityRule(5, NAMES[5], 100 * c("n_top_word") > 35 * c("n_words")),
        QualityRule(6, NAMES[6], (100 * c("n_upper") > 45 * c("word_chars")) | (100 * c("n_bang") > 50 * c("n_words"))),
        QualityRule(7, NAMES[7], 100 * c("n_same_next") > 30 * c("n_words")),
    ]


@dataclass(frozen=True)
class Policy:
    version: str
    bits: tuple[int, ...]

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


#: ``base`` holds the contract's two rules; later versions add to it.
POLICIES = {p.version: p for p in (Policy("base", (0, 1)), Policy("v1", (0, 1, 2, 3)), Policy("v2", (0, 1, 2, 3, 4, 5, 6, 7)))}
CURRENT = "v2"


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``fail_mask`` with the bit of every rule that the text breaks."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules()])
    return with_stats(docs).withColumn("fail_mask", bits)


def fails(policy: Policy, without: int = 0) -> Column:
    """Whether a ledger row breaks a rule of ``policy`` other than those in the mask ``without``."""
    return F.col("fail_mask").bitwiseAND(F.lit(policy.mask & ~without)) != 0


def apply(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    base = fails(POLICIES["base"])
    return rows.withColumns({"base_failed": base, "kept": ~(base | fails(POLICIES[version]))})


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: texts that break the rule, break it alone, and that are kept without it.

    Texts are counted by mask first (at most two to the number of rules groups, combined before any shuffle);
    all else works on those counts.
    """
    masks = rows.groupBy("fail_mask").agg(F.count("*").alias("n"))
    cases = [(p.version, p.mask, r.name, 1 << r.bit) for p in POLICIES.values() for r in rules() if r.bit in p.bits]
    grid = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, n, b in cases])
    each = masks.select("fail_mask", "n", F.explode(grid).alias("g")).select("fail_mask", "n", "g.*")
    hit = F.col("fail_mask").bitwiseAND(F.col("mask"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("version", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        count(hit == F.col("bit")).alias("n_only"),
        count(hit == 0).alias("n_kept"),
        count(hit.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
