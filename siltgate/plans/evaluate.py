"""Evaluation of scores, verdicts and latencies as ordinary queries.

Scores have four digits, so a curve has at most ten thousand rows: the window that runs along it is bounded, and rows
are counted by score before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964
#: Parts that a large group is dealt to.
SALT = 64


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, precision, recall, fpr for every distinct score of (score, label), falling."""
    counts = scored.groupBy(F.round("score", 4).alias("threshold")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = counts.select("threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"))
    share = lambda a, b, other: F.when(b > 0, a / b).otherwise(F.lit(other))
    return run.select(
        "threshold", "tp", "fp",
        share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
        share(F.col("tp"), F.col("all_pos"), 0.0).alias("recall"),
        share(F.col("fp"), F.col("all_neg"), 0.0).alias("fpr"),
    )


def curve_areas(curve: DataFrame) -> DataFrame:
    """average_precision (steps of recall) and roc_auc (trapezoids) of a curve."""
    by = Window.orderBy(F.desc("threshold"))
    before = lambda c: F.coalesce(F.lag(c).over(by), F.lit(0.0))
    steps = curve.select("precision", "recall", "fpr", before("recall").alias("r0"), before("fpr").alias("f0"))
    return steps.agg(
        F.sum((F.col("recall") - F.col("r0")) * F.col("precision")).alias("average_precision"),
        F.sum((F.col("fpr") - F.col("f0")) * (F.col("recall") + F.col("r0")) / 2).alias("roc_auc"),
    )


def operating_point(curve: DataFrame, recall: float = 1.0) -> DataFrame:
    """The threshold of the best precision at a recall; of equals, the highest threshold."""
    good = curve.where(F.col("recall") >= recall)
    best = F.max_by(F.struct("threshold", "precision", "recall"), F.struct("precision", "threshold")).alias("b")
    return good.agg(best).where(F.col("b").isNotNull()).select("b.threshold", "b.precision", "b.recall")


def stratified(scored: DataFrame, level: str) -> DataFrame:
    """Rows of either label and the sorted scores, by level.

    Scores are counted before they meet by level, so a level's row has at most ten thousand (score, count) pairs; the
    list of scores is these pairs written out.
    """
    counts = stratified_counts(scored, level)
    scores = F.flatten(F.transform("counts", lambda c: F.array_repeat(c["score"], c["n"].cast("int"))))
    return counts.select(level, "label1", "label0", scores.alias("scores"))


def stratified_counts(scored: DataFrame, level: str) -> DataFrame:
    """Rows of either label by level, and how often each score is there: what stands for the list where levels are large."""
    one = scored.groupBy(level, F.round("score", 4).alias("score")).agg(F.count_if(F.col("label") == 1).alias("l1"), F.count_if(F.col("label") == 0).alias("l0"), F.count("*").alias("n"))
    return one.groupBy(level).agg(F.sum("l1").alias("label1"), F.sum("l0").alias("label0"), F.sort_array(F.collect_list(F.struct("score", "n"))).alias("counts"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval of k out of n; (0, 1) for n = 0."""
    p = k / n
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low = F.when(n > 0, F.greatest(F.lit(0.0), (middle - spread) / scale)).otherwise(F.lit(0.0))
    return low, F.when(n > 0, F.least(F.lit(1.0), (middle + spread) / scale)).otherwise(F.lit(1.0))


def top1(results: DataFrame) -> DataFrame:
    """n, correct, accuracy and its interval over (label, matched, source): positives whose match is their source.

    ``at_least`` bounds a perfect accuracy from below by the rule of three.
    """
    pos = results.where(F.col("label") == 1).agg(F.count("*").alias("n"), F.count_if(F.col("matched") == F.col("source")).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    perfect = (F.col("n") > 0) & (F.col("correct") == F.col("n"))
    return pos.select("n", "correct", F.when(F.col("n") > 0, F.col("correct") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"), F.when(perfect, 1 - 3 / F.col("n")).alias("at_least"))


#: Ranges that a group's values are counted in.
RANGES = 256


def index_quantile(df: DataFrame, group: str, value: str, k: float) -> DataFrame:
    """The value at place min(n - 1, int(n * k)) of each group's sorted values: not interpolated.

    Each group's values are counted in RANGES ranges between its least and largest; only the values of the range that has
    the place are sorted, and equal values are counted first. A group of a third of all rows is one row a range and task.
    """
    some = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = some.groupBy(F.col("g").alias("eg")).agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
    # Positions rise with values, whatever their type's rounding: equal positions only make a range larger.
    share = F.try_divide(F.col("v").cast("double") - F.col("low"), F.col("high") - F.col("low"))
    at = F.coalesce(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)), F.lit(0)).cast("int")
    # Without hints: where groups are few, the adaptive planner broadcasts them, and large ones need no dealing.
    dealt = some.join(ends, F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", at.alias("r"))
    sizes = dealt.groupBy("g", "r").agg(F.count("*").alias("c"))
    up = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("g")
    run = sizes.select("g", "r", "c", F.sum("c").over(up).alias("upto"), F.sum("c").over(whole).alias("n"))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * k))
    chosen = run.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(F.col("g").alias("cg"), F.col("r").alias("cr"), (place - (F.col("upto") - F.col("c"))).alias("left"), "n")
    inside = dealt.join(chosen, F.col("g").eqNullSafe(F.col("cg")) & (F.col("r") == F.col("cr"))).groupBy("g", "v", "left", "n").agg(F.count("*").alias("c"))
    rising = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.select("g", "v", "left", "n", F.sum("c").over(rising).alias("upto")).where(F.col("upto") > F.col("left"))
    return found.groupBy(F.col("g").alias(group)).agg(F.min("v").alias("quantile"), F.max("n").alias("n"))


def check_expectations(verdicts: DataFrame, expected: DataFrame, key: str = "req_id") -> DataFrame:
    """key, suite, outcome: pass, fail or skip of each expected case.

    ``expected``: key, suite, verdict, top_layer, must_hit and must_not_hit (arrays of entity or entity:action). A
    passing message whose expected layer was not run is skipped, never passed.
    """
    e = expected.select(key, "suite", F.col("verdict").alias("want"), F.col("top_layer").alias("want_layer"), "must_hit", "must_not_hit")
    both = e.join(verdicts.select(key, "verdict", "top_layer", "hits", "notes"), key, "left")
    said = F.flatten(F.transform(F.coalesce("hits", F.array().cast(verdicts.schema["hits"].dataType)), lambda h: F.array(h["entity"], F.concat_ws(":", h["entity"], h["action"]))))
    fine = F.col("verdict").eqNullSafe(F.col("want")) & F.col("top_layer").eqNullSafe(F.col("want_layer")) & (F.size(F.array_except("must_hit", said)) == 0) & ~F.arrays_overlap("must_not_hit", said)
    absent = F.exists(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n.startswith(F.concat(F.col("want_layer"), F.lit(" skipped"))))
    return both.select(key, "suite", F.when(fine, "pass").when((F.col("verdict") == "pass") & F.coalesce(absent, F.lit(False)), "skip").otherwise("fail").alias("outcome"), "verdict", "want")


def suite_rollup(outcomes: DataFrame) -> DataFrame:
    """Passed, failed and skipped cases, missed and false alarms by suite and in all (suite null)."""
    count = lambda c, n: F.count_if(c).alias(n)
    return outcomes.rollup("suite").agg(
        count(F.col("outcome") == "pass", "passed"), count(F.col("outcome") == "fail", "failed"), count(F.col("outcome") == "skip", "skipped"),
        count((F.col("verdict") == "pass") & (F.col("want") != "pass") & (F.col("outcome") == "fail"), "missed"),
        count((F.col("verdict") != "pass") & (F.col("want") == "pass"), "false_alarms"),
    )


def derive_evaluation(rows: DataFrame, group: str, key: str, groups: int, positives: int) -> DataFrame:
    """An evaluation set from grouped rows: of the largest groups one corpus row, positives, and negatives round robin.

    The ``groups`` groups with the most rows (ties by name) each give their first row by key as ``corpus`` and the next
    ``positives`` as ``positive``; of the other groups, the first rows by (place, group) are ``negative`` until there
    are as many as positives wanted.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), group).limit(groups).select(F.col(group).alias("g"))
    in_top = rows.join(F.broadcast(top), F.col(group) == F.col("g"), "left_semi").select(key, group)
    first = _first_rows(in_top, group, key, positives + 1)
    chosen = first.select(key, group, F.when(F.col("place") == 1, "corpus").otherwise("positive").alias("kind"))
    others = rows.join(F.broadcast(top), F.col(group) == F.col("g"), "left_anti").select(key, group)
    wanted = groups * positives
    rest = _first_rows(others, group, key, wanted).orderBy("place", group).limit(wanted)
    return chosen.unionByName(rest.select(key, group, F.lit("negative").alias("kind")))


def _first_rows(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """key, group and place of the first ``n`` rows of each group. Each of SALT parts of a group gives its own first rows
    before they meet, so no task sorts a whole large group."""
    part = F.pmod(F.xxhash64(key), F.lit(SALT))
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(key))
    some = rows.withColumn("part", part).withColumn("place", by(group, "part")).where(F.col("place") <= n)
    return some.drop("place", "part").withColumn("place", by(group)).where(F.col("place") <= n)


def model_agreement(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases, exact categories of either model against the expected one, and agreement of the two."""
    both = a.select(key, "expected", F.col("category").alias("a")).join(b.select(key, F.col("category").alias("b")), key)
    same = lambda x, y: F.count_if(F.col(x).eqNullSafe(F.col(y)))
    return both.agg(F.count("*").alias("cases"), same("a", "expected").alias("a_exact"), same("b", "expected").alias("b_exact"), same("a", "b").alias("agree"))
