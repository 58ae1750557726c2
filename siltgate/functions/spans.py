"""All matches of a pattern in a text with their places, as an array of (start, end, tok)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltgate.schema import SPANS, empty

#: Matches whose places are summed up together.
ROOT = 256


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Half-open places in code points. A ``group`` must stand at the end of the match: its place is counted from there.

    The text is cut at its matches; places are running sums of the lengths of gaps and matches. Sums run over blocks of
    ROOT matches first and then within a block, so that no array is copied for every match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("tok")))
    none = F.array().cast("array<int>")

    def running(start: Column, some: Column) -> Column:
        """The running sums of gaps and matches from ``start`` on, one for each step."""
        return F.aggregate(some, F.struct(start.alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"] + x["n"])).alias("out")), lambda s: s["out"])

    def placed(some: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / ROOT).cast("int")), lambda b: F.slice(some, b * ROOT + 1, F.lit(ROOT)))

        def by_block(cut: Column) -> Column:
            sums = F.transform(cut, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["n"]).alias("n"))
            starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
            ends = F.flatten(F.zip_with(starts, cut, running))
            return F.zip_with(some, ends, lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["tok"].alias("tok")))

        return F.element_at(F.transform(F.array(blocks), by_block), 1)

    spans = F.element_at(F.transform(F.array(steps), placed), 1)
    if group:
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        spans = F.zip_with(spans, inner, lambda s, g: F.struct((s["end"] - F.length(g)).alias("start"), s["end"].alias("end"), g.alias("tok")))
    return F.when(text.rlike(pattern), spans).otherwise(empty(SPANS))


def rewrite(text: Column, pattern: str, change) -> Column:
    """The text with every match of the pattern replaced by ``change`` of it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    gaps = F.split(text, pattern, -1)
    woven = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(woven, "")).otherwise(text)


def window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text from ``before`` code points ahead of a span to ``after`` behind it."""
    low = F.greatest(F.lit(0), start - before)
    return F.substr(text, low + 1, end + after - low)
