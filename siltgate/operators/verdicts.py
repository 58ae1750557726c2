"""From hits to a verdict: deduplication, precedence, redaction. All within one row, so that streams need no state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltgate.schema import LAYERS, REDACT, VERDICTS, empty

PAIRS = "array<struct<matched:string,mask:string>>"


def _key(h: Column) -> Column:
    return F.struct(h["rule"], h["span_start"], h["span_end"], h["field_path"], h["entity"])


def dedup(hits: Column) -> Column:
    """One hit for each rule, span, path and entity, at the place of the first: the surest, the first of equals.

    Hits are sorted by key, surest and earliest first; where the key changes, its best hit begins. Another sort brings
    these back to the places of their keys. The cost is that of sorting.
    """
    by = F.transform(hits, lambda h, i: F.struct(_key(h).alias("key"), (-h["confidence"]).alias("sure"), i.alias("at")))
    firsts = F.array_sort(F.transform(hits, lambda h, i: F.struct(_key(h).alias("key"), i.alias("at"))))

    def heads(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | ~F.get(ordered, i - 1)["key"].eqNullSafe(x["key"]))

    # Both lists have the same keys in the same order: the key's first place beside its best hit's.
    places = lambda ordered: F.transform(heads(ordered), lambda x: x["at"])
    bound = lambda ordered: F.element_at(F.transform(F.array(ordered), places), 1)
    pairs = F.array_sort(F.zip_with(bound(firsts), bound(F.array_sort(by)), lambda first, best: F.struct(first.alias("first"), best.alias("best"))))
    return F.when(F.size(hits) > 1, F.transform(pairs, lambda p: F.get(hits, p["best"]))).otherwise(hits)


def verdict(hits: Column) -> Column:
    """The strongest action of any hit."""
    return F.get(F.lit(list(VERDICTS)), F.coalesce(F.array_max(F.transform(hits, lambda h: h["action_rank"])), F.lit(0)))


def top_layer(hits: Column) -> Column:
    """The lowest layer among hits with the deciding action; null without hits."""
    strongest = F.array_max(F.transform(hits, lambda h: h["action_rank"]))
    return F.get(F.lit(list(LAYERS)), F.array_min(F.transform(F.filter(hits, lambda h: h["action_rank"] == strongest), lambda h: h["layer_rank"])))


def redaction_pairs(hits: Column, mask: str) -> Column:
    """What to replace by what, longest first, then in the order of first mention; the last hit of a text gives its mask."""
    red = F.filter(hits, lambda h: (h["action"] == REDACT) & (F.coalesce(h["matched"], F.lit("")) != ""))

    def runs(ordered: Column) -> Column:
        """Of mentions sorted by (text, place) the first of each text, with the entity of the last."""
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i - 1)["matched"] != F.get(ordered, i)["matched"]))

        def pairs_of(s: Column) -> Column:
            def pair(i: Column, k: Column) -> Column:
                first, last = F.get(ordered, i), F.get(ordered, F.coalesce(F.get(s, k + 1), n) - 1)
                return F.struct((-F.length(first["matched"])).alias("long"), first["at"].alias("at"), first["matched"].alias("matched"), F.replace(F.lit(mask), F.lit("{entity}"), last["entity"]).alias("mask"))

            return F.array_sort(F.transform(s, pair))

        return F.element_at(F.transform(F.array(starts), pairs_of), 1)

    mentions = F.array_sort(F.transform(red, lambda h, i: F.struct(h["matched"].alias("matched"), i.alias("at"), h["entity"].alias("entity"))))
    ordered = F.element_at(F.transform(F.array(mentions), runs), 1)
    return F.when(F.size(red) > 0, F.transform(ordered, lambda p: F.struct(p["matched"].alias("matched"), p["mask"].alias("mask")))).otherwise(empty(PAIRS))


def redact_text(text: Column, pairs: Column) -> Column:
    """Every occurrence of every matched text replaced, one pair after the other."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["matched"], p["mask"]))
