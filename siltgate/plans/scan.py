"""The whole scan as one lazy plan: a row per message, all hits inside the row, no shuffle, the same on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgate.config import ScanConfig
from siltgate.functions import text as rewritings
from siltgate.operators import detectors, egress, semantic, verdicts
from siltgate.operators.similarity import MATCHES, similarity_hits
from siltgate.schema import ALERT, HITS, UNIT, VARIANT, empty
from siltgate.sources.units import call_of, canonical_json, redact_python, text_units

#: Redactions of one text that are made in the JVM, at most.
MANY_PAIRS = 32
REQUEST = "req_id string, injection_point string, content_kind string, content string, session_window array<string>"
NOTES = {
    "l3_off": "L3 skipped: no recognisers were run, this is no true pass",
    "l3_down": "L3 skipped: the analyzer could not be reached, this is no true pass",
    "l3_late": "L3 skipped: the time budget ended before all variants were seen, this is no true pass",
    "l3_partial": "L3 skipped: some languages failed, this is no true pass",
    "l3_cut": "L3 looked at the first pieces of long texts only",
    "l37_down": "L3.7 skipped: no similarity results",
    "channel": "channel policy, not content",
    "unread": "the message could not be read as JSON, it was scanned as a text",
    "no_effect": "redaction changed nothing: the matches are not literally in the text",
    "l4_async": "L4 was not run in step",
    "l4_block": "L4 blocked in step",
}


UNIT_MATCHES = f"array<struct<text:string,matches:{MATCHES}>>"

_BUILT: dict[tuple, Column] = {}


def built(make: Callable[[], Column], *key) -> Column:
    """The expression that ``make`` gives, made once for each application and key.

    Rules compile to thousands of nodes over columns of fixed names; every scan of a session can use the same ones.
    """
    full = (SparkContext._active_spark_context.applicationId, *key)
    if full not in _BUILT:
        _BUILT[full] = make()
    return _BUILT[full]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimiser leaves as it is.

    Projections above would otherwise be merged with this one, and a costly value be written out, and computed,
    wherever it is used. A generator of one row stands between them; it needs no shuffle and no state.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _with_units(df: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """``units``, ``channel`` (the policy's hits) and ``forms``: the prepared texts of the units, then of the window."""
    is_call = F.col("content_kind") == "mcp_call"
    called = df.withColumn("call", call_of(F.when(is_call, F.col("content"))))
    outward = F.col("injection_point").isin("mcp", "egress") & F.coalesce("call.is_object", F.lit(False))
    called = called.withColumn("channel", built(lambda: F.when(outward, egress.channel_hits(F.col("call"), cfg.channel)).otherwise(empty(HITS)), "channel", cfg.channel))
    units = F.when(is_call, F.col("call.units")).otherwise(text_units(F.col("content"))).cast(f"array<{UNIT}>")
    windowed = ~is_call & (F.size(F.coalesce("session_window", empty("array<string>"))) > 0)
    joined = F.concat(F.array_join("session_window", ""), F.coalesce("content", F.lit("")))
    ready = called.withColumn("units", units).withColumn("windowed", F.coalesce(windowed, F.lit(False))).withColumn("unread", F.coalesce("call.unread", F.lit(False))).drop("call")
    texts = F.concat(F.transform("units", lambda u: u["text"]), F.when(F.col("windowed"), F.array(joined)).otherwise(empty("array<string>")))
    return once(ready, "forms", rewritings.prepare(texts))


def with_variants(df: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """``df`` with ``variants``: every rewriting of every unit, in order, each text once for a unit."""
    ready = _with_units(df, cfg)
    window = F.when(F.col("windowed"), F.element_at("forms", -1))

    def of(unit: Column, form: Column) -> Column:
        return rewritings.variants(unit["text"], form, unit["field_path"], window)

    made = built(lambda: F.flatten(F.zip_with("units", F.slice("forms", 1, F.size("units")), of)), "variants")
    return once(ready, "variants", F.coalesce(made, empty(f"array<{VARIANT}>")))


def l3_texts(cfg: ScanConfig) -> Column:
    """The distinct variants that personal data is looked for in; rotated texts could only redact, so they are left out."""
    some = F.filter("variants", lambda v: v["source"] != "decoded:rot13")
    if not cfg.l3_on_all_variants:
        some = F.filter(some, lambda v: v["source"].isin("raw", "normalized"))
    return F.flatten(F.transform(F.array(some), rewritings.distinct_by_text))


def _local(variants: Column, glossary: tuple[tuple[str, bool], ...] = detectors.GLOSSARY) -> Column:
    if len(glossary) <= detectors.FEW_PHRASES:
        return F.flatten(F.transform(variants, lambda v: detectors.local_hits(v["text"], v["source"], v["field_path"], glossary)))
    # A long glossary is one automaton over all variants of the message; its hits follow those of the other local layers.
    found = detectors.phrase_spans(glossary)(F.transform(variants, lambda v: v["text"]))
    of = lambda v, f: F.concat(detectors.local_hits(v["text"], v["source"], v["field_path"], ()), detectors.phrase_hits(f, v["source"], v["field_path"]))
    return F.flatten(F.zip_with(variants, found, of))


def _personal(cfg: ScanConfig) -> Column:
    """Hits of the built-in recognisers, or of an analyzer's results, in the distinct variants."""

    def of_piece(v: Column):
        def run(piece: Column) -> Column:
            if cfg.l3 == "results":
                same = F.filter("l3_results", lambda r: (r["text"] == piece) & r["status"].isin("ok", "partial"))
                results = F.flatten(F.transform(F.slice(same, 1, 1), lambda r: r["results"]))
            else:
                results = detectors.recognise(piece)
            return detectors.personal_hits(piece, results, v["source"], v["field_path"], cfg.l3_threshold)

        return run

    def of(v: Column) -> Column:
        # Pieces spare a service's time; the built-in recognisers read whole texts.
        if cfg.l3 != "results":
            return of_piece(v)(v["text"])
        pieces = detectors.chunks(v["text"], cfg.l3_max_variant_len, cfg.l3_chunk_size, cfg.l3_max_chunks)
        return F.flatten(F.transform(pieces, of_piece(v)))

    return F.coalesce(F.flatten(F.transform("l3_texts", of)), empty(HITS))


def unit_texts() -> Column:
    """The distinct normal forms of a message's units that are not empty, each with the path of the first unit that has it."""
    named = F.zip_with("units", F.slice("forms", 1, F.size("units")), lambda u, f: F.struct(f["norm"].alias("text"), F.lit("normalized").alias("source"), u["field_path"].alias("field_path")))
    return F.flatten(F.transform(F.array(named.cast(f"array<{VARIANT}>")), rewritings.distinct_by_text))


def _similar_by_unit(cfg: ScanConfig) -> Column:
    """The best match of every unit text that has one at the threshold, with the unit's path."""

    def of(unit: Column) -> Column:
        own = F.filter(F.coalesce("similar_units", empty(UNIT_MATCHES)), lambda m: m["text"] == unit["text"])
        return similarity_hits(F.flatten(F.transform(F.slice(own, 1, 1), lambda m: m["matches"])), cfg.similarity_threshold, cfg.similarity_action, unit["field_path"])

    return F.flatten(F.transform(unit_texts(), of))


def texts_to_embed(df: DataFrame, key: str = "req_id") -> DataFrame:
    """key, text: what a similarity search has to be asked for each message of ``df``."""
    if "session_window" not in df.columns:
        df = df.withColumn("session_window", F.lit(None).cast("array<string>"))
    return _with_units(df).select(key, F.explode(F.transform(unit_texts(), lambda u: u["text"])).alias("text"))


def with_similar(df: DataFrame, asked: DataFrame, similar: DataFrame, key: str = "req_id") -> DataFrame:
    """``df`` with ``similar_units``: for each text of ``asked`` (key, text) what ``similar`` (text, similar) says of it.

    Texts without a row there could not be looked up; the scan says so in a note.
    """
    both = asked.join(similar, "text").groupBy(key).agg(F.collect_list(F.struct("text", F.col("similar").alias("matches"))).cast(UNIT_MATCHES).alias("similar_units"))
    return df.join(both, key, "left")


def _first_seen(df: DataFrame) -> Column:
    """The path of the first unit."""
    return F.element_at(F.transform("units", lambda u: u["field_path"]), 1)


def scan(df: DataFrame, cfg: ScanConfig | None = None) -> DataFrame:
    """A row per message: verdict, top_layer, hits, redacted_text, alerts, notes, forced_block and the variants.

    ``df`` has the columns of REQUEST (``session_window`` may be missing), and where the settings ask for them
    ``l3_results`` (from an analyzer), ``similar_units`` (matches by unit text, see :func:`with_similar`) or ``similar``
    (one search for a whole message), and ``l4_reply`` (from a model).
    Further columns pass through.
    """
    cfg = cfg or ScanConfig()
    if "session_window" not in df.columns:
        df = df.withColumn("session_window", F.lit(None).cast("array<string>"))
    own = df.columns
    rows = with_variants(df, cfg)
    rows = rows.withColumn("found", built(lambda: _local(F.col("variants"), cfg.glossary), "local", cfg.glossary))
    if cfg.l3 != "off":
        rows = rows.withColumn("l3_texts", l3_texts(cfg)).withColumn("found", F.concat("found", built(lambda: _personal(cfg), "personal", cfg)))
    l37_note = F.lit(None)
    if cfg.similarity and "similar_units" in own:
        rows = rows.withColumn("found", F.concat("found", _similar_by_unit(cfg)))
        l37_note = F.when(F.size(F.array_except(F.transform(unit_texts(), lambda u: u["text"]), F.coalesce(F.transform("similar_units", lambda m: m["text"]), empty("array<string>")))) > 0, NOTES["l37_down"])
    elif cfg.similarity:
        rows = rows.withColumn("found", F.concat("found", similarity_hits(F.coalesce("similar", empty(MATCHES)), cfg.similarity_threshold, cfg.similarity_action, _first_seen(rows))))
        l37_note = F.when(F.col("similar").isNull(), NOTES["l37_down"])
    rows = rows.withColumn("found", F.concat("found", "channel"))
    none = empty(f"array<{ALERT}>")
    reply = F.col("l4_reply") if "l4_reply" in own else None
    rows = rows.withColumn("alerts", semantic.alerts(F.coalesce("content", F.lit("")), reply) if cfg.semantic else none)
    # Redaction goes by the verdict without promoted alerts; a promoted block then takes the redacted text away.
    rows = once(rows, "found", F.col("found"))
    rows = once(rows, "first", built(lambda: verdicts.dedup(F.col("found")), "dedup"))
    pairs = built(lambda: F.when(verdicts.verdict(F.col("first")) == "redact", verdicts.redaction_pairs(F.col("first"), cfg.mask)), "pairs", cfg.mask)
    rows = once(rows, "pairs", pairs)
    is_call = F.col("content_kind") == "mcp_call"
    # A text with few pairs is redacted in place; with many, each would copy the text once more than Python does.
    python = is_call | (F.size("pairs") > MANY_PAIRS)
    text = F.coalesce("content", F.lit(""))
    in_python = redact_python(F.when(F.col("pairs").isNotNull() & python, text), F.col("pairs"), is_call)
    rows = once(rows, "redacted", F.when(F.col("pairs").isNotNull(), F.when(python, in_python).otherwise(verdicts.redact_text(text, F.col("pairs")))))
    rows = rows.withColumn("as_it_was", F.when(F.col("pairs").isNotNull() & is_call, canonical_json(F.when(F.col("pairs").isNotNull() & is_call, F.col("content")))).otherwise(F.col("content")))
    if cfg.semantic and cfg.semantic_blocks:
        rows = rows.withColumn("promoted", semantic.promoted(F.col("alerts"), cfg.semantic_min_confidence))
        rows = once(rows, "hits", verdicts.dedup(F.concat("first", "promoted")))
    else:
        rows = rows.withColumn("promoted", empty(HITS)).withColumn("hits", F.col("first"))
    rows = rows.withColumn("verdict", verdicts.verdict(F.col("hits"))).withColumn("top_layer", verdicts.top_layer(F.col("hits")))
    l3_note = _l3_note(cfg)
    notes = F.array_compact(F.array(
        F.when(F.col("unread"), NOTES["unread"]),
        F.when(F.size("channel") > 0, NOTES["channel"]),
        l3_note,
        F.when(F.exists("l3_texts", lambda v: F.length(v["text"]) > max(cfg.l3_max_variant_len, cfg.l3_chunk_size * cfg.l3_max_chunks)), NOTES["l3_cut"]) if cfg.l3 == "results" else F.lit(None),
        l37_note,
        F.when(F.col("pairs").isNotNull() & (F.col("redacted") == F.col("as_it_was")), NOTES["no_effect"]),
        F.lit(None) if cfg.semantic else F.lit(NOTES["l4_async"]),
        F.when(F.size("promoted") > 0, NOTES["l4_block"]),
    ))
    incomplete = F.exists(notes, lambda n: n.startswith("L3 skipped") | n.startswith("L3.7 skipped"))
    return rows.select(
        *own,
        "verdict", "top_layer", "hits", F.size("hits").alias("n_hits"),
        F.when(F.col("verdict") == "redact", F.col("redacted")).alias("redacted_text"),
        "alerts", notes.alias("notes"),
        F.when(incomplete & F.lit(cfg.fail_closed), F.lit("block")).alias("forced_block"),
        F.array_distinct(F.transform("variants", lambda v: v["text"])).alias("variant_texts"),
    )


def _l3_note(cfg: ScanConfig) -> Column:
    if cfg.l3 == "off":
        return F.lit(NOTES["l3_off"])
    if cfg.l3 != "results":
        return F.lit(None).cast("string")
    has = lambda *s: F.exists("l3_results", lambda r: r["status"].isin(*s))
    return F.when(F.col("l3_results").isNull() | has("unreachable"), NOTES["l3_down"]).when(has("late"), NOTES["l3_late"]).when(has("partial"), NOTES["l3_partial"])


def hits_table(scanned: DataFrame, key: str = "req_id") -> DataFrame:
    """A row per hit, with its place in the message's list."""
    return scanned.select(key, F.posexplode("hits").alias("hit_ord", "h")).select(key, "hit_ord", "h.*")


def alerts_table(scanned: DataFrame, key: str = "req_id") -> DataFrame:
    return scanned.select(key, F.inline("alerts"))


def safe_hits(scanned: DataFrame, key: str = "req_id") -> DataFrame:
    """Hits without text or place, for reports: the default public view."""
    return hits_table(scanned, key).drop("matched", "span_start", "span_end").withColumn("confidence", F.round("confidence", 3))
