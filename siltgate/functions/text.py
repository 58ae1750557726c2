"""Rewritings of a text that detectors look at besides the text itself."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltgate.functions.spans import rewrite
from siltgate.schema import VARIANT

#: Characters that normalising deletes, and digits that it replaces.
ZERO_WIDTH = "​‌‍﻿⁠᠎"
CN_DIGITS, ASCII_DIGITS = "零一二三四五六七八九〇", "01234567890"
#: Patterns of the rewritings.
TOKEN_CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9\-_\s.]{10,}[A-Za-z0-9]"
SEPARATOR = r"[-_\s.]"
BASE64_RUN = r"[A-Za-z0-9+/]{16,}={0,2}"
HEX_RUN = r"(?:[0-9a-fA-F]{2}){8,}"
LITERAL = r"""["']([^"']*)["']"""
LITERAL_PAIR = LITERAL + r"(?:\s*\+\s*|\s+)" + LITERAL
ASSIGNMENT = r"""(\w+)\s*=\s*["']([^"']*)["']"""
VARIABLE_SUM = r"(\w+)\s*=\s*(\w+)\s*\+\s*(\w+)"
LONG_LITERAL = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROTATED = ALPHABET[13:26] + ALPHABET[:13] + ALPHABET[39:] + ALPHABET[26:39]
PRINTABLE_HEX = "(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])+"

_IN_TABLE = re.compile(f"[{ZERO_WIDTH}{CN_DIGITS}]")
_TABLE = {ord(c): None for c in ZERO_WIDTH} | {ord(c): d for c, d in zip(CN_DIGITS, ASCII_DIGITS, strict=True)}
PREPARED = T.StructType([T.StructField("norm", T.StringType()), T.StructField("folded", T.StringType())])


def normal_form(text: str) -> str:
    """Compatibility composition, without invisible characters, Chinese digits as ASCII."""
    text = unicodedata.normalize("NFKC", text)
    return text.translate(_TABLE) if _IN_TABLE.search(text) else text


def folded(text: str) -> str | None:
    """The text with what its string literals and variables add up to; null if nothing does."""
    if '"' not in text and "'" not in text:
        return None
    values = {name: value for name, value in re.findall(ASSIGNMENT, text)}
    sums = [values[a] + values[b] for _, a, b in re.findall(VARIABLE_SUM, text) if a in values and b in values]
    merged, again = text, 1
    # Neighbouring literals become one until no two are left; each pass at least halves a chain.
    while again:
        before = merged
        merged, again = re.subn(LITERAL_PAIR, r'"\1\2"', before)
        again = again and merged != before
    sums += [x for x in re.findall(LITERAL, merged) if len(x) >= LONG_LITERAL]
    return " ".join([text, *sums]) if sums else None


@F.arrow_udf(T.ArrayType(PREPARED))
def prepared(texts: pa.Array) -> pa.Array:
    """Normal form and folding of each text of each array; null arrays stay null. A normal form that is the text itself is
    null, so that it does not travel."""
    out = []
    for row in texts.to_pylist():
        forms = None if row is None else [(t or "", normal_form(t or "")) for t in row]
        out.append(None if forms is None else [{"norm": None if n == t else n, "folded": folded(n)} for t, n in forms])
    return pa.array(out, to_arrow_type(T.ArrayType(PREPARED)))


def prepare(texts: Column) -> Column:
    """Normal form and folding of an array of texts. Only rows with a non-ASCII character or a quote go to Python."""
    needs = F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]|[\"']"))
    plain = F.transform(texts, lambda t: F.struct(F.coalesce(t, F.lit("")).alias("norm"), F.lit(None).cast("string").alias("folded")))
    made = prepared(F.when(needs, texts))
    return F.coalesce(F.zip_with(made, texts, lambda f, t: F.struct(F.coalesce(f["norm"], t, F.lit("")).alias("norm"), f["folded"].alias("folded"))), plain)


def strip_separators(text: Column) -> Column:
    """Separators deleted inside each run that may be a token."""
    return rewrite(text, "(?U)" + TOKEN_CANDIDATE, lambda m: F.regexp_replace(m, "(?U)" + SEPARATOR, ""))


def rot13(text: Column) -> Column:
    return F.translate(text, ALPHABET, ROTATED)


def _decoded(text: Column, pattern: str, to_bytes) -> Column:
    """The text and, behind it, what its runs decode to, if that is printable ASCII; null if nothing does."""

    def one(run: Column) -> Column:
        raw = to_bytes(run)
        return F.when(F.hex(raw).rlike(rf"\A{PRINTABLE_HEX}\z"), F.decode(raw, "US-ASCII"))

    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.filter(F.transform(runs, lambda r: F.struct(r.alias("run"), one(r).alias("plain"))), lambda p: p["plain"].isNotNull() & (p["plain"] != p["run"]))
    return F.when(text.rlike(pattern) & (F.size(parts) > 0), F.concat(text, F.lit(" "), F.array_join(F.transform(parts, lambda p: p["plain"]), " ")))


def decode_base64(text: Column) -> Column:
    padded = lambda r: F.rpad(r, F.length(r) + F.pmod(-F.length(r), F.lit(4)), F.lit("="))
    return _decoded(text, BASE64_RUN, lambda r: F.try_to_binary(padded(r), F.lit("base64")))


def decode_hex(text: Column) -> Column:
    return _decoded(text, HEX_RUN, F.unhex)


def distinct_by_text(variants: Column) -> Column:
    """Variants with a text that no variant before them has."""
    earlier = lambda v, i: F.exists(F.slice(variants, 1, i), lambda o: o["text"].eqNullSafe(v["text"]))
    return F.filter(variants, lambda v, i: (F.coalesce(v["text"], F.lit("")) != "") & ~earlier(v, i))


def variants(text: Column, form: Column, path: Column, window: Column | None = None) -> Column:
    """The labelled rewritings of one text unit in order, each text once. ``form`` and ``window`` are PREPARED structs."""
    norm = form["norm"]
    named = [
        (text, "raw"), (norm, "normalized"), (strip_separators(norm), "stripped-sep"), (decode_base64(norm), "decoded:base64"),
        (decode_hex(norm), "decoded:hex"), (rot13(norm), "decoded:rot13"), (form["folded"], "folded"),
    ]
    if window is not None:
        named += [(window["norm"], "session-window"), (strip_separators(window["norm"]), "session-window")]
    made = F.array(*[F.struct(t.alias("text"), F.lit(s).alias("source"), path.alias("field_path")) for t, s in named]).cast(f"array<{VARIANT}>")
    # A lambda over a one-element array computes the rewritings once for all the comparisons.
    return F.flatten(F.transform(F.array(made), distinct_by_text))
