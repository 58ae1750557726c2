"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template: a turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline; a conversation is its turns one
after the other. A deterministic parser reads it back: ``<|im_end|>`` ends a turn, ``<|im_start|>`` begins one, the
first newline ends the role, any other control string in a turn is an error, and what is read is unescaped.

Rendering goes by the round trip. A turn is rendered as it is and parsed; if the parser fails or recovers another
role or text, the turn's content is escaped, rendered and parsed again; a turn that differs even then stops the job,
so no text is ever silently changed. Whole conversations are parsed and compared once more when they are read.

Escaping is reversible stuffing: every control string, with any number of backslashes after its first character,
gets one more; unescaping takes one away. Control strings start with ``<`` or ``[`` and contain neither again,
so matches cannot overlap, and an escaped text contains no control string. In roles, backslash and newline are
escaped too.

Turns are ordered by (turn, role, text). A conversation is one training example and becomes one row: its turns,
rendered one by one before, are gathered once. The loss mask has the place of every learned text, in code points and
in bytes of the formatted text; what is learned is cut out by the mask, never taken from the source.

Defined results: null texts and roles are empty; a conversation without assistant turns has an empty mask and an empty
loss text; turns that are equal in (turn, role, text) and repeated rows are turns of their own; each row with a null
conversation id is a conversation of its own; very long texts are formatted whole; extra columns are not read; an empty
table gives no conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltgate.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: The template's control strings, and those of other templates that tokenizers may treat as control.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]")
#: Roles whose texts the model learns.
LEARNED = ("assistant",)


def _rests(first: str) -> str:
    """The control strings that begin with a character, without it, as a pattern."""
    return "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == first)


FIRSTS = sorted({c[0] for c in CONTROLS})
RAW = "|".join(f"(?:{re.escape(f)}(?:{_rests(f)}))" for f in FIRSTS)


def escape(text: Column) -> Column:
    """One more backslash in every control string and in every escaped one."""
    for f in FIRSTS:
        text = F.regexp_replace(text, rf"({re.escape(f)})(\\*)({_rests(f)})", r"$1\\$2$3")
    return text


def unescape(text: Column) -> Column:
    """One backslash less in every escaped control string."""
    for f in FIRSTS:
        text = F.regexp_replace(text, rf"({re.escape(f)})\\(\\*)({_rests(f)})", "$1$2$3")
    return text


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def _body(turn: Column, whole: bool) -> tuple[Column, Column]:
    """Role and text of a rendered turn as they stand, between the turn's own marks; ``whole``: with its end mark."""
    inner = F.substr(turn, F.lit(len(START) + 1), F.length(turn) - (len(START) + (len(END) + 1 if whole else 0)))
    cut = F.instr(inner, "\n")
    return F.substr(inner, F.lit(1), cut - 1), F.substr(inner, cut + 1, F.length(inner) - cut)


def parse(turn: Column) -> tuple[Column, Column]:
    """Role and text that the parser recovers from one rendered turn; null if a control string is inside."""
    role, text = _body(turn, True)
    bad = role.rlike(RAW) | text.rlike(RAW)
    return F.when(~bad, _role_in(role)), F.when(~bad, unescape(text))


def render_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, escaped, ``out`` (the rendered turn) and ``n_text`` (code points of the text in it)."""
    source = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    plain = source.withColumn("plain", render(role, text))
    read_role, read_text = parse(F.col("plain"))
    tried = plain.withColumn("escaped", ~(read_role.eqNullSafe(role) & read_text.eqNullSafe(text)))
    second = tried.withColumn("out", F.when(F.col("escaped"), render(_role_out(role), escape(text))).otherwise(F.col("plain")))
    again_role, again_text = parse(F.col("out"))
    same = ~F.col("escaped") | (again_role.eqNullSafe(role) & again_text.eqNullSafe(text))
    checked = second.withColumn("out", F.when(same, F.col("out")).otherwise(F.raise_error(F.lit("a turn does not survive its round trip"))))
    inner = F.when(F.col("escaped"), escape(text)).otherwise(text)
    return checked.select("conv_id", "turn", "role", "text", "escaped", "out", F.length(inner).alias("n_text"), F.octet_length(inner).alias("n_bytes"))


def _digest(role: Column, text: Column) -> Column:
    """A digest of a turn; the role's length keeps the two apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (spans of learned texts in ``formatted``: start and stop in code points, from_byte and
    to_byte in UTF-8), source_digests, n_escaped."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = render_turns(rows)
    tail = len(END) + 1

    def placed(some: DataFrame, total) -> DataFrame:
        ends = some.withColumn("end", total("out", F.length)).withColumn("end_byte", total("out", F.octet_length))
        stop, to_byte = F.col("end") - tail, F.col("end_byte") - tail
        span = F.struct((stop - F.col("n_text")).alias("start"), stop.alias("stop"), (to_byte - F.col("n_bytes")).alias("from_byte"), to_byte.alias("to_byte"))
        return ends.select("conv_id", "out", "end", "escaped", _digest(F.col("role"), F.col("text")).alias("h"), F.when(F.col("role").isin(*LEARNED), span).alias("span"))

    each = placed(turns.where(F.col("conv_id").isNotNull()), lambda c, size: F.sum(size(c)).over(by))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("end", "out", "h", "span"))).alias("t"), F.count_if("escaped").alias("n_escaped"))
    together = whole.select(
        "conv_id",
        F.array_join(F.col("t.out"), "").alias("formatted"),
        F.array_compact(F.col("t.span")).alias("loss_mask"),
        F.col("t.h").alias("source_digests"),
        "n_escaped",
    )
    # Rows without a conversation meet no other row, so they need no dealing; the filter reaches the scan.
    alone = placed(turns.where(F.col("conv_id").isNull()), lambda c, size: size(c).cast("long"))
    return together.unionByName(alone.select("conv_id", F.col("out").alias("formatted"), F.array_compact(F.array("span")).alias("loss_mask"), F.array("h").alias("source_digests"), F.col("escaped").cast("long").alias("n_escaped")))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask and ``turns`` (role, text) as the parser reads them from the formatted text.

    Stops the job if a conversation's turns are not its source's.
    """
    pieces = F.split("formatted", re.escape(f"{END}\n"), -1)

    def turn(piece: Column) -> Column:
        role, text = _body(piece, False)
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    read = formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))
    same = F.transform("turns", lambda t: _digest(t["role"], t["text"])) == F.col("source_digests")
    checked = F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    return read.select("conv_id", "formatted", "loss_mask", checked.alias("turns"))


def learned(read: DataFrame) -> Column:
    """All text under the loss mask of ``read``, unescaped, one span after the other."""
    cut = lambda raw: F.transform("loss_mask", lambda m: unescape(F.decode(F.substr(raw, m["from_byte"].cast("int") + 1, (m["to_byte"] - m["from_byte"]).cast("int")), "UTF-8")))
    # Bytes are cut in place; the one-element array makes them once, not once for each span.
    return F.array_join(F.element_at(F.transform(F.array(read["formatted"].cast("binary")), cut), 1), "")


def digests(read: DataFrame) -> DataFrame:
    """What the query reports of conversations that were read back."""
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    joined = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), all_text.alias("all_text"), learned(read).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return joined.select(
        "conv_id", "n_turns", F.sha2("all_text", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def hostile(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of other templates' control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def round_trip(rows: DataFrame) -> DataFrame:
    """Formats, writes to the shared folder, reads back and parses."""
    return read_conversations(stored(format_conversations(rows), "chat"))
