"""Semantic alerts: an offline heuristic, model replies, and their promotion to a blocking hit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgate.schema import ALERT, BLOCK, HITS, empty, hit

# ---- Fixed values: word lists, categories and limits. ----
BUSINESS = r"(?i)(风控|风险评分|risk[_ ]?score|定价|pricing|margin|利润率|授信|信用额度|排序权重|ranking[_ ]?weight|反欺诈|fraud|额度|费率)"
LOGIC = r"(?iU)(weight|系数|阈值|threshold|[*×]\s*0\.\d|formula|公式|score\s*[+\-*×=:])"
DISGUISE = r"(?i)(内部|internal|proprietary|专有|机密|confidential)"
GENERIC = r"(?iU)(quicksort|快速排序|bubble\s*sort|debounce|throttle|binary\s*search|二分查找|冒泡|memoize|fibonacci)"
CATEGORIES = ("proprietary-source", "proprietary-business-logic", "proprietary_tech", "business_strategy", "financial_nonpublic")
CONTEXT_CHARS, MODEL_CHARS = 200, 4000
REPLY = "sensitive boolean, category string, confidence double, reason string"


def _alert(category: Column | str, confidence: Column | float, reason: Column | str, text: Column, model: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit("L4").alias("layer"), lit(category).alias("category"), lit(confidence).cast("double").alias("confidence"),
        lit(reason).alias("rationale"), F.substr(text, F.lit(1), F.lit(CONTEXT_CHARS)).alias("context"), F.lit(model).alias("model"),
    ).cast(ALERT)


def heuristic_alert(text: Column) -> Column:
    """Business words with the shape of own logic, else marks of internal origin; generic algorithms raise nothing."""
    logic = _alert("proprietary-business-logic", 0.7, "business terms with the shape of own logic", text, "heuristic:offline")
    origin = _alert("proprietary-source", 0.6, "marks of internal origin", text, "heuristic:offline")
    # Few texts have a business word or a mark: the other patterns are asked for these only.
    inward = text.rlike(DISGUISE)
    return F.when(text.rlike(BUSINESS), F.when(text.rlike(LOGIC), logic).when(inward, origin)).when(inward, F.when(~text.rlike(GENERIC), origin))


def reply_alert(reply: Column, text: Column, model: str) -> Column:
    """The alert of a model's reply: its outermost braces as JSON, if they say that the text is sensitive."""
    said = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), REPLY)
    return F.when(said["sensitive"], _alert(F.coalesce(said["category"], F.lit("")), F.coalesce(said["confidence"], F.lit(0.0)), F.coalesce(said["reason"], F.lit("")), text, model))


def alerts(text: Column, reply: Column | None = None, model: str = "model") -> Column:
    """At most one alert: the model's, or else the heuristic's, which a reply of "not sensitive" does not silence."""
    one = heuristic_alert(text) if reply is None else F.coalesce(reply_alert(reply, text, model), heuristic_alert(text))
    return F.when(one.isNotNull(), F.array(one)).otherwise(empty(f"array<{ALERT}>"))


def with_replies(df: DataFrame, client: Callable[[str], str | None], text_column: str = "content") -> DataFrame:
    """``df`` with ``l4_reply``: what the client says of the first MODEL_CHARS of each text; whatever it raises is null."""
    schema = T.StructType([*df.schema.fields, T.StructField("l4_reply", T.StringType())])

    def ask(text: str | None) -> str | None:
        try:
            return client((text or "")[:MODEL_CHARS])
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(l4_reply=[ask(t) for t in frame[text_column]])

    return df.mapInPandas(run, schema)


def promoted(found: Column, least: float) -> Column:
    """A blocking hit for the surest alert at or above ``least``; it carries the category, never the text."""
    sure = F.filter(found, lambda a: a["confidence"] >= least)
    made = F.transform(sure, lambda a: hit("L4", F.concat(F.lit("l4_semantic:"), a["category"]), F.upper(F.replace(a["category"], F.lit("-"), F.lit("_"))), F.lit(-1), F.lit(-1), a["category"], BLOCK, F.lit("l4-semantic"), F.lit(None).cast("string"), a["confidence"]))
    best = F.slice(F.array_sort(made.cast(HITS), lambda x, y: F.when(x["confidence"] > y["confidence"], -1).when(x["confidence"] < y["confidence"], 1).otherwise(0)), 1, 1)
    return F.coalesce(best, empty(HITS))
