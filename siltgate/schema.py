"""Names, ranks and types of the records that a scan makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verdicts and layers in their order.
VERDICTS = ("pass", "redact", "block")
LAYERS = ("L0", "L1", "L2", "L3", "L3.5", "L3.7", "L4")
INJECTION_POINTS = ("prompt", "mcp", "flowback", "egress")
BLOCK, REDACT, PASS = "block", "redact", "pass"

HIT = (
    "struct<layer:string,layer_rank:int,rule:string,entity:string,span_start:int,span_end:int,matched:string,"
    "action:string,action_rank:int,confidence:double,source:string,field_path:string>"
)
HITS = f"array<{HIT}>"
ALERT = "struct<layer:string,category:string,confidence:double,rationale:string,context:string,model:string>"
UNIT = "struct<field_path:string,text:string>"
VARIANT = "struct<text:string,source:string,field_path:string>"
SPANS = "array<struct<start:int,end:int,tok:string>>"


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def hit(layer: str, rule: Column | str, entity: Column | str, start: Column, end: Column, matched: Column, action: str, source: Column, path: Column, confidence: Column | float = 1.0) -> Column:
    """One hit as a struct; every field has the type of HIT."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(layer).alias("layer"), F.lit(LAYERS.index(layer)).alias("layer_rank"), lit(rule).alias("rule"), lit(entity).alias("entity"),
        start.cast("int").alias("span_start"), end.cast("int").alias("span_end"), matched.alias("matched"),
        F.lit(action).alias("action"), F.lit(VERDICTS.index(action)).alias("action_rank"), lit(confidence).cast("double").alias("confidence"),
        source.alias("source"), path.alias("field_path"),
    )
