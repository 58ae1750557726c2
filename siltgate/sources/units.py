"""Text units of a message: a text is one unit; a tool call gives its tool's name and every string in its arguments."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# ---- Fixed values: protocol parts that are no content, and names of one tool. ----
PROTOCOL_KEYS = frozenset({
    "toolSpecification", "profileArn", "agentTaskType", "additionalModelRequestFields", "agentMode", "conversationId", "chatTriggerType", "customizationArn", "origin", "agentContinuationId",
})
HISTORY = "conversationState.history"
WRITE_NAMES = ("write_file", "create_file", "edit_file", "put_file", "save_file")
COMMAND_KEYS = ("command", "cmd", "script", "shell")
CONNECTION_KEYS = ("connection", "conn", "database")
REMOTE_KEYS = ("remote", "url")

_S = T.StringType()
UNIT_TYPE = T.StructType([T.StructField("field_path", _S), T.StructField("text", _S)])
CALL = T.StructType([T.StructField("units", T.ArrayType(UNIT_TYPE)), T.StructField("is_object", T.BooleanType()), T.StructField("unread", T.BooleanType()), *(T.StructField(n, _S) for n in ("tool", "command", "connection", "remote")), T.StructField("remote_flag", T.BooleanType())])


def _hidden(path: str, key: str) -> bool:
    return key in PROTOCOL_KEYS or path.endswith(HISTORY)


def whole(text: str) -> str:
    """The text as it can be stored: halves of surrogate pairs that JSON escapes may leave alone become U+FFFD."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def read_json(content: str | None) -> tuple[object, bool]:
    """The value that a message's JSON has, and whether it was read. What cannot be read (no JSON, nested too deep, numbers
    too long) is a plain text."""
    try:
        return json.loads(content or ""), True
    except (ValueError, RecursionError):
        return content or "", False


def leaves(root) -> list[tuple[str | None, str]]:
    """(path, text) of every string below ``root`` in the order of the document; a stack, so any depth will do."""
    out, stack = [], [("", root)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, str):
            out.append((whole(path) or None, whole(node)))
        elif isinstance(node, dict):
            below = [(f"{path}.{k}" if path else k, k, v) for k, v in node.items()]
            stack += [(p, v) for p, k, v in reversed(below) if not _hidden(p, k)]
        elif isinstance(node, list):
            stack += [(f"{path}[{i}]", node[i]) for i in range(len(node) - 1, -1, -1)]
    return out


def _first(args: dict, keys: tuple[str, ...]) -> str | None:
    """The first value that is not empty, if it is a string."""
    value = next((args[k] for k in keys if args.get(k)), None)
    return whole(value) if isinstance(value, str) else None


def parse_call(content: str | None) -> dict:
    """The units of a JSON message and what the channel policy looks at. What is no JSON is a plain text."""
    root, read = read_json(content)
    if not isinstance(root, dict):
        return {"units": [{"field_path": p, "text": t} for p, t in leaves(root)], "is_object": False, "unread": not read}
    tool, body = root.get("tool"), root.get("arguments", root.get("args", {}))
    tool = whole(tool) if isinstance(tool, str) else tool
    found = [("tool", tool)] if isinstance(tool, str) else []
    found += leaves(root) if not body and not tool else leaves(body)
    named = root.get("arguments", root.get("args"))
    args = named if isinstance(named, dict) else {k: v for k, v in root.items() if k not in ("tool", "arguments", "args")}
    name = tool if isinstance(tool, str) else None
    return {
        "units": [{"field_path": p, "text": t} for p, t in found],
        "is_object": True,
        "unread": False,
        "tool": "write_file" if name in WRITE_NAMES else name,
        "command": next((whole(args[k]) for k in COMMAND_KEYS if isinstance(args.get(k), str)), None),
        "connection": _first(args, CONNECTION_KEYS),
        "remote": _first(args, REMOTE_KEYS),
        "remote_flag": args.get("remote") in (True, "true", "True"),
    }


_KIND = to_arrow_type(CALL)


@F.arrow_udf(CALL)
def call_of(content: pa.Array) -> pa.Array:
    return pa.array([None if c is None else parse_call(c) for c in content.to_pylist()], _KIND)


def redacted(root, pairs: list[tuple[str, str]]):
    """The same JSON with every scanned string redacted; what is not scanned stays as it is.

    Containers are copied level by level; ``open_`` has the copies whose members are still the source's.
    """

    def copy(path: str, node):
        if isinstance(node, str):
            node = whole(node)
            for matched, mask in pairs:
                node = node.replace(matched, mask)
            return node
        if isinstance(node, (dict, list)):
            node = node.copy()
            open_.append((path, node))
        return node

    open_: list[tuple[str, dict | list]] = []
    out = copy("", root)
    while open_:
        path, holder = open_.pop()
        if isinstance(holder, list):
            holder[:] = [copy(f"{path}[{i}]", v) for i, v in enumerate(holder)]
            continue
        for k, v in holder.items():
            below = f"{path}.{k}" if path else k
            if not _hidden(below, k):
                holder[k] = copy(below, v)
    return out


def rewritten(content: str, pairs: list[tuple[str, str]]) -> str:
    """A message's JSON, redacted, in canonical form; a message that cannot be read or written as JSON as a plain text."""
    root, _ = read_json(content)
    try:
        new = redacted(root, pairs)
        return new if isinstance(new, str) else whole(json.dumps(new, ensure_ascii=False))
    except RecursionError:
        return redacted(content, pairs)


@F.arrow_udf(T.StringType())
def redact_python(content: pa.Array, pairs: pa.Array, is_json: pa.Array) -> pa.Array:
    """Redacted messages: JSON by its scanned strings, texts as a whole; null where there is nothing to do."""
    out = []
    for text, some, deep in zip(content.to_pylist(), pairs.to_pylist(), is_json.to_pylist(), strict=True):
        if text is None or some is None:
            out.append(None)
            continue
        named = [(p["matched"], p["mask"]) for p in some]
        out.append(rewritten(text, named) if deep else redacted(text, named))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def canonical_json(content: pa.Array) -> pa.Array:
    """The JSON as it is written without redaction, to see whether redaction changed anything."""
    return pa.array([None if text is None else rewritten(text, []) for text in content.to_pylist()], pa.string())


def text_units(content: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("field_path"), F.coalesce(content, F.lit("")).alias("text")))
