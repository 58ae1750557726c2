"""The outbound-channel policy: what a tool call may send where. Denied unless allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltgate.config import Channel
from siltgate.schema import BLOCK, HITS, empty, hit

# ---- Fixed values: patterns and tool groups of the policy. ----
READ_EXFIL = r"(?isU)(cat|type|less|head|tail)\b.*\|\s*(curl|wget|nc|ncat|http)"
DATA_UPLOAD = r"(?iU)curl\b.*(--data-binary|--data|-d)\s+@?\S+"
GIT_PUSH = r"(?iU)git\s+push\s+(\S+)"
URL_HOST = r"(?iU)(?:curl|wget)\b[^\n|]*\bhttps?://([^/\s]+)"
SQL_TOOLS = ("execute_sql", "run_query", "sql")
SEARCH_TOOLS = ("code_search", "search_code", "grep_repo")
PUSH_TOOLS = ("git_push", "push")


def _allowed(value: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | value.contains(n)
    return out


def channel_hits(call: Column, allowed: Channel = Channel()) -> Column:
    """Hits of a tool call: a struct of tool, command, connection, remote and remote_flag."""
    tool, command = F.coalesce(call["tool"], F.lit("")), F.coalesce(call["command"], F.lit(""))
    connection, remote = F.coalesce(call["connection"], F.lit("")), F.coalesce(call["remote"], F.lit(""))

    def deny(entity: str, path: str, matched: Column) -> Column:
        return hit("L0", "egress_channel", entity, F.lit(-1), F.lit(-1), matched, BLOCK, F.lit("channel"), F.lit(path))

    def some(when: Column, one: Column) -> Column:
        return F.when(when, F.array(one).cast(HITS)).otherwise(empty(HITS))

    pushed = F.regexp_extract(command, GIT_PUSH, 1)
    hosts = F.filter(F.regexp_extract_all(command, F.lit(URL_HOST), F.lit(1)), lambda h: ~h.endswith(allowed.home))
    return F.concat(
        some(command.rlike(READ_EXFIL), deny("EGRESS_READ_EXFIL", "command", command)),
        some(command.rlike(DATA_UPLOAD), deny("EGRESS_DATA_UPLOAD", "command", command)),
        some((pushed != "") & ~_allowed(pushed, allowed.git_remotes), deny("EGRESS_GIT_PUSH", "command", pushed)),
        F.transform(hosts, lambda h: deny("EGRESS_HTTP", "command", h)).cast(HITS),
        some(tool.isin(*SQL_TOOLS) & (connection != "") & ~_allowed(connection, allowed.sql_connections), deny("EGRESS_SQL_CONN", "connection", connection)),
        some(tool.isin(*SEARCH_TOOLS) & F.coalesce(call["remote_flag"], F.lit(False)), deny("EGRESS_CODE_SEARCH", "remote", F.lit("remote:true"))),
        some(tool.isin(*PUSH_TOOLS) & (remote != "") & ~_allowed(remote, allowed.git_remotes), deny("EGRESS_GIT_PUSH", "remote", remote)),
    )
