"""Settings of a scan."""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases (and whether case counts), and what the channel policy allows.
GLOSSARY = (
    ("Project Nightingale", True),
    ("KunlunPay", True),
    ("region-cn-shadow", False),
    ("PROJECT-TITAN", True),
    ("internal-margin-formula", False),
)


@dataclass(frozen=True)
class Channel:
    """What tool calls may reach: parts of git remotes and of SQL connections, and the end of allowed hosts."""

    git_remotes: tuple[str, ...] = ("git.corp.example.net", "codecommit", "internal-git")
    sql_connections: tuple[str, ...] = ("analytics-ro", "reporting-replica")
    home: str = "corp.example.net"


@dataclass(frozen=True)
class ScanConfig:
    """Defaults are those of the contract; ``l3`` chooses the recognisers of personal data.

    ``patterns``: the built-in recognisers; ``results``: a column ``l3_results`` made by an analyzer client;
    ``off``: none, which every request is told in a note (and, with ``fail_closed``, a forced block).
    ``glossary`` and ``channel`` are data: phrases of any number, and the allowlists of the channel policy.
    """

    languages: tuple[str, ...] = ("en", "zh")
    l3: str = "patterns"
    l3_threshold: float = 0.5
    l3_on_all_variants: bool = True
    l3_max_variant_len: int = 4096
    l3_chunk_size: int = 1024
    l3_max_chunks: int = 4
    l3_budget_s: float = 6.0
    l3_timeout_s: float = 2.0
    l3_concurrency: int = 16
    fail_closed: bool = False
    mask: str = "[REDACTED:{entity}]"
    similarity: bool = False
    similarity_threshold: float = 0.83
    similarity_top_k: int = 5
    similarity_action: str = "block"
    semantic: bool = False
    semantic_blocks: bool = False
    semantic_min_confidence: float = 0.7
    glossary: tuple[tuple[str, bool], ...] = GLOSSARY
    channel: Channel = Channel()
