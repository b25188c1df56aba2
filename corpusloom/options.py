"""Options of the operators. Defaults are the documented setting defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Folders and file globs left out of an index by default.
EXCLUDED_DIRS = (
    ".git", ".gradle", ".idea", "node_modules", "dist", "out", "build",
    "coverage", "target", ".vscode",
)
EXCLUDED_GLOBS = ("**/*.bin", "**/*.class", "**/*.jar", "**/*.lock")


@dataclass(frozen=True)
class ChunkBudgets:
    """Token budgets of a chunker, brought into their valid ranges on creation."""

    target: int = 350
    max: int = 512
    min: int = 120
    fallback: int = 300

    def __post_init__(self):
        top = max(64, int(self.max // 1))
        fixed = {
            "max": top,
            "target": min(max(32, int(self.target // 1)), top),
            "min": min(max(1, int(self.min // 1)), top),
            "fallback": min(max(32, int(self.fallback // 1)), top),
        }
        for name, value in fixed.items():
            object.__setattr__(self, name, value)


@dataclass(frozen=True)
class IndexOptions:
    """``binary_sample``: characters by which a file is judged binary or not; None takes its whole text."""

    max_file_kb: int = 512
    max_chunks: int | None = None
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS
    exclude_globs: tuple[str, ...] = EXCLUDED_GLOBS
    budgets: ChunkBudgets = field(default_factory=ChunkBudgets)
    embed_batch: int = 32
    write_batch: int = 64
    binary_sample: int | None = None


@dataclass(frozen=True)
class SearchOptions:
    """Knobs of the three search operators.

    ``metric`` is one of ``l2`` (squared Euclidean), ``cosine`` and ``ip``.
    ``digits`` rounds scores before ranking, so ranks do not hang on the last
    bits of floating-point sums; ``None`` ranks raw scores. ``trust_content``
    says that no chunk has a null text, as in a collection made by an index.
    """

    max_results: int = 12
    candidate_pool: int = 50
    min_cosine: float = 0.2
    metric: str = "l2"
    digits: int | None = None
    vector_weight: float = 0.7
    lexical_weight: float = 0.3
    exact_cosine_weight: float = 0.75
    exact_lexical_weight: float = 0.25
    metadata_weight: float = 0.7
    content_weight: float = 0.3
    trust_content: bool = False

    def __post_init__(self):
        if self.metric not in ("l2", "cosine", "ip"):
            raise ValueError(f"unknown metric {self.metric!r}")


@dataclass(frozen=True)
class MemoryOptions:
    # Fixed value: the marker that stands in for a shortened message.
    context_window: int = 8192
    safety_threshold: int = 6500
    keep_system: bool = True
    keep_recent: int = 2
    marker: str = "[Code snippet truncated to save memory]"


@dataclass(frozen=True)
class ReportOptions:
    """How hits are reported to a model.

    ``no_match`` and ``repeated`` are fixed report texts that replies may refer to.
    """

    max_matches: int = 5
    tool_name: str = "agent_search"
    no_match: str = "No indexed code matched the query."
    unavailable: str = "The collection is unavailable or not indexed."
    repeated: str = "This exact query was already executed. Refine the search terms before trying again."


@dataclass(frozen=True, kw_only=True)
class AgentOptions(ReportOptions):
    """Texts and limits of the agent loop. What the model is told is the caller's: these texts have no defaults.

    ``search_first`` follows an answer without a search, ``fix_format`` a reply that cannot be read,
    ``keep_going`` every report, and ``answer_now`` the last round.
    """

    search_first: str
    fix_format: str
    answer_now: str
    keep_going: str
    max_rounds: int = 6
