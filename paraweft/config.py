"""Settings and the fixed tables of the segmentation method."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Settings by text type.
# type: (threshold, window, shortest paragraph, longest paragraph, structure hints)
TYPE_SETTINGS: dict[str, tuple[float, int, int, int, bool]] = {
    "technical": (0.40, 2, 100, 800, True),
    "novel": (0.60, 4, 200, 1000, False),
    "academic": (0.45, 3, 150, 600, True),
    "news": (0.50, 3, 80, 400, False),
    "dialogue": (0.30, 2, 50, 300, False),
    "mixed": (0.30, 2, 50, 300, False),
    "unknown": (0.50, 3, 100, 500, False),
}

# Weight and threshold of scales 1, 3, 5, and the score from which a candidate is a boundary.
VOTES: dict[str, tuple[tuple[float, float], tuple[float, float], tuple[float, float], float]] = {
    "technical": ((0.4, 0.75), (0.4, 0.70), (0.2, 0.65), 0.08),
    "novel": ((0.3, 0.60), (0.4, 0.55), (0.3, 0.50), 0.03),
    "academic": ((0.4, 0.70), (0.4, 0.65), (0.2, 0.60), 0.06),
    "news": ((0.4, 0.70), (0.4, 0.65), (0.2, 0.60), 0.06),
    "dialogue": ((0.5, 0.65), (0.3, 0.60), (0.2, 0.55), 0.04),
    "mixed": ((0.4, 0.60), (0.4, 0.55), (0.2, 0.50), 0.02),
    "unknown": ((0.4, 0.65), (0.4, 0.60), (0.2, 0.55), 0.04),
}

SCALES = (1, 3, 5)
DROP = 0.15
TYPES = tuple(TYPE_SETTINGS)


@dataclass(frozen=True)
class EngineConfig:
    """Settings of one run. ``compat`` "reference" keeps the original behaviour where it loses data or ignores a setting; "documented" doesn't.

    ``endings`` names the characters that end a sentence: "zh", "western" or "both".
    ``overrides`` replace a text type's own settings (min_paragraph_length,
    max_paragraph_length, use_structure_hints).
    """

    endings: str = "zh"
    zh_optimize: bool = False
    max_length: int = 10_000
    threshold: float = 0.5
    dimensions: int = 64
    smoothing_sigma: float = 1.0
    compat: str = "documented"
    force_type: str | None = None
    enable_structure_hints: bool | None = None
    separator: str = "\n\n"
    chunk_size: int = 5000
    overrides: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.endings not in ("zh", "western", "both"):
            raise ValueError(f"endings {self.endings!r}")
        if not 0 <= self.threshold <= 1:
            raise ValueError(f"threshold {self.threshold} is not within 0 and 1")
        if self.force_type is not None and self.force_type not in TYPES[:-1]:
            raise ValueError(f"force_type {self.force_type!r}")
        if not 1000 <= self.chunk_size <= 20_000:
            raise ValueError(f"chunk_size {self.chunk_size} is not within 1000 and 20000")

    def replace(self, **changes) -> EngineConfig:
        return replace(self, **changes)

    def describe(self) -> dict[str, str]:
        """All settings as text, for ``config_used`` columns and reports."""
        return {k: str(v) for k, v in self.__dict__.items()}
