"""Engine parameters, passed to plan builders."""

from __future__ import annotations

from dataclasses import dataclass

LEVELS = ("allow", "log", "sanitize", "exclude", "block")
SEVERITY = {name: i for i, name in enumerate(LEVELS)}
TAGS = ("SYS", "USR", "RET", "TOOL")


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds, layer switches and limits; all have runtime defaults."""

    threshold_log: float = 0.3
    threshold_sanitize: float = 0.55
    threshold_exclude: float = 0.7
    threshold_block: float = 0.85
    fail_mode: str = "closed"
    normalizer_on: bool = True
    heuristic_on: bool = True
    classifier_on: bool = False
    decision_on: bool = True
    output_guard_on: bool = True
    perplexity_on: bool = False
    perplexity_min_chars: int = 60
    classifier_batch: int = 8
    xai_top_k: int = 10
    multiturn_window: int = 6
    multiturn_decay: float = 0.85
    multiturn_medium: float = 0.45
    multiturn_cumulative: float = 1.2
    canary_length: int = 16
    header_prefix: str = "x-guard"
    borderline_on: bool = True
    borderline_min: float = 0.3
    max_queue: int | None = 10_000
    max_text: int = 4096
    max_body: int = 8192
    max_fan_out: int = 8
    val_split: float = 0.1
    seed: int = 42

    def __post_init__(self) -> None:
        t = (self.threshold_log, self.threshold_sanitize, self.threshold_exclude, self.threshold_block)
        if list(t) != sorted(t):
            raise ValueError("thresholds must not decrease from log to block")
        if self.fail_mode not in ("open", "closed"):
            raise ValueError("fail_mode is open or closed")
