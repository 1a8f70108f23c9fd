"""Settings of a reconciliation run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ReconcileConfig:
    """Everything that decides a result; pass another instance to change it."""

    timezone: str = "America/New_York"
    internal_domain: str = "firma.com"
    block_days: int = 1
    #: Pairs that a date, slot or party may make in one task; those that make more are dealt over tasks.
    pairs_per_task: int = 4_000_000
    dedupe_minutes: int = 60
    time_window_hours: float = 4.0
    candidate_floor: float = 0.45
    high_confidence: float = 0.70
    #: Weights in the order in which the score adds them up.
    weights: dict[str, float] = field(default_factory=lambda: {"participants": 0.40, "time": 0.30, "title": 0.20, "structure": 0.10})
