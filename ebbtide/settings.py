"""All tunable numbers in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class ForestSize:
    trees: int
    depth: int
    min_leaf: int
    features: str
    max_bins: int = 32
    # Statistics of the nodes grown in one pass over the rows; more memory, fewer passes.
    node_memory_mb: int = 1024


@dataclass(frozen=True)
class Settings:
    as_of: date
    history_days: int = 30
    horizon_days: int = 15
    noise_level: float = 0.1
    flip_rate: float = 0.05
    test_share: float = 0.2
    folds: int = 5
    min_positives: int = 10
    correlation_limit: float = 0.7
    seed: int = 42
    # A split needs 20 rows; two leaves of at least 10 already imply that.
    classifier: ForestSize = field(default=ForestSize(trees=50, depth=5, min_leaf=10, features="0.5"))
    # A split needs 5 users; Spark only bounds the leaf, and leaves of 2 are the nearest.
    forecaster: ForestSize = field(default=ForestSize(trees=100, depth=10, min_leaf=2, features="all"))

    def __post_init__(self) -> None:
        # The first half of a series feeds the model, the second half is the target.
        if self.history_days != 2 * self.horizon_days:
            raise ValueError("history_days must be exactly twice horizon_days")
