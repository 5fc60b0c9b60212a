"""The method's parameters. Percentile fractions are Python numbers: Spark takes them only as literals."""

from __future__ import annotations

from dataclasses import dataclass, field

METRICS = ("goals_per_90", "assists_per_90", "minutes_played", "start_rate", "cards_per_90")

#: Fixed values of the method: the weight of each of METRICS by group; cards count against.
WEIGHTS = {
    "Defender": (0.10, 0.10, 0.30, 0.30, 0.20),
    "Midfielder": (0.25, 0.30, 0.15, 0.15, 0.15),
    "Forward": (0.45, 0.25, 0.10, 0.10, 0.10),
}


@dataclass(frozen=True)
class Params:
    version: str = "v1.0"
    minimum_minutes: int = 900
    maximum_valuation_lag_days: int = 365
    minimum_peers: int = 30
    low: float = 0.05
    high: float = 0.95
    maximum_target_lag_days: int = 90
    horizons: tuple[int, ...] = (6, 12, 24)
    weights: dict[str, tuple[float, ...]] = field(default_factory=lambda: WEIGHTS)
