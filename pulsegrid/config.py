"""Parameters of the detector."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    """Widths are in buckets; a bucket is `bucket_seconds` long. Values that cannot work are refused when built."""

    window: int = 5
    baseline: int = 300
    k: float = 4.0
    hold_cap: int = 25
    cooldown: int = 30
    fraction: float = 0.8
    bucket_seconds: int = 1

    def __post_init__(self) -> None:
        if self.window < 1 or self.baseline < 2 or self.bucket_seconds < 1:
            raise ValueError("window must be 1 or more, baseline 2 or more, bucket_seconds 1 or more")
        if self.hold_cap < 0 or self.cooldown < 0:
            raise ValueError("hold_cap and cooldown must not be negative")
        if not 0 < self.fraction < 1:
            raise ValueError("fraction must lie between 0 and 1, both excluded")
        if self.hold_cap >= self.retained:
            raise ValueError("hold_cap must be below baseline + window")
        if math.isnan(self.k):
            raise ValueError("k must be a number")

    @property
    def retained(self) -> int:
        """Buckets for which a count can still matter."""
        return self.baseline + self.window

    @property
    def gate(self) -> int:
        """Buckets that must have been observed before a reading counts."""
        return int(self.baseline * self.fraction)

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> DetectorConfig:
        """Defaults, with what DETECTION_* variables say instead."""
        env = dict(os.environ) if env is None else env
        names = {
            "window": ("DETECTION_WINDOW_SECONDS", int),
            "baseline": ("DETECTION_BASELINE_SECONDS", int),
            "k": ("DETECTION_K", float),
            "hold_cap": ("DETECTION_HOLD_CAP_SECONDS", int),
            "cooldown": ("DETECTION_COOLDOWN_SECONDS", int),
            "fraction": ("DETECTION_MIN_BASELINE_FRACTION", float),
        }
        return cls(**{field: kind(env[name]) for field, (name, kind) in names.items() if env.get(name)})
