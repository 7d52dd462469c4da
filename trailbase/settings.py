"""Settings: defaults, then a file of KEY=value lines, then the environment, then what the caller says."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from .operators import circuits, frontier, rank, robots
from .plans.rounds import Limits

PREFIX = "TRAILBASE_"


@dataclass(frozen=True)
class Settings:
    max_pages: int = 500
    max_tokens: int = 500_000
    max_duration: int = 3600
    depth_limit: int = 5
    domain_budget: int = 50
    relevance_threshold: float = 0.7
    round_size: int = 50
    rule_threshold: float = rank.THRESHOLD
    keep: int = rank.KEEP
    blend_weight: float = rank.BLEND_WEIGHT
    buffer_capacity: int = frontier.CAPACITY
    aging_window: int = frontier.AGING_WINDOW
    circuit_threshold: int = circuits.THRESHOLD
    circuit_cooldown: int = circuits.COOLDOWN
    robots_ttl_hours: int = robots.TTL_HOURS

    @classmethod
    def load(cls, file: str | None = None, **given) -> Settings:
        """Unknown names in the file or the environment are passed over; wrong values are errors."""
        found: dict[str, str] = {}
        if file and Path(file).exists():
            for line in Path(file).read_text().splitlines():
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
        found |= os.environ
        values = {f.name: type(f.default)(found[PREFIX + f.name.upper()]) for f in fields(cls) if PREFIX + f.name.upper() in found}
        return replace(cls(**values), **{k: v for k, v in given.items() if v is not None})

    def limits(self) -> Limits:
        return Limits(self.max_pages, self.depth_limit, self.domain_budget, self.round_size, max_tokens=self.max_tokens, max_duration=self.max_duration, relevance_threshold=self.relevance_threshold, buffer_capacity=self.buffer_capacity)
