"""Options, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .errors import InvalidOption


def _need(ok: bool, option: str, reason: str) -> None:
    if not ok:
        raise InvalidOption(option=option, reason=reason)


@dataclass(frozen=True)
class HierarchyOptions:
    """direct_threshold: fewer vertices are solved directly; max_levels; fill_limit: total stored entries over those of the finest level;
    low_degree: heavy edge over degree below which a vertex may be cut off; prune: retire isolated coarse vertices; preserve_stopping: count them in the stopping rules."""

    direct_threshold: int = 700
    max_levels: int = 32
    fill_limit: float = 5.0
    low_degree: float = 0.125
    prune: bool = False
    preserve_stopping: bool = False
    factor_by_component: bool = False

    def __post_init__(self) -> None:
        _need(self.direct_threshold >= 1, "direct_threshold", "at least 1")
        _need(self.max_levels >= 1, "max_levels", "at least 1")
        _need(math.isfinite(self.fill_limit) and self.fill_limit > 0, "fill_limit", "finite and positive")
        _need(0 <= self.low_degree <= 1, "low_degree", "between 0 and 1")


@dataclass(frozen=True)
class PcgOptions:
    """Stops at residual <= absolute + relative * (|b| + norm bound * |x|)."""

    relative: float = 1e-8
    absolute: float = 0.0
    max_iterations: int = 1000
    recompute: int = 25
    compatibility: float = 1e-7

    def __post_init__(self) -> None:
        for name in ("relative", "absolute", "compatibility"):
            value = getattr(self, name)
            _need(math.isfinite(value) and value >= 0, name, "finite and not negative")
        _need(self.relative > 0 or self.absolute > 0, "relative", "one tolerance must be positive")
        _need(self.max_iterations >= 1, "max_iterations", "at least 1")
        _need(self.recompute >= 1, "recompute", "at least 1")


@dataclass(frozen=True)
class EngineOptions:
    """local_edges: most edges of a graph that one task may hold; part_edges: most that the driver, or one of an executor's tasks at a time, holds; planned_edges: fewest edges for which a single solve is split up;
    threads, budget: tasks at a time and bytes for their work; chunk: ids that a deterministic sum adds in order."""

    local_edges: int = 5_000_000
    planned_edges: int = 350_000
    threads: int = 8
    budget: int = 1 << 30
    min_length: int = 4096
    chunk: int = 16384
    part_edges: int = 1_000_000

    @property
    def held(self) -> int:
        """The smaller of both limits of a graph's edges."""
        return min(self.local_edges, self.part_edges)
