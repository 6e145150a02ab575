"""Stage options with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grounding:
    concurrency: int = 32
    retries: int = 3
    first_delay_seconds: float = 2.0


@dataclass(frozen=True)
class SemanticActions:
    batch_size: int = 40
    overlap: int = 4
    merge_batch_size: int = 40
    merge_overlap: int = 2
    max_attempts: int = 2


@dataclass(frozen=True)
class Activities:
    batch_size: int = 40
    merge_batch_size: int = 16
    merge_overlap: int = 2
    prior_segments: int = 8
    max_attempts: int = 3


@dataclass(frozen=True)
class Threads:
    batch_size: int = 100
    recent_assignments: int = 10
    reassign: bool = False


@dataclass(frozen=True)
class Models:
    max_direct_activities: int = 50
    max_direct_bytes: int = 1_500_000
    concurrency: int = 4
    max_attempts: int = 4
