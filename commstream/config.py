"""Run configuration, its checks, and the error types."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class CommstreamError(Exception):
    """Base of all errors of this library."""


class InvalidInput(CommstreamError):
    """Input or configuration that cannot be processed."""


class NotSettled(CommstreamError):
    """A bound on rounds that the user set cut a phase short."""


class Mode(str, Enum):
    DETERMINISTIC = "deterministic"
    THROUGHPUT = "throughput"


class Storage(str, Enum):
    IN_MEMORY = "in_memory"
    DISK = "disk"


class Source(str, Enum):
    FILE = "file"
    SNAPSHOT = "snapshot"
    LIVE = "live"


@dataclass(frozen=True)
class RunConfig:
    """gamma is gamma_num / gamma_den, exact. max_iterations bounds the rounds of one movement or merging phase, None
    does not; NotSettled is raised where it cuts one short. Graphs of at most local_edges edges and vertices are
    settled in one task, with the same result; 0: never. The bound is one of memory: 6.0 million edges took 940 MB."""

    mode: Mode = Mode.DETERMINISTIC
    source: Source = Source.FILE
    storage: Storage = Storage.IN_MEMORY
    accelerated: bool = False
    quality_tolerance: float = 0.001
    max_iterations: int | None = None
    levels: int = 10
    local_edges: int = 6_000_000
    gamma_num: int = 1
    gamma_den: int = 1
    pinned_profile: str | None = None

    def checked(self) -> RunConfig:
        if (self.max_iterations is not None and self.max_iterations <= 0) or self.levels <= 0:
            raise InvalidInput("max_iterations and levels must be positive")
        if not self.quality_tolerance >= 0:
            raise InvalidInput("quality_tolerance must not be negative")
        if self.gamma_num < 0 or self.gamma_den <= 0:
            raise InvalidInput("gamma must not be negative")
        return self


@dataclass(frozen=True)
class Resolution:
    source: Source
    storage: Storage
    accelerated: bool
    fallback_reason: str | None = None


def resolve(config: RunConfig, acceleration_available: bool = False) -> Resolution:
    """What a run will use. Acceleration that is not there falls back, with the reason."""
    found = Resolution(config.source, config.storage, config.accelerated)
    if config.accelerated and not acceleration_available:
        return replace(found, accelerated=False, fallback_reason="ACCEL_UNAVAILABLE")
    return found
