"""A circuit breaker: trips after failures in a row, backs off, then lets one probe decide."""

from __future__ import annotations

import time
from collections.abc import Callable
from enum import Enum

from stowage.functions import constants as C


class State(Enum):
    CLOSED = "closed"
    OPEN = "open"
    HALF_OPEN = "half_open"


class Breaker:
    def __init__(self, threshold: int = C.TRIP_THRESHOLD, base: float = C.BACKOFF_BASE, factor: float = C.BACKOFF_FACTOR, cap: float = C.BACKOFF_CAP, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.base, self.factor, self.cap, self.clock = threshold, base, factor, cap, clock
        self.state, self.failures, self.backoff, self._since = State.CLOSED, 0, base, 0.0

    @property
    def is_open(self) -> bool:
        return self.state is State.OPEN

    @property
    def room(self) -> int | None:
        """How many files may be tried before the next look: all of them failing would trip it at the last. None: any."""
        if self.threshold <= 0:
            return None
        return 1 if self.state is State.HALF_OPEN else self.threshold - self.failures

    def success(self) -> None:
        if self.state is State.HALF_OPEN:
            self.state, self.backoff = State.CLOSED, self.base
        self.failures = 0

    def failure(self) -> None:
        """No-op while open, so that the backoff neither grows nor starts again."""
        if self.threshold <= 0 or self.is_open:
            return
        if self.state is State.HALF_OPEN:
            self._trip(min(self.backoff * self.factor, self.cap))
        elif self.failures + 1 >= self.threshold:
            self._trip(self.base)
        else:
            self.failures += 1

    def _trip(self, backoff: float) -> None:
        self.state, self.backoff, self._since, self.failures = State.OPEN, backoff, self.clock(), 0

    def wait(self) -> float:
        return max(0.0, self._since + self.backoff - self.clock()) if self.is_open else 0.0

    def probe(self) -> None:
        if self.is_open and self.wait() <= 0:
            self.state = State.HALF_OPEN
