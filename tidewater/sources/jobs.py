"""Driver-side wrapper of one collection run: gate, breaker, retries with growing waits, persistence, health row."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Breaker:
    """Opens after ``most`` failures in a row; half-open once ``recovery_s`` have passed."""

    most: int = 3
    recovery_s: float = 60.0
    failures: int = 0
    opened_at: float | None = None

    def state(self, now: float) -> str:
        if self.opened_at is None:
            return "closed"
        return "half_open" if now - self.opened_at >= self.recovery_s else "open"

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.failures, self.opened_at = 0, None
        else:
            self.failures += 1
            if self.failures >= self.most:
                self.opened_at = now


@dataclass
class Job:
    """``fetch`` gives a DataFrame, ``persist`` takes it; ``run_once`` never raises and says what happened."""

    name: str
    fetch: Callable[[], DataFrame]
    persist: Callable[[DataFrame], None]
    gate: Callable[[float], bool] = lambda now: True
    retries: int = 2
    wait_s: float = 0.5
    breaker: Breaker = field(default_factory=Breaker)
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep

    def run_once(self, force: bool = False) -> dict:
        now = self.clock()
        if not force and not self.gate(now):
            return {"name": self.name, "status": "closed_market"}
        if self.breaker.state(now) == "open":
            return {"name": self.name, "status": "breaker_open"}
        error = ""
        for k in range(self.retries + 1):
            try:
                self.persist(self.fetch())
                self.breaker.record(True, self.clock())
                return {"name": self.name, "status": "ok", "attempts": k + 1}
            except Exception as e:  # noqa: BLE001  a run reports, the schedule goes on
                error = f"{type(e).__name__}: {e}"[:300]
                if k < self.retries:
                    self.sleep(self.wait_s * 2**k)
        self.breaker.record(False, self.clock())
        return {"name": self.name, "status": "failed", "attempts": self.retries + 1, "error": error}
