"""Who may fetch now: slots in all, for each host and for each job.

``Admission`` is a state machine without clock or threads. The batch replay folds recorded requests
and releases with it, and ``Gate`` puts a lock and deadlines around it for live fetching.
"""

from __future__ import annotations

import threading
import time
from collections import Counter, deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Ticket:
    """One grant; ``host`` is None for a URL that no request is made for."""

    job: str
    position: int
    host: str | None
    asked_at: float
    granted_at: float | None = None
    released: bool = False

    @property
    def waited(self) -> float:
        return 0.0 if self.granted_at is None else self.granted_at - self.asked_at


@dataclass
class Admission:
    """Jobs take turns; of a job the lowest position goes whose host has a free slot."""

    slots: int
    per_host: int
    per_job: int
    turn: deque[str] = field(default_factory=deque)
    waiting: dict[str, list[Ticket]] = field(default_factory=dict)
    busy: Counter[tuple[str, str | None]] = field(default_factory=Counter)
    most: Counter[tuple[str, str | None]] = field(default_factory=Counter)

    def __post_init__(self) -> None:
        if min(self.slots, self.per_host, self.per_job) < 1:
            raise ValueError("admission limits must be positive")

    @staticmethod
    def _counters(ticket: Ticket) -> list[tuple[str, str | None]]:
        return [("all", None), ("job", ticket.job), *([("host", ticket.host)] if ticket.host is not None else [])]

    def ask(self, job: str, position: int, host: str | None, now: float) -> Ticket:
        ticket = Ticket(job, position, host, now)
        if job not in self.waiting:
            self.waiting[job] = []
            if job not in self.turn:
                self.turn.append(job)
        self.waiting[job].append(ticket)
        self.waiting[job].sort(key=lambda t: t.position)
        return ticket

    def withdraw(self, ticket: Ticket) -> None:
        """A request that is not waited for any more; one that was granted is released."""
        if ticket in self.waiting.get(ticket.job, ()):
            self.waiting[ticket.job].remove(ticket)
            self._forget(ticket.job)
        elif ticket.granted_at is not None:
            self.release(ticket)

    def release(self, ticket: Ticket) -> None:
        """Give the slots back; a second time changes nothing."""
        if not ticket.released:
            ticket.released = True
            self.busy.subtract(self._counters(ticket))
            self._forget(ticket.job)

    def _forget(self, job: str) -> None:
        if not self.waiting.get(job) and self.busy["job", job] <= 0:
            self.waiting.pop(job, None)
            if job in self.turn:
                self.turn.remove(job)

    def _next(self, job: str) -> Ticket | None:
        if self.busy["job", job] >= self.per_job:
            return None
        return next((t for t in self.waiting.get(job, ()) if t.host is None or self.busy["host", t.host] < self.per_host), None)

    def grants(self, now: float) -> list[Ticket]:
        """All tickets that can start now, in order."""
        out: list[Ticket] = []
        looked = 0
        while self.busy["all", None] < self.slots and looked < len(self.turn):
            job = self.turn[0]
            self.turn.rotate(-1)
            ticket = self._next(job)
            looked += 1
            if ticket is not None:
                self.waiting[job].remove(ticket)
                ticket.granted_at = now
                for counter in self._counters(ticket):
                    self.busy[counter] += 1
                    self.most[counter] = max(self.most[counter], self.busy[counter])
                out.append(ticket)
                looked = 0
        # Jobs looked at in vain keep their turn.
        self.turn.rotate(looked % max(1, len(self.turn)))
        return out


def replay(events: DataFrame, slots: int, per_host: int, per_job: int) -> DataFrame:
    """Grants of recorded requests.

    ``events``: ``pool, at, seq, kind`` (ask, release, withdraw), ``job_id, position, host``. A pool
    is one process's queue: its grants depend on one another, so it is folded in one task.
    Returns ``pool, job_id, position, at, waited, in_flight, in_flight_host, in_flight_job``.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state, held, out = Admission(slots, per_host, per_job), {}, []
        for e in rows.sort_values(["at", "seq"]).itertuples(index=False):
            key = (e.job_id, e.position)
            if e.kind == "ask":
                held[key] = state.ask(e.job_id, e.position, e.host, e.at)
            elif key in held:
                (state.release if e.kind == "release" else state.withdraw)(held[key])
            for t in state.grants(e.at):
                counts = [state.busy["all", None], state.busy["host", t.host] if t.host is not None else 0, state.busy["job", t.job]]
                out.append((e.pool, t.job, t.position, e.at, t.waited, *counts))
        return pd.DataFrame(out, columns=["pool", "job_id", "position", "at", "waited", "in_flight", "in_flight_host", "in_flight_job"])

    schema = "pool string, job_id string, position int, at double, waited double, in_flight int, in_flight_host int, in_flight_job int"
    return events.groupBy("pool").applyInPandas(fold, schema)


class Gate:
    """Admission for threads: ``acquire`` waits for a slot or the deadline."""

    def __init__(self, state: Admission, clock=time.monotonic) -> None:
        self.state, self.clock, self.changed = state, clock, threading.Condition()

    def acquire(self, job: str, position: int, host: str | None, deadline: float | None = None) -> Ticket | None:
        with self.changed:
            if deadline is not None and self.clock() >= deadline:
                return None
            ticket = self.state.ask(job, position, host, self.clock())
            self._advance()
            while ticket.granted_at is None:
                left = None if deadline is None else deadline - self.clock()
                if left is not None and left <= 0:
                    self.state.withdraw(ticket)
                    self._advance()
                    return None
                self.changed.wait(left)
            return ticket

    def release(self, ticket: Ticket) -> None:
        with self.changed:
            self.state.release(ticket)
            self._advance()

    def _advance(self) -> None:
        if self.state.grants(self.clock()):
            self.changed.notify_all()


class Budget:
    """At most ``capacity`` bodies at a time."""

    def __init__(self, capacity: int, clock=time.monotonic) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.clock, self.held, self.most, self.changed = capacity, clock, 0, 0, threading.Condition()

    def acquire(self, deadline: float | None = None) -> bool:
        with self.changed:
            while self.held >= self.capacity:
                left = None if deadline is None else deadline - self.clock()
                if left is not None and left <= 0 or not self.changed.wait(left):
                    return False
            if deadline is not None and self.clock() >= deadline:
                return False
            self.held += 1
            self.most = max(self.most, self.held)
            return True

    def release(self) -> None:
        with self.changed:
            self.held -= 1
            self.changed.notify()
