"""The states of a replication: WAITING, ACCUMULATING, STREAMING."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from enum import Enum
from typing import TypeVar

T = TypeVar("T")


class State(str, Enum):
    WAITING = "WAITING"
    ACCUMULATING = "ACCUMULATING"
    STREAMING = "STREAMING"


class StateError(RuntimeError):
    """The call does not fit the state."""


@dataclass(frozen=True)
class StateInfo:
    current: State = State.WAITING
    start_position: str = ""
    transition_time: float = 0.0
    accumulated_changes: int = 0


class FileStore:
    """Keeps the state as JSON in a file, replaced as a whole."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> StateInfo | None:
        try:
            with open(self.path, encoding="utf-8") as f:
                data = json.load(f)
        except FileNotFoundError:
            return None
        return StateInfo(State(data["current"]), data["start_position"], data["transition_time"], data["accumulated_changes"])

    def save(self, info: StateInfo) -> None:
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(asdict(info), f)
        os.replace(f"{self.path}.new", self.path)


class BootstrapController:
    """Moves a replication from state to state; a state that cannot be saved is not taken on."""

    def __init__(self, store: FileStore, clock: Callable[[], float] = time.time, only_streaming: bool = False):
        """``only_streaming``: of saved states only STREAMING is restored."""
        self.store, self.clock, self.position = store, clock, ""
        saved = store.load()
        self.info = saved if saved and (not only_streaming or saved.current == State.STREAMING) else StateInfo()

    def _move(self, expected: State, to: StateInfo) -> StateInfo:
        if self.info.current != expected:
            raise StateError(f"state is {self.info.current.value}, not {expected.value}")
        self.store.save(to)  # raises before anything has changed
        self.info = to
        return to

    def start_bootstrap(self, position: str) -> StateInfo:
        """WAITING to ACCUMULATING, from this position on."""
        return self._move(State.WAITING, StateInfo(State.ACCUMULATING, position, self.clock(), 0))

    def complete_bootstrap(self) -> StateInfo:
        """ACCUMULATING to STREAMING."""
        return self._move(State.ACCUMULATING, replace(self.info, current=State.STREAMING, transition_time=self.clock()))

    def accumulated(self, changes: int, position: str = "") -> None:
        """So many more changes are kept, up to a position."""
        self.position = position or self.position
        self.info = replace(self.info, accumulated_changes=self.info.accumulated_changes + changes)

    def status(self) -> dict:
        return {"state": self.info.current.value, "start_position": self.info.start_position, "current_position": self.position or self.info.start_position, "accumulated_changes": self.info.accumulated_changes, "uptime_seconds": max(0.0, self.clock() - self.info.transition_time) if self.info.transition_time else 0.0}

    def may_stream(self) -> bool:
        return self.info.current == State.STREAMING


def wait_to_stream(controller: BootstrapController, poll: float = 0.1, most: float | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Return once the replication is STREAMING; StateError if it is not after ``most`` seconds."""
    waited = 0.0
    while not controller.may_stream():
        if most is not None and waited >= most:
            raise StateError(f"state is {controller.info.current.value}, not STREAMING")
        sleep(poll)
        waited += poll


def with_retry(attempt: Callable[[], T], errors: tuple[type[Exception], ...] = (OSError,), first: float = 1.0, most: float = 30.0, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of ``attempt``, tried again after ``errors``; waits double from ``first`` to ``most`` seconds.

    After ``tries`` attempts the last error is raised; None tries for ever.
    """
    wait, made = first, 0
    while True:
        try:
            return attempt()
        except errors:
            made += 1
            if made == tries:
                raise
            sleep(wait)
            wait = min(wait * 2, most)


def resume_position(replica_tables: int) -> str:
    """Where a client begins: at ``bootstrap`` if its replica is empty, else at the live end."""
    return "bootstrap" if replica_tables == 0 else ""
