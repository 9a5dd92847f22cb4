"""What a session can be given in place of its own parts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class GateCheck(Protocol):
    """Whether a gate is open; asked whenever a job behind it could start."""

    def __call__(self, gate: str) -> bool: ...


class Reporter(Protocol):
    """Is told of each event as it happens: ``event``, ``ts``, ``seq`` and what belongs to it."""

    def __call__(self, event: dict) -> None: ...


class Executor(Protocol):
    """Runs one job's body and commits its outputs; what it raises is the job's error."""

    def __call__(self, job: object, inputs: dict[str, DataFrame], params: dict[str, str]) -> None: ...


class RemoteCache(Protocol):
    """Outputs by key that other sessions have made."""

    def fetch(self, key: str) -> DataFrame | None: ...

    def store(self, key: str, output: DataFrame) -> None: ...

