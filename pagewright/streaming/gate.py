"""A pause gate: a circuit breaker that lets one file through per interval while an account is refused.

Steps of a key in the order of time: "try" asks to start a file, "limit" reports a refusal, "done" a file that went through, "skip" a file that told nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagewright.operators.folds import fold

#: paused, probing, time of the next probe
Gate = tuple[bool, bool, float]
OPEN: Gate = (False, False, 0.0)


def advance(state: Gate, at: float, step: str, retry: float) -> tuple[Gate, tuple[bool, bool]]:
    """(state after, (allowed, paused afterwards)) of one step."""
    paused, probing, next_probe = state
    if step == "limit":
        return (True, False, at + retry), (True, True)
    if step == "done":
        return (False, False, next_probe), (True, False)
    if step != "try":
        return (paused, False, next_probe), (True, paused)
    allowed = not paused or (not probing and at >= next_probe)
    return (paused, probing or (paused and allowed), next_probe), (allowed, paused)


def gate(steps: DataFrame, retry: float) -> DataFrame:
    """steps: key, at (seconds), n (order of equals), step. Adds allowed and paused."""
    return fold(steps.select("key", "at", "n", "step"), ["key"], ["at", "n"], ["at", "step"], OPEN, lambda state, row: advance(state, *row, retry), {"allowed": "boolean", "paused": "boolean"}).drop("n")
