"""When a file in an inbox is ready: unchanged for long enough and complete, or given up waiting for.

The state machine is a function of one path's observations (time, size, mtime, complete) and what it remembered before, so that the same code
runs over a table of observations and over a stream of them; time is a column, never a clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.folds import fold
from pagewright.workers import let_workers_import

#: Fixed value: seconds after which an empty or incomplete file is let through, to fail.
GRACE = 600
STATE = "size long, mtime long, since double, first double, warned boolean"
OUTPUT = "path string, at double, ready boolean, waiting_long boolean"
Remembered = tuple[int, int, float, float, bool]


def observe(seen: Remembered | None, row: tuple[float, int, int, bool], stable: float) -> tuple[Remembered, tuple[bool, bool]]:
    """One observation (time, size, mtime, complete): (state after, (ready, to be warned of for the first time))."""
    at, size, mtime, complete = row
    same = seen is not None and (seen[0], seen[1]) == (size, mtime)
    since = seen[2] if same else at
    first, warned = (seen[3], seen[4]) if seen is not None else (at, False)
    quiet, grace = at - since, max(GRACE, stable)
    if not same:
        ready = stable == 0 and size > 0 and complete
    elif size == 0:
        ready = quiet >= grace
    else:
        ready = quiet >= stable and (complete or quiet >= grace)
    settling = same and size > 0 and quiet < stable
    warn = not ready and not settling and not warned and at - first >= GRACE
    return (size, mtime, since, first, warned or warn), (ready, warn)


def readiness(observations: DataFrame, stable: float) -> DataFrame:
    """observations: path, at (seconds), size, mtime, complete. For each, whether the path is ready then, and whether it is to be warned of.

    Observations of one time come in the order of size, mtime and completeness."""
    order = ["at", "size", "mtime", "complete"]
    rows = fold(observations.select("path", *order), ["path"], order, order, None, lambda seen, row: observe(seen, row, stable), {"ready": "boolean", "waiting_long": "boolean"})
    return rows.select("path", "at", "ready", "waiting_long")


def readiness_stream(observations: DataFrame, stable: float, forget_after_ms: int | None = None) -> DataFrame:
    """The same over a stream; a path that isn't seen for forget_after_ms is forgotten."""

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = sorted((float(a), int(s), int(m), bool(c)) for p in parts for a, s, m, c in zip(p["at"], p["size"], p["mtime"], p["complete"], strict=True))  # a path's rows of one batch
        seen, found = tuple(state.get) if state.exists else None, []
        for row in rows:
            seen, made = observe(seen, row, stable)
            found.append((row[0], *made))
        if seen is not None:
            state.update(seen)
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame({"path": key[0], "at": [x[0] for x in found], "ready": [x[1] for x in found], "waiting_long": [x[2] for x in found]})

    let_workers_import(observations.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return observations.groupBy("path").applyInPandasWithState(each, OUTPUT, STATE, "append", timeout)
