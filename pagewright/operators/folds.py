"""Folds over the rows of a key in order, where each result depends on all rows before.

Rows are dealt out by key, sorted within partitions, and run through once as Arrow batches: a key of any size takes one pass and the memory of its
state. Null keys are a key like any other, and numbers keep their type."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.workers import let_workers_import

#: (state, values of the row) -> (state after, results)
Step = Callable[[Any, tuple], tuple[Any, tuple]]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _alike(a: tuple, b: tuple) -> bool:
    """Equal, where null equals null and NaN equals NaN."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def fold(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Any, step: Step, results: Mapping[str, str]) -> DataFrame:
    """Adds columns with step's results, by name and type; the state begins anew with each key."""
    let_workers_import(rows.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{n}` {t}" for n, t in results.items())])
    places = [[rows.columns.index(c) for c in some] for some in (keys, values)]
    names, kinds = list(results), [_KINDS[t] for t in results.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            of_key, of_row = ([*zip(*(batch.column(i).to_pylist() for i in some), strict=True)] for some in places)
            out = []
            for key, row in zip(of_key, of_row, strict=True):
                if last is None or not _alike(key, last):
                    last, state = key, start
                state, made = step(state, row)
                out.append(made)
            made = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
