"""Rules that go from row to row of a group in order: each group is streamed through a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Fold(Protocol):
    """The state of one group; both methods give rows of the result."""

    def row(self, *values) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def fold(df: DataFrame, keys: list[str], order: list[str | Column], schema: T.StructType, new: Callable[[], Fold]) -> DataFrame:
    """Rows that a ``new`` state of each group of ``keys`` gives as its rows pass in ``order``; it gets all columns of df.

    Rows are sorted once and stream by; a task holds a batch and a state, whatever a group's size.
    """
    arrow, width = to_arrow_schema(schema), len(keys)
    own = df.select(*keys, *[c for c in df.columns if c not in keys])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[:width] != key:
                    if state is not None:
                        out += state.close()
                    key, state = row[:width], new()
                out += state.row(*row)
            yield table(out)
        if state is not None:
            yield table(list(state.close()))

    return own.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    """Fields of df, all nullable."""
    return [T.StructField(n, df.schema[n].dataType) for n in names]
