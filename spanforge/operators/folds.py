"""Folds over ordered rows of a group, where a state depends on all rows before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], reads: list[str], name: str, kind: str) -> DataFrame:
    """rows with one more column: what step(state, values of `reads`) gives beside the next state, row by row in order.

    Rows of a task come sorted by group and order and go through in batches, so of a group only its state is held, however
    many rows it has; start() gives a group's first state. A null key is a group like any other."""
    schema = rows.select("*", F.lit(None).cast(kind).alias(name)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for b in it:
            out = []
            for key, values in zip(zip(*(b.column(c).to_pylist() for c in by), strict=True), zip(*(b.column(c).to_pylist() for c in reads), strict=True), strict=True):
                if held is None or key != held[0]:
                    held, state = (key,), start()
                state, got = step(state, values)
                out.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[kind])], names=[*b.schema.names, name])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
