"""Folds over the rows of a key in order, streamed through Arrow batches: a task holds one key's state, never its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]], end: Callable[[Any], list[tuple]] | None, schema: str) -> DataFrame:
    """What `step` (and `end`, after a key's last row) return for each key's state, with the key before it.

    rows: its columns after the keys are what a step gets; nulls are None, and a null key is a key. Rows are dealt by key and sorted in
    their partitions. schema: the keys, then what the steps return (long, int, string, boolean or double).
    """
    names = [c for c in rows.columns if c not in keys]
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, None, []

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f[0] for f in fields])

        for b in batches:
            kinds = [b.schema.field(k).type for k in keys] + [_TYPES[f[1]] for f in fields[len(keys) :]]
            columns = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, *names)}
            out = []
            for key, row in zip(zip(*(columns[k] for k in keys)), zip(*(columns[n] for n in names))):
                if key != now:
                    if now is not None and end:
                        out += [(*now, *x) for x in end(state)]
                    now, state = key, start()
                out += [(*key, *x) for x in step(state, row)]
            yield made(out)
        if now is not None and end:
            yield made([(*now, *x) for x in end(state)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
