"""Vectors as exact integers: kept rows of a table, and sums that tasks return for groups of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import aside, table_path


def most(width: int) -> int:
    """The largest component for which every squared distance of such vectors fits in a signed 64-bit integer."""
    return isqrt(((1 << 63) - 1) // (4 * width))


def integers(column: pa.ListArray, scale: int, fits: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, offsets): floor(scale * x) of the rows of a list column that are whole: not null, of a length that
    fits, and with neither null nor non-finite components."""
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64())
    x = values.to_numpy(zero_copy_only=False)  # a null component is NaN here
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    sizes = np.diff(at)
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (wrong[at[1:]] == wrong[at[:-1]]) & fits(sizes))
    ends = np.cumsum(sizes[rows])
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    take = np.repeat(at[rows] - offsets[:-1], sizes[rows]) + np.arange(offsets[-1])
    with np.errstate(over="ignore"):
        whole = np.floor(x[take] * scale)
    if len(whole) and np.abs(whole).max() > (limit := min(most(int(sizes[rows].max())), (1 << 31) - 1)):
        raise ValueError(f"a component times {scale} is beyond {limit}: squared distances don't fit in 64 bits")
    return rows, whole.astype(np.int64), offsets


def lists(matrix: np.ndarray, of: pa.DataType) -> pa.ListArray:
    """A matrix as a column of lists."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(matrix.ravel(), of))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix."""
    flat = column.flatten().to_numpy().astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def quantised(vectors: DataFrame, scale: int, multiple: int | None = None, width: int | None = None) -> DataFrame:
    """(vec_id, label, x) of the whole rows, x as integers, written once: all rounds read this narrow table.

    width: the length that a vector must have; multiple: one of which its length must be a multiple (zero isn't)."""
    have = {c.lower(): t for c, t in vectors.dtypes}
    rows = aside(vectors, "vec_id", "embedding", "label")[0]
    embedding = F.col("embedding") if have.get("embedding", "").startswith("array<") else F.lit(None)
    rows = rows.select("vec_id", "label", embedding.cast("array<double>").alias("embedding")).where("embedding is not null")
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("x", T.ArrayType(T.IntegerType()))])
    fits = (lambda n: n == width) if width else (lambda n: (n > 0) & (n % multiple == 0))

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, values, offsets = integers(K.columns(batch, "embedding"), scale, fits)
        x = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))
        yield pa.RecordBatch.from_arrays([K.columns(batch, "vec_id").take(pa.array(keep)), K.columns(batch, "label").take(pa.array(keep)), x], names=["vec_id", "label", "x"])

    path = table_path(vectors.sparkSession, "integers")
    rows.mapInArrow(K.mapped(whole), schema).write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def add(x: np.ndarray, group: np.ndarray, into: np.ndarray) -> None:
    """Adds to each group's row its vectors' components and, last, their number."""
    order = np.argsort(group, kind="stable")
    which, first = np.unique(group[order], return_index=True)
    if len(which):
        into[which, :-1] += np.add.reduceat(x[order], first, axis=0)
        into[which, -1] += np.diff([*first, len(order)])


def merged(partial: DataFrame, group: str, sums: str) -> dict[int, list[int]]:
    """Sums by group and position of what tasks summed, as exact integers; groups and positions have a fixed number."""
    cells = partial.select(group, F.posexplode(sums).alias("at", "value")).groupBy(group, "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, dict[int, int]] = {}
    for g, at, value in cells.collect():
        out.setdefault(g, {})[at] = int(value)
    return {g: [row[i] for i in range(len(row))] for g, row in out.items()}
