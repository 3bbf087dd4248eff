"""Where intermediate tables go: the shared checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context; where neither is set, a new local one, on one machine only."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not set_ and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(set_ or tempfile.mkdtemp(prefix="noticeflow-"))
    return set_ or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(columns: list[str], name: str) -> int | None:
    """Where a column stands: of columns that differ by case alone, the one with this very name comes first."""
    alike = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    return next((i for i in alike if columns[i] == name), alike[0] if alike else None)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with the named columns under these names, all others under names that clash with nothing; and what
    gives later rows their columns back. A missing column is null text and isn't given back."""
    have = df.columns
    inner = [f"_aside_{i}" for i in range(len(have))]
    missing = []
    for n in names:
        if (i := _place(have, n)) is None:
            missing.append(n)
        else:
            inner[i] = n
    rows = df.toDF(*inner).withColumns({n: F.lit(None).cast(T.StringType()) for n in missing})
    return rows, lambda later: later.select(*inner).toDF(*have)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is null text. Extra columns, whatever their names, stay out of the way."""
    return aside(df, *names)[0].select(*names)


def keyed_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, parts: int = 200, least: int = 1000) -> DataFrame:
    """Inner join of rows with side, which has one row per key, stands on disk, and counts the rows of each key in `weight`.

    A key with more than one in `parts` of all rows (and than `least`) would land in one task: such keys, at most `parts`, are broadcast.
    All others are joined by shuffle. `weight` is left out of the result.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = side.where(F.col(weight) > max(least, total // parts))
    cold_rows, found = rows, []
    if hot.limit(1).count():
        found = [rows.join(F.broadcast(hot.drop(weight)), on)]
        cold_rows = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    found.append(cold_rows.join(side.drop(weight), on))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
