"""A projection that the optimizer doesn't look through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """df and the made columns, each computed once per row.

    They come from a generator of one row: conditions and expressions above refer to their values. A plain projection
    would be merged with what uses it, and its expressions repeated for every use in a pushed-down condition.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in made.items())))))
