"""Fixture and synthetic sources (S2, S14): generated relations, and a cursor over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_records(spark: SparkSession, n: int) -> DataFrame:
    """Records 0 to n - 1."""
    return records_of(spark.range(n).withColumnRenamed("id", "i"))


def records_of(numbers: DataFrame) -> DataFrame:
    """Record i by arithmetic only, generated on the executors where the numbers (i) are."""
    i = F.col("i")
    return numbers.select(
        i,
        F.concat(F.lit("synthetic-"), i.cast("string")).alias("record_id"),
        F.concat(F.lit("Synthetic Agency "), (i % 71).cast("string")).alias("buyer_name"),
        (F.lit(50_000_000) + (i * 7919) % 300_000_000).alias("estimated_amount"),
        F.timestamp_add("MINUTE", (i % 14400).cast("int"), F.lit("2026-09-01").cast("timestamp_ntz")).alias("published_at"),
        F.when(i % 3 != 0, F.array(F.lit("Seoul"))).otherwise(F.array(F.lit("Busan"))).alias("regions"),
    )


def page(df: DataFrame, cursor: int, size: int, order: str = "i") -> DataFrame:
    """The rows from an offset cursor on; the next cursor is cursor + size while the page is full."""
    return df.where((F.col(order) >= cursor) & (F.col(order) < cursor + size))


def check_page(page_no: int, size: int, total: int, received: int) -> bool:
    """Whether a page has as many rows as the totals promise."""
    return received == min(size, max(0, total - (page_no - 1) * size))
