"""Operator 13, sharding: the minimax contiguous partition of ordered groups of equal texts, by their bytes.

Groups stand in the order of a 60-bit key, the head of their text's SHA-256 (texts with one key are one group); a group is never cut. The
smallest capacity that lets the groups, in this order, fill the shards is found by binary search, checking greedily. The driver doesn't see
the groups: it holds pieces, runs of keys with the bytes of their groups and of the largest. A capacity that fails even where pieces may be cut anywhere
fails; one that suffices although each cut falls a whole largest group too early suffices. Between the two, the largest OPEN pieces in which a cut can
fall are split, by one aggregation into at most PIECES sums each time, until both meet and the cuts are borders of pieces: capacity and cuts
are then exactly those of a greedy pass over all groups.

A row's slot comes without sorting a shard: rows are written once, in narrow form; blocks of BLOCK rows of a file are counted by shard, the
counts summed in order of the blocks, and rows numbered within their block. So a group of any size is dealt over many tasks.

Defined results: null and empty texts have no bytes, and are one group; repeated rows are rows of their own; a null doc_id is kept;
an empty table gives no rows; with fewer groups than shards some stay empty; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import only, table_path

SHARDS, OVERHEAD = 40, 16
KEYS, PIECES, OPEN, BLOCK = 1 << 60, 1 << 15, 1 << 11, 1 << 14


class Piece(NamedTuple):
    """Keys from `low` up to `high` (exclusive), the bytes of their groups and of the largest one; `whole` if it is the only one."""

    low: int
    high: int
    size: int
    largest: int
    whole: bool


class Order:
    """Pieces in order of their keys, with the bytes before each. Ends are the bytes after which the shards of a capacity end."""

    def __init__(self, pieces: list[Piece], shards: int):
        self.pieces, self.shards = sorted(pieces), shards
        self.before = [0]
        for p in self.pieces:
            self.before.append(self.before[-1] + p.size)
        self.total = self.before[-1]

    def _ends(self, capacity: int, inside) -> list[int]:
        at, ends = 0, []
        for _ in range(self.shards):
            end = min(at + capacity, self.total)
            i = bisect_right(self.before, end) - 1
            if i < len(self.pieces):
                border, p = self.before[i], self.pieces[i]
                end = max(at, border if p.whole else inside(border, end, p))
            at = end
            ends.append(at)
        return ends

    def loose(self, capacity: int) -> list[int]:
        """The last ends possible: a piece of several groups may be cut anywhere."""
        return self._ends(capacity, lambda border, end, p: end)

    def sure(self, capacity: int) -> list[int]:
        """The first ends possible: some group ends less than the largest one's bytes before any place."""
        return self._ends(capacity, lambda border, end, p: max(border, end - p.largest + 1) if end > border else border)

    def strict(self, capacity: int) -> list[int]:
        """Ends at borders of pieces only."""
        return self._ends(capacity, lambda border, end, p: border)

    def least(self, ends) -> int:
        """The smallest capacity, at least the largest group's, whose ends place all bytes."""
        low, high = max(-(-self.total // self.shards), max((p.largest for p in self.pieces), default=0)), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if ends(mid)[-1] >= self.total else (mid + 1, high)
        return low

    def open(self, low: int, high: int) -> list[Piece]:
        """The largest OPEN pieces of several groups in which a shard of a capacity from low to high can end."""
        found: set[int] = set()
        for a, b in zip(self.sure(low), self.loose(high), strict=True):
            found.update(range(bisect_right(self.before, a) - 1, bisect_left(self.before, b)))
        return sorted((p for i in found if not (p := self.pieces[i]).whole), key=lambda p: (-p.size, p.low))[:OPEN]


def _split(groups: DataFrame, pieces: list[Piece]) -> list[Piece]:
    """The groups of disjoint pieces in narrower ones: each task sums its groups by equal parts of the pieces, a shuffle merges the sums."""
    pieces = sorted(pieces)
    low, high = np.array([p.low for p in pieces]), np.array([p.high for p in pieces])
    parts = max(2, PIECES // len(pieces))
    width = -(-(high - low) // parts)

    def sums(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, size = K.columns(batch, "key").to_numpy(), K.columns(batch, "size").to_numpy()
        of = np.searchsorted(low, key, side="right") - 1
        inside = np.flatnonzero((of >= 0) & (key < high[of]))
        key, size, of = key[inside], size[inside], of[inside]
        part = of * parts + (key - low[of]) // width[of]
        order = np.lexsort((key, part))
        key, size, part = key[order], size[order], part[order]
        which, first = np.unique(part, return_index=True)
        if len(which):
            last = np.append(first[1:], len(part)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (which, key[first], key[last], np.add.reduceat(size, first), np.maximum.reduceat(size, first))], names=["part", "first", "last", "size", "largest"])

    found = groups.select("key", "size").mapInArrow(K.mapped(sums), "part long, first long, last long, size long, largest long")
    merged = found.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"), F.max("largest").alias("largest"))
    return [Piece(r["first"], r["last"] + 1, r["size"], r["largest"], r["first"] == r["last"]) for r in merged.collect()]


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first keys of shards 1, 2, ...) of the minimax partition of groups(key, size), one row per key."""
    order = Order(_split(groups, [Piece(0, KEYS, 0, 0, False)]), shards)
    while True:
        low, high = order.least(order.loose), order.least(order.sure)
        ends = order.strict(high)
        if low == high and ends == order.loose(high):
            firsts = dict(zip(order.before, (p.low for p in order.pieces), strict=False))
            return high, [firsts.get(end, KEYS) for end in ends[:-1]]
        opened = order.open(low, high)
        gone = {p.low for p in opened}
        order = Order([p for p in order.pieces if p.low not in gone] + _split(groups, opened), shards)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of a written table with `shard`, and with slots, gapless from 0 in each shard."""
    placed = rows.select("*", F.concat_ws("#", F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {BLOCK}").cast("string")).alias("_block"), F.col("_metadata.row_index").alias("_row"))
    counted = placed.groupBy("_block", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("_block", "shard", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_block", "shard").orderBy("_row"))
    return placed.withColumn("_at", within).join(starts, ["_block", "shard"]).withColumn("slot", F.col("_start") + F.col("_at") - 1)


def shards(docs: DataFrame, count: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: size, checksum, shard and slot under the law `bytes`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    path, sums = table_path(spark, "shard-rows"), table_path(spark, "shard-groups")
    only(docs, "doc_id", "text").select("doc_id", (F.length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")).write.parquet(path)
    rows = spark.read.parquet(path)
    rows.groupBy("key").agg(F.sum("size").alias("size")).write.parquet(sums)
    _, firsts = cuts(spark.read.parquet(sums), count)
    shard = sum(((F.col("key") >= first).cast("int") for first in firsts), F.lit(0))
    return _numbered(rows.withColumn("shard", shard)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
