"""Cursor-paged feeds as a Spark data source (S1, S2): the offset of a stream is the feed's cursor.

A feed is any object with `discover(cursor) -> (records, next_cursor)`, where records are dicts with obs_seq,
source_record_id and payload, and next_cursor is None at the end. A page is read again from its cursor after a
failure, so what a feed says for a cursor must not change; repeats beyond that are harmless, as ingest is idempotent.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

SCHEMA = "obs_seq long, source_record_id string, payload string"


class MockFeed:
    """Six fixed notices of one lifecycle in pages of two."""

    size = 2
    #: Fixed records: id, stage, title, amount, closing time, regions.
    records = (
        ("pre-spec-001", "pre-specification", "Cloud platform draft", None, None, None),
        ("tender-001", "tender", "Cloud platform", "125000000", "2026-09-30T09:00:00Z", None),
        ("amendment-001", "amendment", "Cloud platform", None, "2026-10-02T09:00:00Z", []),
        ("amendment-001", "amendment", "Cloud platform", "150000000", "2026-10-05T09:00:00Z", ["Seoul"]),
        ("award-001", "award", "Cloud platform award", None, None, None),
        ("contract-001", "contract", "Cloud platform contract", None, None, None),
    )

    def discover(self, cursor: int) -> tuple[list[dict[str, Any]], int | None]:
        part = self.records[cursor : cursor + self.size]
        made = [{"obs_seq": cursor + i, "source_record_id": r[0], "payload": json.dumps({k: v for k, v in zip(("lifecycle_stage", "title", "estimated_amount", "closes_at", "regions"), r[1:]) if v is not None} | {"buyer_name": "Example Agency"})} for i, r in enumerate(part)]
        following = cursor + self.size
        return made, following if following < len(self.records) else None


def _feed(options) -> Any:
    module, _, name = options.get("feed", "noticeflow.sources.feed:MockFeed").partition(":")
    return getattr(importlib.import_module(module), name)()


def _rows(records: list[dict[str, Any]]) -> Iterator[tuple]:
    return iter([(r["obs_seq"], r["source_record_id"], r["payload"]) for r in records])


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        feed, cursor = _feed(self.options), int(self.options.get("cursor", 0))
        while cursor is not None:
            records, cursor = feed.discover(cursor)
            yield from _rows(records)


class FeedStream(SimpleDataSourceStreamReader):
    """One page per micro-batch; a finished feed stays at its last cursor."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": int(self.options.get("cursor", 0)), "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter(()), start
        records, following = _feed(self.options).discover(start["cursor"])
        return _rows(records), {"cursor": start["cursor"] if following is None else following, "done": following is None}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        now = start
        while now != end:
            rows, now = self.read(now)
            yield from rows


class FeedSource(DataSource):
    """format("noticefeed"), options feed ("module:Class") and cursor."""

    @classmethod
    def name(cls) -> str:
        return "noticefeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(FeedSource)
