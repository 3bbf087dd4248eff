"""A feed that is asked by time windows and pages (S3, D28), as a stream whose offset is the feed's cursor.

A cursor names a window, a mode and a page. A window is walked twice: by the time that records were published (mode 1), then by the time that they
were changed (mode 3). After that it is done, and the next one starts an hour before its end, so that late records aren't missed; repeats are
harmless, as ingest is idempotent. A feed is any object with `request(mode, start, end, page)`, which gives a dict with pageNo, numOfRows,
totalCount and items, and `identity(item)`. A page whose numbers don't agree fails the batch and is asked again from its cursor.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any, NamedTuple

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from noticeflow.sources.synthetic import check_page

#: How times are written, the longest window, what the next one repeats of it and its length, modes in their order, and most pages of a poll.
FORMAT, LONGEST, OVERLAP, STEP = "%Y%m%d%H%M", timedelta(days=30), timedelta(hours=1), timedelta(days=1)
PUBLISHED, CHANGED, DONE = "1", "3", "done"
MOST_PAGES = 100
SCHEMA = "source_record_id string, mode string, window_start string, page int, payload string"


class Cursor(NamedTuple):
    """Where a walk stands: the page that comes next."""

    start: str
    end: str
    mode: str = PUBLISHED
    page: int = 1

    def text(self) -> str:
        return json.dumps(self._asdict(), sort_keys=True)


def cursor_of(text: str) -> Cursor:
    """A cursor that was written by `text`; anything else is an error."""
    try:
        said = json.loads(text)
        at = Cursor(*(said[f] for f in Cursor._fields))
        times = [datetime.strptime(t, FORMAT) for t in (at.start, at.end) if re.fullmatch(r"\d{12}", t, re.ASCII)]
        fine = at.mode in (PUBLISHED, CHANGED, DONE) and type(at.page) is int and at.page >= 1 and len(times) == 2 and timedelta(0) <= times[1] - times[0] <= LONGEST
    except (ValueError, TypeError, KeyError):
        fine = False
    if not fine:
        raise ValueError("not a cursor of this feed")
    return at


def first_window(now: datetime, lookback: timedelta) -> Cursor:
    return Cursor((now - lookback).strftime(FORMAT), now.strftime(FORMAT))


def next_window(at: Cursor, now: datetime) -> Cursor:
    """The window after one that is done."""
    start = datetime.strptime(at.end, FORMAT) - OVERLAP
    return Cursor(start.strftime(FORMAT), min(now, start + STEP).strftime(FORMAT))


def _count(x: Any) -> int:
    if isinstance(x, bool) or not re.fullmatch(r"\d+", str(x), re.ASCII):
        raise ValueError("a page's numbers aren't whole")
    return int(x)


def after_page(at: Cursor, answer: dict[str, Any], size: int) -> Cursor:
    """The cursor after a page; an answer that isn't the page that was asked for, or not all of it, is an error."""
    total, items = _count(answer.get("totalCount")), answer.get("items") or []
    if (_count(answer.get("pageNo")), _count(answer.get("numOfRows"))) != (at.page, size) or not check_page(at.page, size, total, len(items)):
        raise ValueError("the feed's page doesn't agree with its totals")
    if at.page * size < total:
        return at._replace(page=at.page + 1)
    return at._replace(page=1, mode=CHANGED if at.mode == PUBLISHED else DONE)


class WindowStream(SimpleDataSourceStreamReader):
    """At most `pages` pages in a micro-batch: that bounds what a batch holds. A walk that has caught up stays where it is."""

    def __init__(self, options):
        module, _, name = options["feed"].partition(":")
        self.feed = getattr(importlib.import_module(module), name)(options)
        self.pages, self.size = int(options.get("pages", 1)), int(options.get("size", 100))
        self.lookback = timedelta(days=int(options.get("lookback_days", 1)))
        if not 1 <= self.pages <= MOST_PAGES:
            raise ValueError(f"1 to {MOST_PAGES} pages")

    def initialOffset(self) -> dict:
        return {"cursor": first_window(self.feed.now(), self.lookback).text()}

    def _page(self, at: Cursor) -> tuple[list[tuple], Cursor]:
        answer = self.feed.request(at.mode, at.start, at.end, at.page)
        rows = [(self.feed.identity(i), at.mode, at.start, at.page, json.dumps(i, ensure_ascii=False, sort_keys=True)) for i in answer.get("items") or []]
        return rows, after_page(at, answer, self.size)

    def _walk(self, at: Cursor, last: Cursor | None) -> tuple[list[tuple], Cursor]:
        """The rows of the pages from a cursor to another one, or of as many as a batch may have."""
        out: list[tuple] = []
        asked = 0
        while at != last and asked < (self.pages if last is None else MOST_PAGES):
            if at.mode == DONE:
                following = next_window(at, self.feed.now())
                if following.end <= at.end:  # nothing new yet
                    break
                at = following
                continue
            rows, at = self._page(at)
            out += rows
            asked += 1
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._walk(cursor_of(start["cursor"]), None)
        return iter(rows), {"cursor": at.text()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(cursor_of(start["cursor"]), cursor_of(end["cursor"]))[0])


class WindowSource(DataSource):
    """format("noticewindows"), options feed ("module:Class", made with the options), pages, size and lookback_days."""

    @classmethod
    def name(cls) -> str:
        return "noticewindows"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return WindowStream(self.options)
