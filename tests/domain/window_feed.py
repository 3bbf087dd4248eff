"""A feed for the tests of noticeflow.sources.windows: JSON lines in a file, a clock in another."""

import json
from datetime import datetime
from pathlib import Path

SIZE = 3


class Archive:
    def __init__(self, options):
        self.folder = Path(options["archive"])

    def now(self):
        return datetime.strptime((self.folder / "now").read_text(), "%Y%m%d%H%M")

    def identity(self, item):
        return f"services:{item['n']}"

    def request(self, mode, start, end, page):
        if (self.folder / "down").exists():
            raise OSError("the feed is down")
        with (self.folder / "asked").open("a") as f:
            f.write(f"{mode} {start} {page}\n")
        items = [json.loads(line) for line in (self.folder / "items").read_text().splitlines()]
        field = {"1": "published", "3": "changed"}[mode]
        fit = [i for i in items if i.get(field) and start <= i[field] <= end]
        wrong = (self.folder / "short").exists() and page == 2
        return {"pageNo": page, "numOfRows": str(SIZE), "totalCount": len(fit), "items": fit[(page - 1) * SIZE : page * SIZE - wrong]}
