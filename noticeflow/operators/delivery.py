"""Deliveries with leases and retries (D26, F28, 2.T leases), and fixed-window limits (2.T): states and their batch folds.

The streams in noticeflow.streaming run the same states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.keyed import fold

#: Seconds of a lease, attempts before the end, and seconds and hits of a limit's window.
LEASE_S, MOST_ATTEMPTS, WINDOW_S = 60, 3, 60
ENDED = ("sent", "dead_lettered", "cancelled")


@dataclass
class Delivery:
    """One event's state: who holds its lease, and when it is due again."""

    lease_s: int = LEASE_S
    backoff_s: int = 1
    status: str = "pending"
    attempts: int = 0
    token: int | None = None
    due: int | None = None
    told: bool = False

    def pass_time(self, now: int) -> list[tuple]:
        """The row of a lease that ran out, or a wait that is over, by now: once."""
        if self.due is None or self.told or self.due > now:
            return []
        self.told = True
        return [(None, self.due, "lease_expired" if self.status == "sending" else "retry_due", self.status, self.attempts)]

    def _become(self, status: str, due: int | None = None, token: int | None = None) -> str:
        self.status, self.due, self.token, self.told = status, due, token, False
        return status

    def _outcome(self, at: int, action: str, token: int | None, good: bool, retryable: bool) -> str:
        if action == "finish":
            # only who holds the lease may end the attempt; a later claim has taken it over
            if self.status != "sending" or token != self.token:
                return "fenced"
            if good:
                return self._become("sent")
            if not retryable or self.attempts >= MOST_ATTEMPTS:
                return self._become("dead_lettered")
            self._become("pending", at + 2**self.attempts * self.backoff_s)
            return "retry"
        if self.status in ENDED:
            return f"already_{self.status}"
        if self.due is not None and self.due > at:
            return "not_due"
        if action == "cancel":
            return self._become("cancelled")
        if self.attempts >= MOST_ATTEMPTS:
            return self._become("dead_lettered")
        self.attempts += 1
        self._become("sending", at + self.lease_s, token)
        return "leased"

    def apply(self, seq: int, at: int, action: str, token: int | None, good: bool, retryable: bool) -> list[tuple]:
        """Rows (seq, at, outcome, status, attempts): what became due before, then what the operation did."""
        before = self.pass_time(at)
        outcome = self._outcome(at, action, token, good, retryable)
        return [*before, (seq, at, outcome, self.status, self.attempts)]


OPERATIONS = ["event_id", "seq", "at", "action", "token", "good", "retryable"]
DELIVERY_LOG = "event_id long, seq long, at long, outcome string, status string, attempts int"


def delivery_log(ops: DataFrame, until: int, *, lease_s: int = LEASE_S, backoff_s: int = 1) -> DataFrame:
    """What each operation on a delivery did, and when leases ran out and waits ended (rows without seq), by `until`.

    ops: event_id, seq, at (seconds), action (claim, finish, cancel), token (of the claim), good, retryable. A claim takes a lease of lease_s; while it
    runs, or a wait does, the event isn't due. A finish counts only with the token of the last claim. A failure waits
    2 ** attempts * backoff_s (no jitter), or is dead after three attempts, or if it can't be retried. A cancel stands for a
    claim that the user's preferences or watches no longer allow. Ties of `at` go by seq; null flags are false.
    """
    asked = ops.select("event_id", F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"), "action", F.col("token").cast("long").alias("token"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("retryable", F.lit(False)).alias("retryable"))
    step = lambda d, row: d.apply(*row)
    return fold(asked, ["event_id"], ["at", "seq"], lambda: Delivery(lease_s, backoff_s), step, lambda d: d.pass_time(until), DELIVERY_LOG)


@dataclass
class Window:
    """A limit's window: it starts with a hit, and the first hit after its end starts the next."""

    most: int
    length: int = WINDOW_S
    start: int | None = None
    hits: int = 0

    def hit(self, at: int) -> tuple[int, int, bool]:
        """(start, hits so far, allowed)."""
        if self.start is None or at >= self.start + self.length:
            self.start, self.hits = at, 0
        self.hits += 1
        return self.start, self.hits, self.hits <= self.most


LIMITED = "scope string, actor long, seq long, window_start long, hits int, allowed boolean"


def limited(hits: DataFrame, most: int, window_s: int = WINDOW_S) -> DataFrame:
    """2.T: each hit's number in its fixed window of (scope, actor), and whether the limit allows it.

    hits: scope, actor, seq, at (seconds); ties go by seq. Rejected hits count, too.
    """
    rows = hits.select("scope", "actor", F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"))
    return fold(rows, ["scope", "actor"], ["at", "seq"], lambda: Window(most, window_s), lambda w, row: [(row[0], *w.hit(row[1]))], None, LIMITED)
