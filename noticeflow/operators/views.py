"""Lists, pages and dashboards."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EPOCH = "1970-01-01 00:00:00"


def inbox_filter(df: DataFrame, *, equal: dict[str, object] | None = None, buyer: str | None = None, q: str | None = None, amount: tuple = (None, None), deadline: tuple = (None, None)) -> DataFrame:
    """Null parameters don't filter; buyer is a case-sensitive substring, q a case-insensitive one of title or buyer; ranges are inclusive and null values fail them."""
    for low, high in (amount, deadline):
        if low is not None and high is not None and low > high:
            raise ValueError("inverted range")
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if buyer is not None:
        df = df.where(F.contains("buyer", F.lit(buyer)))
    if q is not None:
        needle = F.lower(F.lit(q))
        df = df.where(F.contains(F.lower("title"), needle) | F.contains(F.lower("buyer"), needle))
    for column, (low, high) in (("amount", amount), ("deadline", deadline)):
        if low is not None:
            df = df.where(F.col(column) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(column) <= F.lit(high))
    return df


def keyset_page(df: DataFrame, limit: int, *, at: str = "published_at", id_: str = "id", after: tuple | None = None) -> DataFrame:
    """The page after a cursor by (at or epoch, id), newest first; one row more than the limit tells of a next page."""
    key = F.coalesce(F.col(at), F.lit(EPOCH).cast("timestamp_ntz"))
    if after is not None:
        df = df.where((key < F.lit(after[0]).cast("timestamp_ntz")) | ((key == F.lit(after[0]).cast("timestamp_ntz")) & (F.col(id_) < after[1])))
    return df.orderBy(key.desc(), F.col(id_).desc()).limit(limit + 1)


def filter_fingerprint(owner: str, filters: dict) -> str:
    return hashlib.sha256(json.dumps([owner, filters], sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def encode_cursor(at: str, id_: object, fingerprint: str) -> str:
    """O2: an opaque cursor that only fits the owner and filters it was made for."""
    return base64.urlsafe_b64encode(json.dumps([at, id_, fingerprint]).encode()).decode()


def decode_cursor(cursor: str, fingerprint: str) -> tuple:
    at, id_, made_for = json.loads(base64.urlsafe_b64decode(cursor))
    if made_for != fingerprint:
        raise ValueError("the cursor belongs to other filters")
    return at, id_


def pending(raw: DataFrame, failures: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Oldest rows that no blocking failure holds; held rows go before the limit counts."""
    blocking = failures.where(F.col("dead_lettered") | (F.col("attempts") > 0) | F.col("next_retry_at").isNotNull())
    return raw.join(blocking.select(key), key, "left_anti").orderBy(*order).limit(limit)


def changed_since(items: DataFrame, versions: DataFrame, key: str, since: Column) -> DataFrame:
    """Items with a current version after an instant."""
    return items.join(versions.where((F.col("transition_kind") == "current") & (F.col("transition_at") > since)), key, "left_semi")


def decision_status(has_profile: Column, has_version: Column, documents_done: Column, effective_at: Column, now: Column) -> Column:
    """The first thing that stands in the way of a decision."""
    return F.when(~has_profile, "profile_required").when(~has_version, "missing_version").when(~documents_done, "documents_pending").when(effective_at > now, "future_version").otherwise("ready")


def pipeline_dashboard(log: DataFrame, since: Column) -> DataFrame:
    """A1, A4, A5, D34 in one pass: sums over rows since an instant, and filtered counts. log: at, fetched, created, failed, retries, dead_lettered."""
    today = F.col("at") >= since
    zero = lambda c: F.coalesce(F.sum(F.when(today, F.col(c))), F.lit(0)).alias(c)
    return log.agg(zero("fetched"), zero("created"), zero("failed"), F.count_if((F.col("retries") > 0) & ~F.col("dead_lettered")).alias("retrying"), F.count_if("dead_lettered").alias("dead"))


def patch_merge(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Base rows with the fields that a patch sets (its array set_fields names them; null can be set) replaced."""
    p = patches.select(F.col(key), "set_fields", *(F.col(f).alias(f"_{f}") for f in fields))
    isset = lambda f: F.coalesce(F.array_contains("set_fields", f), F.lit(False))
    return base.join(p, key, "left").select(*(F.when(isset(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns))


def ui_order(df: DataFrame, by: str) -> DataFrame:
    """Recommendation (recommended first, then score), deadline or budget; unknown values last, ids break ties."""
    keys = {"recommendation": [F.col("recommended").desc_nulls_last(), F.col("score").desc_nulls_last()], "deadline": [F.col("deadline").asc_nulls_last()], "budget": [F.col("amount").desc_nulls_last()]}[by]
    return df.orderBy(*keys, "id")


def top_features(df: DataFrame, features: list[str], n: int = 2) -> DataFrame:
    """The n greatest features per row as (name, value), greatest first; names break ties."""
    entries = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.struct((-F.col(f).cast("double")).alias("k"), F.lit(f).alias("name"), F.col(f).cast("double").alias("value"))) for f in features)))
    return df.withColumn("top", F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))))


def field_rows(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """P20: known fields as (key, field, value) rows."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(key, F.inline(rows)).where("value is not null")


def decision_label(eligible: Column, warnings: Column, recommended: Column) -> Column:
    """The label of a card."""
    return F.when(recommended, "recommended").when(~eligible, "excluded").when(F.size(warnings) > 0, "review").otherwise("eligible")


#: Rows of a batch, and batches that one request looks through for eligible rows.
BATCH, MOST_BATCHES = 100, 10


def _looked_through(rows: DataFrame, decide: Callable[[DataFrame], DataFrame], at: str, id_: str, after: tuple | None) -> DataFrame:
    known = F.coalesce(F.col(at), F.lit(EPOCH).cast("timestamp_ntz"))
    if after is not None:
        last = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.where((known < last) | ((known == last) & (F.col(id_) < F.lit(after[1]))))
    newest = [known.desc(), F.col(id_).desc()]
    first = rows.orderBy(*newest).limit(BATCH * MOST_BATCHES)
    # a thousand rows at most from here on
    w = W.orderBy(*newest)
    placed = decide(first.withColumn("_place", F.row_number().over(w)))
    return placed.withColumn("_found", F.count_if(F.coalesce("eligible", F.lit(False))).over(W.orderBy("_place").rowsBetween(W.unboundedPreceding, 0)))


def eligible_page(rows: DataFrame, decide: Callable[[DataFrame], DataFrame], size: int, *, at: str = "published_at", id_: str = "id", after: tuple | None = None) -> DataFrame:
    """O3: of the next thousand rows (newest first, unknown times last) the first `size` that `decide` calls eligible.

    decide keeps the rows and adds `eligible`; it sees a thousand rows, never the table. A page may be short, or empty, and
    still have a cursor: see `eligible_cursor`.
    """
    found = _looked_through(rows, decide, at, id_, after)
    return found.where(F.coalesce("eligible", F.lit(False)) & (F.col("_found") <= size)).orderBy("_place").drop("_place", "_found")


def eligible_cursor(rows: DataFrame, decide: Callable[[DataFrame], DataFrame], size: int, *, at: str = "published_at", id_: str = "id", after: tuple | None = None) -> DataFrame:
    """O3: the cursor (at, id) after that page: of its last row if it is full, else of the last row that was looked at; no row at the end of the table."""
    found = _looked_through(rows, decide, at, id_, after)
    seen = found.agg(
        F.min_by(F.struct(at, id_), F.when(F.col("_found") >= size, F.col("_place"))).alias("full"), F.max_by(F.struct(at, id_), "_place").alias("last"), F.max("_place").alias("n"), F.max("_found").alias("found"), F.min(F.when(F.col("_found") >= size, F.col("_place"))).alias("stop")
    )
    more = (F.col("n") == BATCH * MOST_BATCHES) | (F.col("stop") < F.col("n"))
    where = F.when(F.col("found") >= size, F.col("full")).otherwise(F.col("last"))
    return seen.where(more).select(F.coalesce(where[at], F.lit(EPOCH).cast("timestamp_ntz")).alias("at"), where[id_].alias("id"))
