"""Small rules around lists, workers and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error classes that may be shown; all others read ProcessingError.
SAFE_ERRORS = ("TimeoutError", "ConnectTimeout", "ReadTimeout", "HTTPStatusError", "MalformedJobError", "ValidationError", "NotificationDeliveryError", "OperationalError", "ConnectionError")


def latest_success(runs: DataFrame, source: str, status: str, finished_at: str, id_: str) -> DataFrame:
    """Per source its latest successful run; ids break ties. Sources without one give no row."""
    return runs.where(F.col(status) == "success").groupBy(source).agg(F.max(F.struct(finished_at, id_)).alias("_last")).select(source, f"_last.{finished_at}", f"_last.{id_}")


def currency_buckets(items: DataFrame, position: str, currency: str = "currency", amount: str = "amount") -> DataFrame:
    """Items with `bucket`, the position where their currency was first seen beside a known amount; null where the amount is unknown.

    Firsts are counted per currency before they meet the rows, so a currency of most rows is no group. Order by
    bucket (nulls last), amount descending.
    """
    firsts = items.where(F.col(amount).isNotNull()).groupBy(F.col(currency).alias("_currency")).agg(F.min(position).alias("_first"))
    both = items.join(firsts, F.col(currency).eqNullSafe(F.col("_currency")), "left")
    return both.withColumn("bucket", F.when(F.col(amount).isNotNull(), F.col("_first"))).drop("_currency", "_first")


def due(events: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Unsent notifications whose time has come; those never tried first, then the longest due, then by id."""
    ready = F.col("status").isin("pending", "sending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return events.where(ready).orderBy(F.asc_nulls_first("next_attempt_at"), "id").limit(limit)


def append_page(have: DataFrame, page: DataFrame, id_: str = "id") -> DataFrame:
    """U4: a page added to what is there; a row of an id that is there already is left out."""
    return have.unionByName(page.join(have.select(id_), id_, "left_anti").select(*have.columns).dropDuplicates([id_]))


def public_error(error: Column) -> Column:
    """The error's class if it may be shown."""
    return F.when(error.isin(*SAFE_ERRORS), error).otherwise(F.lit("ProcessingError"))


def file_name(name: Column) -> Column:
    """the last path part with all but letters, digits and ._()- replaced, without dots and underscores at its ends."""
    leaf = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.btrim(F.regexp_replace(leaf, r"[^\p{L}\p{N}_.()-]+", "_"), F.lit("._"))
    return F.substring(F.when(clean == "", "attachment").otherwise(clean), 1, 255)


def heartbeat(line: Column) -> Column:
    """completed, failed, retried and ongoing of a worker's heartbeat; null unless all four are there. The last of each counts."""
    last = lambda k: F.try_element_at(F.regexp_extract_all(line, F.lit(rf"\bj_{k}=(\d+)\b")), F.lit(-1)).cast("long")
    complete, failed, retried, ongoing = map(last, ("complete", "failed", "retried", "ongoing"))
    whole = complete.isNotNull() & failed.isNotNull() & retried.isNotNull() & ongoing.isNotNull()
    return F.when(whole, F.struct(complete.alias("completed"), failed.alias("failed"), retried.alias("retried"), ongoing.alias("ongoing")))


def split_pages(text: Column, expected: Column) -> Column:
    """trimmed pages of recognised text, cut at form feeds; a blank last one doesn't count. Null if their number isn't the expected one."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = F.transform(F.split(text, "\f"), trim)
    pages = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(pages) == expected, pages)


def daily_epoch(as_of: Column, deadline_state: Column) -> Column:
    """the evaluation epoch of a day (UTC, whatever the session's zone) and the deadline's state.

    A plain timestamp is an instant; one without a zone is taken as UTC.
    """
    instant = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(as_of.cast("timestamp")) / 86400).cast("int"))
    day = F.when(F.typeof(as_of) == "timestamp_ntz", F.to_date(as_of)).otherwise(instant).cast("string")
    return F.concat(F.lit("daily:"), day, F.lit(":"), deadline_state)
