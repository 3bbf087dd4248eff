"""Ingest and version fold (D1, D3, W1, J14, A6): ordered state per key as window frames.

Observations carry an explicit sequence, so ties of event time go to the later observation. Late data is kept
as `historical`; the watermark is per key and never drops a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ingest(raw: DataFrame, keys: list[str], order: str, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key (duplicates by payload), minus keys that `existing` holds. One shuffle by key."""
    first = raw.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return first if existing is None else first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*raw.columns)


def ingest_counters(raw: DataFrame, run: str, keys: list[str], order: str) -> DataFrame:
    """Per run the rows that were new and those that repeated an earlier payload."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return raw.withColumn("_n", n).groupBy(run).agg(F.count_if(F.col("_n") == 1).alias("created"), F.count_if(F.col("_n") > 1).alias("duplicates"))


def version_fold(obs: DataFrame, key: str = "canonical_key", seq: str = "obs_seq", at: str = "effective_at", state: str = "state_hash") -> DataFrame:
    """D3: every observation with is_new, version_number, transition_kind, watermark and the state it left current.

    An observation with the current state makes no version; another is current iff its event time is not before
    the watermark (the greatest event time of those that led so far), else historical; the first is initial.
    The frames share one partitioning by key.
    """
    w = W.partitionBy(key).orderBy(seq)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    mark = F.max(at).over(before)
    lead = mark.isNull() | (F.col(at) >= mark)
    df = obs.withColumn("_lead", lead)
    # a row that isn't ahead may still equal the current state; the current state is the last leading row's
    df = df.withColumn("_current", F.last(F.when(F.col("_lead"), F.col(state)), ignorenulls=True).over(before))
    df = df.withColumn("is_new", F.col("_current").isNull() | (F.col("_current") != F.col(state)))
    df = df.withColumn("version_number", F.when(F.col("is_new"), F.sum(F.col("is_new").cast("int")).over(upto)))
    kind = F.when(~F.col("is_new"), None).when(F.col("_current").isNull(), "initial").when(F.col("_lead"), "current").otherwise("historical")
    return df.withColumn("transition_kind", kind).withColumn("watermark", F.max(at).over(upto)).withColumn("current_state", F.last(F.when(F.col("_lead"), F.col(state)), ignorenulls=True).over(upto)).drop("_lead", "_current")


def predecessors(versions: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Each version with the number and state of the current version it replaced (historical: the one before it)."""
    w = W.partitionBy(key).orderBy("version_number")
    leading = F.last(F.when(F.col("transition_kind") != "historical", F.col("version_number")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return versions.withColumn("predecessor", F.when(F.col("transition_kind") == "historical", F.lag("version_number").over(w)).otherwise(leading))


def current_versions(versions: DataFrame, key: str = "canonical_key") -> DataFrame:
    """The latest version of each key that is not historical."""
    return versions.where("transition_kind <> 'historical'").groupBy(key).agg(F.max_by(F.struct("*"), "version_number").alias("v")).select("v.*")
