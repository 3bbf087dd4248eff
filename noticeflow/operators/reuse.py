"""Decisions kept and reused by the fingerprint of their inputs (D8, D12, D14, F38): only what changed is computed.

A store is a Parquet table of runs, each one folder. A run joins the fingerprints of the inputs with those in the store, computes the
rest, and adds it as a new folder; a run that failed left no marker and isn't read. So a run can be repeated at any
time: the second adds nothing. Rows are found by keys and fingerprint, not by which run made them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeflow.functions.text import utc_text
from noticeflow.operators.inbox import daily_epoch


def fingerprint(*inputs: Column) -> Column:
    """SHA-256 of the inputs' canonical JSON: null and absent differ from empty, and order of columns counts."""
    named = F.struct(*(F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("{}")).alias(f"i{i}") for i, c in enumerate(inputs)))
    return F.sha2(F.to_json(named), 256)


class Store:
    """Results by keys and fingerprint, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], stamp: str = "fingerprint"):
        self.spark, self.path, self.keys, self.stamp = spark, path.rstrip("/"), keys, stamp

    def _runs(self) -> list[str]:
        """Folders of runs that ended well, oldest first."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS"))
        return sorted(str(f.getPath().getParent()) for f in found or [])

    def rows(self) -> DataFrame | None:
        """Each result once; null for an empty store. Two runs at the same time may both have made one: the first by run's name stays."""
        runs = self._runs()
        if not runs:
            return None
        return self.spark.read.parquet(*runs).dropDuplicates([*self.keys, self.stamp])

    def _join(self, left: DataFrame, right: DataFrame, how: str, on: list[str]) -> DataFrame:
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        return left.alias("l").join(right.alias("r"), condition, how)

    def materialize(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results for all inputs, with `reused` (found in the store before this run).

        inputs: the keys, the fingerprint, and what compute needs; compute keeps keys and fingerprint. Inputs that repeat a key and
        fingerprint are computed once.
        """
        on = [*self.keys, self.stamp]
        have = self.rows()
        asked = inputs.select(*on).distinct()
        missing = inputs.dropDuplicates(on)
        if have is not None:
            missing = self._join(missing, have.select(*on), "left_anti", on).select("l.*")
        run = f"{self.path}/run-{len(self._runs()):08d}-{uuid.uuid4().hex}"
        compute(missing).write.parquet(run)
        made = self.spark.read.parquet(run).withColumn("reused", F.lit(False))
        if have is None:
            return made
        # rows with null keys meet, too
        old = self._join(have, asked, "left_semi", on).select("l.*").withColumn("reused", F.lit(True))
        return old.unionByName(made)

    def stale(self, inputs: DataFrame) -> DataFrame:
        """Stored results whose keys now have another fingerprint (keys that are no longer asked for aren't stale)."""
        have = self.rows()
        if have is None:
            raise ValueError("the store is empty")
        now = inputs.select(*self.keys, F.col(self.stamp).alias("_now")).distinct()
        same = have.alias("l").join(now.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys])
        return same.groupBy(*(F.col(f"l.{c}").alias(c) for c in have.columns)).agg(F.max(F.col("_now") == F.col(f"l.{self.stamp}")).alias("_fits")).where("not _fits").drop("_fits")


def delta_status(kind: Column, before: Column, ready: Column, stored: Column) -> Column:
    """What became of a version's delta. kind: its transition (null: no such version); before: the version it is compared with;
    ready: both snapshots are; stored: a delta with the same inputs is."""
    return (
        F.when(kind.isNull(), "missing").when(kind == "initial", "initial").when(before.isNull(), "no_predecessor").when(~F.coalesce(ready, F.lit(False)), "pending").when(F.coalesce(stored, F.lit(False)), "existing").otherwise("created")
    )


def comparison_kind(kind: Column) -> Column:
    """How a delta's pair was chosen."""
    return F.when(kind == "current", "current_transition").when(kind == "historical", "historical").otherwise("legacy_unknown")


def comparison_pairs(versions: DataFrame) -> DataFrame:
    """Each version but initial ones with the one that it is compared with: the current one before it, or else the last by number.

    versions: opportunity_id, version_id, version_number, transition_kind, previous_current_version_id.
    """
    before = F.max(F.struct("version_number", "version_id")).over(W.partitionBy("opportunity_id").orderBy("version_number").rangeBetween(W.unboundedPreceding, -1))
    kind = F.col("transition_kind")
    return versions.withColumn("_before", before).where(~kind.eqNullSafe(F.lit("initial"))).select("opportunity_id", "version_id", "version_number", "transition_kind", F.when(kind == "current", F.col("previous_current_version_id")).otherwise(F.col("_before.version_id")).alias("from_version_id"), comparison_kind(kind).alias("comparison_kind"))


def exact_epoch(as_of: Column) -> Column:
    """the epoch of one instant (UTC, ISO 8601 as Python writes it: microseconds only where there are any)."""
    at = as_of.cast("timestamp")
    left = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.concat(F.lit("exact:"), utc_text(at), F.when(left > 0, F.concat(F.lit("."), F.lpad(left.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def ranking_epoch(as_of: Column, asked: Column, deadline_state: Column) -> Column:
    """struct(epoch, error): the asked epoch, a daily one with the deadline's state, or else the exact instant. A daily epoch of another UTC day is an error."""
    daily = F.coalesce(asked.startswith("daily:"), F.lit(False))
    own = daily_epoch(as_of, deadline_state)
    bucket = F.substring_index(asked, ":", 2)
    wrong = daily & (bucket != F.substring_index(own, ":", 2))
    epoch = F.when(wrong, F.lit(None)).when(daily, own).otherwise(F.coalesce(asked, exact_epoch(as_of)))
    return F.struct(epoch.alias("epoch"), F.when(wrong, "epoch_mismatch").alias("error"))


def ranking_error(version: Column, decided_version: Column, normalized: Column, decided_normalized: Column, effective_at: Column, as_of: Column, stale: Column) -> Column:
    """Why a version can't be ranked, or null: the first of stale inputs, another version, another content, not yet in effect."""
    differ = lambda a, b: ~a.eqNullSafe(b)
    return F.when(F.coalesce(stale, F.lit(False)), "stale_eligibility").when(differ(version, decided_version), "other_version").when(differ(normalized, decided_normalized), "stale_provenance").when(effective_at > as_of, "not_available")
