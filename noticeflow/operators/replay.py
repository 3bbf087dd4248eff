"""Bitemporal replay (D32, J15, J16, W6, O7): what could be known at an instant, decided and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.decisions import eligibility, ranking


def visible_versions(events: DataFrame, instants: DataFrame) -> DataFrame:
    """For each instant (as_of) the newest version per record whose effective, observed and created times had passed.

    `instants` are the stated query points, a handful of rows, and are broadcast. The choice is a partial aggregate
    (greatest of a struct), so it needs one narrow shuffle and no sort.
    """
    seen = events.join(F.broadcast(instants), F.greatest("effective_at", "observed_at", "created_at") <= F.col("as_of"))
    newest = F.max(F.struct("effective_at", "observed_at", "created_at", "version_id", *[c for c in events.columns if c not in ("effective_at", "observed_at", "created_at", "version_id", "record_id")]))
    return seen.groupBy("as_of", "record_id").agg(newest.alias("v")).select("as_of", "record_id", "v.*")


def enriched(versions: DataFrame, fields: list[str]) -> DataFrame:
    """An enrichment struct that was available by then overrides the fields that it states."""
    ready = F.coalesce(F.col("enrichment.available_at") <= F.col("as_of"), F.lit(False))
    return versions.withColumns({f: F.when(ready, F.coalesce(F.col(f"enrichment.{f}"), F.col(f))).otherwise(F.col(f)) for f in fields})


def profile_at(profiles: DataFrame, instants: DataFrame) -> DataFrame:
    """For each instant the profile with the latest (available_at, id) by then, as struct p. The stated instants are broadcast, not the profiles' versions."""
    ready = profiles.join(F.broadcast(instants), F.col("available_at") <= F.col("as_of"))
    return ready.groupBy("as_of").agg(F.max_by(F.struct(*[c for c in profiles.columns if c not in ("as_of",)]), F.struct("available_at", "profile_id")).alias("p"))


def replay(events: DataFrame, profiles: DataFrame, instants: DataFrame, *, texts: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """Decisions per instant and record with position (O7) among the hard-gated, by score and record."""
    pairs = visible_versions(events, instants).join(F.broadcast(profile_at(profiles, instants)), "as_of")
    return ranking(eligibility(pairs, texts=texts, empty_is_unknown=False))
