"""Notification triggers derived from versions, deltas, rankings and links (D23, D24, P13, J19): what `state.outbox` sends.

Everything is joins on opportunities, versions and users; a trigger's identity is text, so that the outbox sends each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.nested import without
from noticeflow.operators.linking import closure
from noticeflow.operators.state import observed_after_watch

#: Stages of an outcome, fields that decide eligibility, and levels that make a new deadline worth telling.
OUTCOMES = ("award", "opening", "contract")
ELIGIBILITY_FIELDS = ("regions", "required_certifications", "required_capabilities", "participation_constraints", "budget")
TELLING = ("medium", "high")
EVENT = ["user_id", "opportunity_id", "trigger", "identity"]


def _event(df: DataFrame, trigger: str | Column, identity: Column) -> DataFrame:
    return df.select("user_id", "opportunity_id", (F.lit(trigger) if isinstance(trigger, str) else trigger).alias("trigger"), identity.alias("identity"))


def relevant(items: DataFrame, rankings: DataFrame, now: Column) -> DataFrame:
    """new_high_relevance: recommended opportunities that are in effect and no outcome. Told once per canonical key.

    items: opportunity_id, canonical_key, stage, effective_at (of the current version); rankings: user_id, opportunity_id, recommended.
    """
    open_ = items.where((F.col("effective_at") <= now) & ~F.coalesce(F.col("stage").isin(*OUTCOMES), F.lit(False)))
    both = open_.join(rankings.where("recommended").select("user_id", "opportunity_id"), "opportunity_id")
    return _event(both, "new_high_relevance", F.to_json(F.struct("canonical_key")))


def latest_deltas(deltas: DataFrame, current: DataFrame) -> DataFrame:
    """Of each opportunity's current version, the latest revision of its delta from the version before.

    deltas: opportunity_id, delta_id, from_version_id, to_version_id, comparison_kind, created_at, ...; current: opportunity_id, version_id.
    """
    own = deltas.where("comparison_kind = 'current_transition'").join(current.select("opportunity_id", F.col("version_id").alias("to_version_id")), ["opportunity_id", "to_version_id"], "left_semi")
    last = own.groupBy("opportunity_id").agg(F.max(F.struct("created_at", "delta_id"))["delta_id"].alias("delta_id"))
    return own.join(last, ["opportunity_id", "delta_id"], "left_semi")


def change_triggers(fields: Column, documents: Column, impact: Column) -> Column:
    """Which triggers a delta has: fields and documents are JSON objects (changes by field; lists of documents by kind of change)."""
    names = F.coalesce(F.map_keys(F.from_json(fields, "map<string,string>")), F.array().cast("array<string>"))
    lists = F.coalesce(F.map_values(F.from_json(documents, "map<string,string>")), F.array().cast("array<string>"))
    some = F.exists(lists, lambda x: ~F.coalesce(x.isin("[]", "{}", "", "null", "false", "0"), F.lit(True)))
    return F.array_compact(
        F.array(
            F.when((F.size(names) > 0) | some, "watched_material_change"),
            F.when(F.array_contains(names, "closes_at") & impact.isin(*TELLING), "deadline_changed"),
            F.when(F.arrays_overlap(names, F.array(*map(F.lit, ELIGIBILITY_FIELDS))), "eligibility_changed"),
        )
    )


def changes(versions: DataFrame, deltas: DataFrame, watches: DataFrame, now: Column) -> DataFrame:
    """watched_material_change, deadline_changed and eligibility_changed, for watches older than the change.

    versions: the current version of each opportunity (opportunity_id, version_id, transition_kind, transition_at, effective_at); deltas: also
    field_changes and document_changes (JSON), impact_level, reason_codes. Evidence isn't part of an identity: a delta
    whose evidence alone was repaired tells nothing new.
    """
    last = latest_deltas(deltas, versions)
    # the triggers and the identity are made once per delta, before it meets its watchers
    identity = F.concat(
        F.lit('{"documents":'), F.coalesce(without(F.col("document_changes"), "evidence"), F.lit("{}")), F.lit(',"fields":'), F.coalesce(without(F.col("field_changes"), "evidence"), F.lit("{}")),
        F.lit(',"from_version_id":"'), F.col("from_version_id").cast("string"), F.lit('","impact":"'), F.col("impact_level"), F.lit('","reasons":'), F.to_json(F.coalesce("reason_codes", F.array().cast("array<string>"))),
        F.lit(',"to_version_id":"'), F.col("to_version_id").cast("string"), F.lit('"}'),
    )
    told = last.select("opportunity_id", F.col("to_version_id").alias("version_id"), change_triggers(F.col("field_changes"), F.col("document_changes"), F.col("impact_level")).alias("triggers"), identity.alias("identity")).where(F.size("triggers") > 0)
    seen = observed_after_watch(watches, versions.where("transition_kind = 'current'"), now).select("user_id", "opportunity_id", "version_id")
    return seen.join(told, ["opportunity_id", "version_id"]).select("user_id", "opportunity_id", F.explode("triggers").alias("trigger"), "identity")


def fresh_links(links: DataFrame, current: DataFrame) -> DataFrame:
    """Active links between the current versions of both ends: links that await another decision justify nothing.

    links: child, parent, child_version_id, parent_version_id, status; current: opportunity_id, version_id.
    """
    end = lambda side: current.select(F.col("opportunity_id").alias(side), F.col("version_id").alias(f"{side}_version_id"))
    return links.where("status = 'active'").join(end("child"), ["child", "child_version_id"], "left_semi").join(end("parent"), ["parent", "parent_version_id"], "left_semi").select("child", "parent")


def outcomes(items: DataFrame, versions: DataFrame, links: DataFrame, watches: DataFrame, now: Column) -> DataFrame:
    """outcome_published, for who watches the outcome or any of its ancestors since before it was published."""
    published = items.where(F.col("stage").isin(*OUTCOMES)).select(F.col("opportunity_id").alias("outcome_id"), "stage")
    up = closure(fresh_links(links, versions)).select(F.col("node").alias("outcome_id"), F.col("ancestor").alias("opportunity_id"))
    reach = published.join(up, "outcome_id").unionByName(published.withColumn("opportunity_id", F.col("outcome_id")))
    known = versions.where("transition_kind in ('initial', 'current')").where((F.col("transition_at") <= now) & (F.col("effective_at") <= now)).select(F.col("opportunity_id").alias("outcome_id"), "transition_at")
    seen = reach.join(known, "outcome_id").join(watches, "opportunity_id").where("created_at <= transition_at")
    return _event(seen, "outcome_published", F.to_json(F.struct(F.col("outcome_id").cast("string").alias("outcome_id"), "stage")))


def derive(items: DataFrame, versions: DataFrame, deltas: DataFrame, rankings: DataFrame, links: DataFrame, watches: DataFrame, now: Column) -> DataFrame:
    """All triggers, in an order that is the same for the same inputs (seq, for the outbox)."""
    shown = items.join(versions.select("opportunity_id", "effective_at"), "opportunity_id")
    every = relevant(shown, rankings, now).unionByName(changes(versions, deltas, watches, now)).unionByName(outcomes(items, versions, links, watches, now))
    return every.withColumn("seq", F.xxhash64(*EVENT))


def outbox_events(triggers: DataFrame, preferences: DataFrame) -> DataFrame:
    """D25 over derived triggers: events per channel that the preferences allow, each identity once."""
    from noticeflow.operators.state import outbox

    return outbox(triggers, preferences).drop("seq")
