"""What a list and a detail page show (P7, P8, P12, P14, P20, P21, J20, J24, O9, D35): decisions, visits and changes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Views of the inbox, labels of what stands in a decision's way and of decisions, and the fields that a replay may use.
VIEWS = ("all", "strict", "review", "amendment")
WAITING = {"profile_required": "기업 정보 필요", "missing_version": "공고 버전 준비 중", "documents_pending": "문서 처리 중", "future_version": "시행 전 버전"}
LABELS = {"waiting": "판단 대기", "danger": "필수 조건 불일치", "pending": "확인 필요", "success": "필수 조건 충족", "neutral": "참여 비추천"}
FEATURES = ("title", "buyer_name", "procurement_type", "regions", "estimated_amount", "currency", "published_at", "closes_at", "required_certifications", "required_capabilities", "participation_constraints", "description", "lifecycle_stage")


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def in_view(view: str, stage: Column, status: Column, eligible: Column, hard: Column, warnings: Column) -> Column:
    """Whether an item belongs to a view. Items without a decision (null eligible) are for review."""
    ready = F.coalesce(status == "ready", F.lit(False)) & eligible.isNotNull()
    if view == "all":
        return F.lit(True)
    if view == "amendment":
        return F.coalesce(stage == "amendment", F.lit(False))
    if view == "strict":
        return ready & F.coalesce(eligible, F.lit(False)) & ~_some(hard) & ~_some(warnings)
    if view == "review":
        return ~ready | (~_some(hard) & (_some(warnings) | ~F.coalesce(eligible, F.lit(False))))
    raise ValueError(f"views are {', '.join(VIEWS)}")


def label(status: Column, eligible: Column, hard: Column, warnings: Column) -> Column:
    """struct(tone, label) of a decision, or of what it waits for."""
    said = lambda tone, text: F.struct(F.lit(tone).alias("tone"), (F.lit(text) if isinstance(text, str) else text).alias("label"))
    waits = F.lit(LABELS["waiting"])
    for key, text in WAITING.items():
        waits = F.when(status == key, text).otherwise(waits)
    open_ = ~F.coalesce(status == "ready", F.lit(False))
    return (
        F.when(open_, said("pending", waits)).when(eligible.isNull(), said("pending", LABELS["waiting"])).when(_some(hard), said("danger", LABELS["danger"])).when(_some(warnings), said("pending", LABELS["pending"]))
        .when(eligible, said("success", LABELS["success"])).otherwise(said("neutral", LABELS["neutral"]))
    )


def visit_state(changed_at: Column, visited_at: Column) -> Column:
    """New (never visited), changed (since the last visit) or null."""
    return F.when(visited_at.isNull(), "new").when(changed_at > visited_at, "changed")


def watched(items: DataFrame, watches: DataFrame) -> DataFrame:
    """Each user's watched opportunities. items: opportunity_id; watches: user_id, opportunity_id, created_at."""
    return watches.join(items, "opportunity_id")


def inbox(items: DataFrame, decisions: DataFrame, visits: DataFrame, view: str = "all") -> DataFrame:
    """Every user's list in a view: items with decision, label and visit state.

    items: opportunity_id, stage, changed_at, ...; decisions: user_id, opportunity_id, status, eligible, hard_failures, warnings; visits: user_id,
    opportunity_id, visited_at. Repeated visits count as the last. Joined by keys; nothing is sent whole.
    """
    last = visits.groupBy("user_id", "opportunity_id").agg(F.max("visited_at").alias("visited_at"))
    both = decisions.join(items, "opportunity_id").join(last, ["user_id", "opportunity_id"], "left")
    d = [F.col(c) for c in ("status", "eligible", "hard_failures", "warnings")]
    said = label(*d)
    return both.where(in_view(view, F.col("stage"), *d)).withColumns({"tone": said["tone"], "label": said["label"], "visit": visit_state(F.col("changed_at"), F.col("visited_at"))})


def numbered(rows: DataFrame, item: str, *order: Column) -> DataFrame:
    """The rows of each item with their place (from 1): versions newest first, links by creation, documents by id."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(item).orderBy(*order)).cast("long"))


def detail(items: DataFrame, versions: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per shown thing of an item: (opportunity_id, kind, position, id), in the order in which a page shows them.

    versions: opportunity_id, version_id, version_number; links: opportunity_id, link_id, created_at; documents: opportunity_id, version_id (the one
    they belong to), document_id. Only documents of the item's current version (current_version_id of items) are shown.
    """
    shown = documents.join(items.select("opportunity_id", F.col("current_version_id").alias("version_id")), ["opportunity_id", "version_id"], "left_semi")
    kind = lambda rows, name, id_: rows.select("opportunity_id", F.lit(name).alias("kind"), "position", F.col(id_).alias("id"))
    v = kind(numbered(versions, "opportunity_id", F.desc("version_number"), F.desc("version_id")), "version", "version_id")
    k = kind(numbered(links, "opportunity_id", F.col("created_at"), F.col("link_id")), "link", "link_id")
    return v.unionByName(k).unionByName(kind(numbered(shown, "opportunity_id", F.col("document_id")), "document", "document_id"))


def delta_rows(deltas: DataFrame, key: str, changes: str) -> DataFrame:
    """P20: a delta's field changes (a JSON object) as rows: key, field, before, after (JSON text; null where there is no record)."""
    each = deltas.select(key, F.explode(F.from_json(changes, "map<string,string>")).alias("field", "change"))
    part = lambda *names: F.coalesce(*(F.get_json_object("change", f"$.{n}") for n in names))
    return each.select(key, "field", part("before", "removed").alias("before"), part("after", "added").alias("after"))


def evidence_rows(claims: DataFrame, key: str, evidence: str) -> DataFrame:
    """P20: evidence (a JSON object of lists, or single entries, by field) as rows: key, field, quote, page, sha256, source."""
    each = claims.select(key, F.explode(F.from_json(evidence, "map<string,string>")).alias("field", "entries"))
    listed = F.when(F.col("entries").startswith("["), F.from_json("entries", "array<string>")).otherwise(F.array("entries"))
    get = lambda *names: F.coalesce(*(F.get_json_object("entry", f"$.{n}") for n in names))
    return each.select(key, "field", F.explode(listed).alias("entry")).select(key, "field", get("quote").alias("quote"), get("page_number", "page").alias("page"), get("attachment_sha256", "sha256").alias("sha256"), get("source", "source_record_id").alias("source"))


def features_only(fields: Column, allowed: tuple[str, ...] = FEATURES) -> Column:
    """Of a map of fields those that a replay may use: what came out of a tender is never among them."""
    return F.map_filter(fields, lambda k, _: k.isin(*allowed))


def same_generation(a: Column, b: Column) -> Column:
    """Equal generations; two unknown ones are equal, too."""
    return a.eqNullSafe(b)


def names_record(payload: Column, record_id: Column, path: str = "$.raw_record_id") -> Column:
    """Whether a job's payload names a record."""
    return F.coalesce(F.get_json_object(payload, path) == record_id.cast("string"), F.lit(False))


def notification_sources(events: DataFrame, items: DataFrame, versions: DataFrame, raw: DataFrame) -> DataFrame:
    """Notifications with the opportunity, its current version and the raw record that it came from."""
    return events.join(items, "opportunity_id").join(versions, F.col("current_version_id") == F.col("version_id")).join(raw, "raw_record_id")
