"""Change detection and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.barrier import held
from noticeflow.functions.text import clean_list, decimal_text

#: Impact levels in order, and fields whose claims are sets.
LEVELS = ("low", "medium", "high")
SETS = ("regions", "required_certifications", "required_capabilities", "participation_constraints")


def claim(raw: Column, extracted: Column, normalized: Column | None = None) -> Column:
    """The raw claim if there is one (its normalised value), else the attachment's, else unknown."""
    return F.when(raw.isNotNull(), raw if normalized is None else normalized).otherwise(extracted)


def budget(amount: Column, currency: Column) -> Column:
    """Amount and currency together, or nothing; amounts compare as canonical decimal text."""
    return F.when(amount.isNotNull() & currency.isNotNull(), F.struct(amount.cast("decimal(38,6)").alias("amount"), decimal_text(amount).alias("text"), currency.alias("currency")))


def _reason(when: Column, code: str | Column, level: int) -> Column:
    return F.when(when, F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(level).alias("level")))


def _known(field: str, a: Column, b: Column) -> list[Column]:
    return [_reason(a.isNotNull() & b.isNull(), f"{field}_became_unknown", 1), _reason(a.isNull() & b.isNotNull(), f"{field}_became_known", 1)]


def compute_delta(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Pairs with changed_fields (sorted), reason_codes (sorted, distinct) and impact.

    before and after are structs with amount, currency, closes_at (instant or comparable), regions,
    required_certifications, required_capabilities, participation_constraints, contract_period; null is unknown, and
    an empty list is a known claim. Sets compare without order, money as decimals, both parts together.
    """
    get = lambda side, f: F.col(f"{side}.{f}")
    fields, reasons = [], []
    b, a = budget(get(before, "amount"), get(before, "currency")), budget(get(after, "amount"), get(after, "currency"))
    changed = ~(b["text"].eqNullSafe(a["text"]) & b["currency"].eqNullSafe(a["currency"]))
    fields.append(F.when(changed, F.lit("budget")))
    both = b.isNotNull() & a.isNotNull()
    reasons += _known("budget", b, a) + [
        _reason(both & (b["currency"] != a["currency"]), "budget_currency_changed", 1),
        _reason(both & (b["currency"] == a["currency"]) & (a["amount"] > b["amount"]), "budget_increased", 1),
        _reason(both & (b["currency"] == a["currency"]) & (a["amount"] < b["amount"]), "budget_decreased", 1),
    ]
    b, a = get(before, "closes_at"), get(after, "closes_at")
    fields.append(F.when(~b.eqNullSafe(a), F.lit("closes_at")))
    reasons += _known("closes_at", b, a) + [_reason(a < b, "deadline_earlier", 2), _reason(a > b, "deadline_later", 1)]
    for field in SETS:
        b, a = clean_list(get(before, field)), clean_list(get(after, field))
        fields.append(F.when(~b.eqNullSafe(a), F.lit(field)))
        reasons += _known(field, b, a)
        both, differ = b.isNotNull() & a.isNotNull(), b != a
        if field == "regions":
            kind = F.when(F.size(b) == 0, "added").when(F.size(a) == 0, "removed").otherwise("changed")
            reasons += [_reason(both & differ & (kind == "removed"), "region_restriction_removed", 1), _reason(both & differ & (kind != "removed"), F.concat(F.lit("region_restriction_"), kind), 2)]
        elif field == "participation_constraints":
            reasons.append(_reason(both & differ, "material_clause_changed", 2))
        else:
            prefix = "certification" if field == "required_certifications" else "capability"
            reasons += [_reason(both & (F.size(F.array_except(a, b)) > 0), f"{prefix}_added", 2), _reason(both & (F.size(F.array_except(b, a)) > 0), f"{prefix}_removed", 1)]
    b, a = get(before, "contract_period"), get(after, "contract_period")
    fields.append(F.when(~b.eqNullSafe(a), F.lit("contract_period")))
    reasons += _known("contract_period", b, a) + [_reason(a != b, "contract_period_changed", 1)]
    return with_impact(held(pairs, {"changed_fields": F.array_sort(F.array_compact(F.array(*fields))), "_reasons": F.array_compact(F.array(*reasons))}))


def with_impact(df: DataFrame) -> DataFrame:
    """Sorted distinct reason codes, and the greatest level among them; _reasons: array<struct<code, level>>."""
    level = F.coalesce(F.array_max(F.transform("_reasons", lambda r: r["level"])), F.lit(0))
    return df.withColumn("reason_codes", F.array_sort(F.array_distinct(F.transform("_reasons", lambda r: r["code"])))).withColumn("impact", F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)).drop("_reasons")


def manifest_diff(before: DataFrame, after: DataFrame, keys: list[str], digest: str = "sha256", complete: bool = True) -> DataFrame:
    """Attachments added, removed or replaced (other digest); a null digest makes no claim.

    complete: both manifests are; otherwise nothing is said to be added or removed.
    """
    b = before.select(*keys, F.col(digest).alias("before_digest"), F.lit(1).alias("_b"))
    a = after.select(*keys, F.col(digest).alias("after_digest"), F.lit(1).alias("_a"))
    both = b.join(a, keys, "full")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("before_digest") != F.col("after_digest"), "replaced")
    out = both.withColumn("change", kind).where("change is not null")
    if not complete:
        out = out.where("change = 'replaced'")
    return out.withColumn("level", F.when(F.col("change") == "added", 0).otherwise(1)).drop("_b", "_a")
