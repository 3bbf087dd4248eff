"""Eligibility and ranking (D10, D11, D13, F22-F27, P17): three-valued hard rules and a gated decimal score."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.barrier import held
from noticeflow.functions.text import bounded, norm, tokens

#: Feature weights, the recommendation threshold, and the days after which age and deadline count for nothing.
WEIGHTS = {"lexical": "0.25", "capability": "0.25", "category": "0.20", "amount": "0.15", "recency_deadline": "0.15"}
THRESHOLD = "0.60"
RECENCY_DAYS, DEADLINE_DAYS = 30, 45
MONEY = "decimal(20,2)"


def _norms(c: Column) -> Column:
    return F.transform(c, norm)


def eligibility(pairs: DataFrame, *, texts: tuple[str, ...] = ("title",), empty_is_unknown: bool = True) -> DataFrame:
    """D11 over pairs of an opportunity (columns) and a profile (struct p): hard_failures, warnings, eligible, allows_recommendation.

    Opportunity: regions, estimated_amount, currency, required_certifications and text columns; null is unknown, and so
    is an empty list where `empty_is_unknown` (the live claim builder). Profile: regions, certifications,
    min_contract_amount, max_contract_amount, contract_currency, excluded_keywords.
    """
    col = F.col
    seen = lambda c: F.when(F.size(c) > 0, _norms(col(c))) if empty_is_unknown else _norms(col(c))
    # what is compared is folded once per pair, not for every item that it is compared with
    made = {"_nf_regions": seen("regions"), "_nf_required": seen("required_certifications"), "_nf_texts": _norms(F.array(*(F.coalesce(col(t), F.lit("")) for t in texts)))}
    regions, required = col("_nf_regions"), col("_nf_required")
    amount, currency = col("estimated_amount").cast(MONEY), col("currency")
    low, high = col("p.min_contract_amount"), col("p.max_contract_amount")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    bounds = low.isNotNull() | high.isNotNull()
    comparable = bounds & amount.isNotNull() & currency.isNotNull() & col("p.contract_currency").isNotNull()
    same = comparable & (F.upper(currency) == col("p.contract_currency"))
    missing = F.array_except(required, _norms(F.coalesce(col("p.certifications"), F.array().cast("array<string>"))))
    # one reason for each excluded keyword, whatever number of fields match

    def hit(word: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)"))
        # the pattern is compiled for texts that hold the keyword at all
        return F.exists("_nf_texts", lambda x: F.contains(x, word) & F.regexp_like(x, pattern))

    excluded = F.transform(F.filter(_norms(F.coalesce(col("p.excluded_keywords"), F.array().cast("array<string>"))), hit), lambda _: F.lit("explicit_exclusion"))
    hard = F.array_compact(
        F.array(
            F.when(regions.isNotNull() & some("p.regions") & ~F.arrays_overlap(regions, _norms(col("p.regions"))), "region_not_served"),
            F.when(same & (amount < low), "amount_below_minimum"),
            F.when(same & (amount > high), "amount_above_maximum"),
            F.when(required.isNotNull() & (F.size(missing) > 0), "missing_certification"),
        )
    )
    warn = F.array_compact(
        F.array(
            F.when(regions.isNull(), "region_unknown").when(~some("p.regions"), "profile_regions_unknown"),
            F.when(~bounds, None)
            .when(amount.isNull(), "amount_unknown")
            .when(currency.isNull(), "amount_currency_unknown")
            .when(col("p.contract_currency").isNull(), "profile_currency_unknown")
            .when(F.upper(currency) != col("p.contract_currency"), "amount_currency_mismatch"),
            F.when(required.isNull(), "certifications_unknown"),
        )
    )
    out = held(held(pairs, made), {"hard_failures": F.concat(hard, excluded), "warnings": warn}).drop(*made)
    return out.withColumn("eligible", F.size("hard_failures") == 0).withColumn("allows_recommendation", F.col("eligible") & (F.size("warnings") == 0))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a decimal, from whole seconds."""
    return F.timestamp_diff("SECOND", earlier, later).cast("decimal(18,0)") / F.lit(86400).cast("decimal(5,0)")


def ranking(pairs: DataFrame, as_of: str = "as_of") -> DataFrame:
    """D13 over pairs (with eligibility's columns): features, amount_reason, score, deadline_state, recommended.

    Opportunity: title, body, category, required_capabilities, estimated_amount, currency, published_at, deadline. Each
    feature is rounded before it is weighted. A publication after as_of gives a null score (the pair is in error).
    """
    col, zero = F.col, F.lit(0).cast("decimal(10,5)")
    ratio = lambda n, d: n.cast("decimal(10,0)") / d.cast("decimal(10,0)")
    none = F.array().cast("array<string>")
    made = {
        "_nf_interests": F.array_distinct(F.flatten(F.transform(F.concat(F.coalesce(col("p.industries"), none), F.coalesce(col("p.capabilities"), none)), tokens))),
        "_nf_observed": tokens(F.concat_ws(" ", "title", "body", "category")),
        "_nf_owned": F.filter(F.array_distinct(_norms(F.coalesce(col("p.capabilities"), none))), lambda x: x != ""),
        "_nf_stated": F.filter(F.array_distinct(_norms(F.coalesce(col("required_capabilities"), none))), lambda x: x != ""),
        "_nf_shown": norm(F.concat_ws(" ", "title", "body")),
        "_nf_category": norm(col("category")),
    }
    interests, observed, owned, stated, shown = (col(f"_nf_{c}") for c in ("interests", "observed", "owned", "stated", "shown"))
    lexical = F.when(F.size(interests) > 0, ratio(F.size(F.array_intersect(interests, observed)), F.size(interests))).otherwise(zero)
    wanted = F.when(F.size(stated) > 0, stated).otherwise(F.filter(owned, lambda x: F.contains(shown, x)))
    capability = F.when(F.size(wanted) > 0, ratio(F.size(F.array_intersect(wanted, owned)), F.size(wanted))).otherwise(zero)
    category = F.when(F.array_contains(_norms(F.coalesce(col("p.industries"), none)), col("_nf_category")), 1).otherwise(0).cast("decimal(10,5)")
    amount, low, high = col("estimated_amount").cast(MONEY), col("p.min_contract_amount").cast(MONEY), col("p.max_contract_amount").cast(MONEY)
    why = (
        F.when(amount.isNull() | col("currency").isNull(), "amount_unknown")
        .when(col("p.contract_currency").isNull(), "profile_currency_unknown")
        .when(F.upper("currency") != F.upper("p.contract_currency"), "currency_mismatch")
        .when(amount < low, "below_profile_range")
        .when(amount > high, "above_profile_range")
        .otherwise("within_profile_range")
    )
    close = F.lit(1) - F.abs(2 * amount - low - high) / (high - low)
    money = F.when(why != "within_profile_range", zero).when(low.isNull() | high.isNull() | (high <= low), 1).otherwise(F.greatest(zero, close))
    age = days_between(col(as_of), col("published_at"))
    left = days_between(col("deadline"), col(as_of))
    fresh = F.coalesce(F.greatest(zero, F.lit(1) - age / RECENCY_DAYS), zero)
    near = F.coalesce(F.greatest(zero, F.lit(1) - left / DEADLINE_DAYS), zero)
    recency = F.when(col("deadline") < col(as_of), zero).otherwise((fresh + near) / 2)
    out = held(held(pairs, made), {"lexical": bounded(lexical), "capability": bounded(capability), "category_match": bounded(category), "amount_fit": bounded(money), "recency_deadline": bounded(recency), "amount_reason": why}).drop(*made)
    names = {"lexical": "lexical", "capability": "capability", "category": "category_match", "amount": "amount_fit", "recency_deadline": "recency_deadline"}
    total = sum((F.col(names[k]) * F.lit(Decimal(w)) for k, w in WEIGHTS.items()), F.lit(Decimal("0")))
    state = F.when(col("deadline").isNull(), "unknown").when(col("deadline") >= col(as_of), "open").otherwise("expired")
    out = out.withColumn("score", F.when(F.coalesce(col("published_at") <= col(as_of), F.lit(True)), bounded(total))).withColumn("deadline_state", state)
    return out.withColumn("recommended", F.col("allows_recommendation") & (F.col("deadline_state") != "expired") & (F.col("score") >= F.lit(Decimal(THRESHOLD))))
