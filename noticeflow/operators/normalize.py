"""Normalisation of raw payloads with rejections as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.barrier import held
from noticeflow.functions.text import clean_list, decimal_text, zoned_instant

#: Fields that a notice must state, and its payload's schema.
REQUIRED = ("title", "buyer_name", "lifecycle_stage")
INSTANTS = ("published_at", "closes_at", "effective_at")
LISTS = ("regions", "required_certifications", "required_capabilities", "participation_constraints")
PAYLOAD = (
    "title string, buyer_name string, lifecycle_stage string, procurement_type string, estimated_amount string, currency string, published_at string, closes_at string, effective_at string, status string, "
    "regions array<string>, required_certifications array<string>, required_capabilities array<string>, participation_constraints array<string>, contract_period string, "
    "official_references array<struct<source_id: bigint, source_record_id: string, lifecycle_stage: string>>, normalized_identifiers array<struct<scheme: string, value: string>>, canonical_identity string"
)


def normalize(raw: DataFrame) -> DataFrame:
    """raw(obs_seq, source_id, source_record_id, fetched_at, source_updated_at, payload) as typed rows with errors.

    Missing or blank required text, times without a zone and amounts that aren't numbers are errors, never failures
    of the job; a null currency with an amount is one, too, and a missing one is KRW. effective_at falls back to
    the source's update, the publication and the fetch. The hash covers the normalised claims only.
    """
    p = held(raw, {"p": F.from_json("payload", PAYLOAD), "_currency_null": F.col("payload").rlike(r'"currency"\s*:\s*null')})
    text = {c: F.nullif(F.trim(F.col(f"p.{c}")), F.lit("")) for c in (*REQUIRED, "procurement_type", "status", "contract_period")}
    amount = F.col("p.estimated_amount").try_cast("decimal(38,6)")
    times = {c: zoned_instant(F.col(f"p.{c}")) for c in INSTANTS}
    errors = [F.when(F.col("p").isNull(), "payload_invalid"), *(F.when(text[c].isNull(), f"{c}_missing") for c in REQUIRED)]
    errors += [F.when(F.col(f"p.{c}").isNotNull() & times[c].isNull(), f"{c}_not_zoned") for c in INSTANTS]
    errors += [F.when(F.col("p.estimated_amount").isNotNull() & amount.isNull(), "estimated_amount_invalid"), F.when(F.col("_currency_null"), "currency_null")]
    out = p.select(
        *(c for c in raw.columns if c != "payload"), *(v.alias(c) for c, v in text.items()), amount.alias("estimated_amount"), F.coalesce(F.upper("p.currency"), F.lit("KRW")).alias("currency"),
        *(times[c].alias(c) for c in INSTANTS if c != "effective_at"), F.coalesce(times["effective_at"], "source_updated_at", times["published_at"], "fetched_at").alias("effective_at"),
        *(clean_list(F.col(f"p.{c}")).alias(c) for c in LISTS), "p.official_references", "p.normalized_identifiers",
        F.concat(F.col("source_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("p.canonical_identity", F.col("source_record_id")), 256)).alias("canonical_key"), F.array_compact(F.array(*errors)).alias("errors"),
    )
    shown = [F.coalesce(c, F.lit("\u0000")) for c in (F.col("title"), F.col("buyer_name"), F.col("lifecycle_stage"), F.col("procurement_type"), decimal_text(F.col("estimated_amount")), F.col("currency"), F.col("status"), F.col("contract_period"), *(F.col(c).cast("string") for c in ("published_at", "closes_at")), *(F.to_json(c) for c in LISTS), F.to_json("official_references"), F.to_json("normalized_identifiers"))]
    made = {c: F.col(c) for c in out.columns if c not in raw.columns}
    return held(out, made | {"normalized_sha256": F.sha2(F.concat_ws("\u001f", *shown), 256)})


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") == 0)


def quarantined(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") > 0)


def profile_errors(df: DataFrame) -> DataFrame:
    """Profiles with upper-cased currency and the rules that they break."""
    fold = lambda c: F.transform(c, lambda x: F.lower(F.regexp_replace(F.trim(x), r"(?U)\s+", " ")))
    repeated = lambda c: F.size(F.array_distinct(fold(F.col(c)))) < F.size(c)
    low, high = F.col("min_contract_amount"), F.col("max_contract_amount")
    errors = [F.when(repeated(c), f"{c}_repeated") for c in ("regions", "certifications", "industries", "capabilities")]
    errors += [F.when(low > high, "amounts_inverted"), F.when((low.isNotNull() | high.isNotNull()) & F.col("contract_currency").isNull(), "currency_required")]
    return df.withColumn("contract_currency", F.upper("contract_currency")).withColumn("errors", F.array_compact(F.array(*errors)))


def map_government(payload: Column) -> Column:
    """The government feed's fields by their canonical names (local times are Korean)."""
    get = lambda k: F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit(""))
    local = lambda k: F.concat(F.replace(get(k), F.lit(" "), F.lit("T")), F.lit("+09:00"))
    stage = F.when(F.contains(F.coalesce(get("ntceKindNm"), F.lit("")), F.lit("변경공고")), "amendment").otherwise("tender")
    return F.to_json(F.struct(get("bidNtceNm").alias("title"), F.coalesce(get("dminsttNm"), get("ntceInsttNm")).alias("buyer_name"), stage.alias("lifecycle_stage"), get("presmptPrce").alias("estimated_amount"), local("bidNtceDt").alias("published_at"), local("bidClseDt").alias("closes_at")))
