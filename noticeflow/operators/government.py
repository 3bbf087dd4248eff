"""The government feed's notices by canonical names (P2, F9, F11, F12), with what is wrong about them as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.barrier import held
from noticeflow.functions.text import decimal_text

#: The feed's fields by canonical name, its scheme and normaliser, how it writes times, its zone, and most attachments of a notice.
FIELDS = {"title": "bidNtceNm", "buyer_name": "dminsttNm", "estimated_amount": "presmptPrce", "published_at": "bidNtceDt", "closes_at": "bidClseDt", "status": "ntceKindNm"}
OTHER_BUYER, NUMBER, ORDER, CHANGED, REGISTERED = "ntceInsttNm", "bidNtceNo", "bidNtceOrd", "chgDt", "rgstDt"
SCHEME, NORMALIZER, AMENDED = "koneps-service-notice", "koneps-services-v1", "변경공고"
ZONE, MOST_ATTACHMENTS = "+09:00", 10
URL, FILE = "ntceSpecDocUrl", "ntceSpecFileNm"

_ALL = (*FIELDS.values(), OTHER_BUYER, NUMBER, ORDER, CHANGED, REGISTERED, *(f"{x}{i}" for i in range(1, MOST_ATTACHMENTS + 1) for x in (URL, FILE)))
_SCHEMA = ", ".join(f"{f} string" for f in _ALL)


def official_id(number: Column, order: Column) -> Column:
    """a service notice's identity; null if its number or order isn't one."""
    fine = number.rlike(r"^[A-Za-z0-9-]{1,40}$") & order.rlike(r"^[0-9]{3}$")
    return F.when(fine, F.concat(F.lit("services:"), number, F.lit(":"), order))


def incomplete(items: Column, required: tuple[str, ...]) -> Column:
    """whether any struct of a list lacks a required text; null lists are fine."""
    blank = lambda x: reduce(lambda a, b: a | b, (F.trim(F.coalesce(x[k].cast("string"), F.lit(""))) == "" for k in required))
    return F.coalesce(F.exists(items, lambda x: x.isNull() | blank(x)), F.lit(False))


def map_notices(raw: DataFrame, payload: str = "payload", record_id: str | None = None) -> DataFrame:
    """Raw rows with official_id, the canonical fields, attachments (at most ten: id, filename, url), evidence (pointer by field) and errors.

    Times are the feed's local ones, given as instants; one that isn't written its way is an error, and so is an amount that is
    negative or no number. effective_at is the time of the change, of the registration or of the publication. The buyer is who
    needs the service, else who announces it. record_id: a column that must be the identity. Blank values are unknown.
    """
    read = held(raw, {"_p": F.from_json(payload, _SCHEMA)})
    get = lambda f: F.nullif(F.trim(F.col(f"_p.{f}")), F.lit(""))
    at = lambda f: F.when(get(f).rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(F.concat(get(f), F.lit(ZONE))))
    amount = get(FIELDS["estimated_amount"]).try_cast("decimal(38,6)")
    own = get(FIELDS["buyer_name"])
    identity = official_id(get(NUMBER), get(ORDER))
    files = F.array_compact(F.array(*(F.when(get(f"{URL}{i}").isNotNull(), F.struct(F.sha2(get(f"{URL}{i}"), 256).alias("attachment_id"), F.coalesce(get(f"{FILE}{i}"), F.lit(f"specification-{i}")).alias("filename"), get(f"{URL}{i}").alias("url"))) for i in range(1, MOST_ATTACHMENTS + 1))))
    pointer = lambda name, f: F.when(get(f).isNotNull(), F.struct(F.lit(name).alias("field"), F.lit(f"/{f}").alias("json_pointer")))
    pointers = [pointer(k, f) for k, f in FIELDS.items() if k != "buyer_name"] + [F.coalesce(pointer("buyer_name", FIELDS["buyer_name"]), pointer("buyer_name", OTHER_BUYER)), pointer("currency", FIELDS["estimated_amount"])]
    late = lambda f: get(f).isNotNull() & at(f).isNull()
    errors = [
        F.when(F.col("_p").isNull(), "payload_invalid"), F.when(identity.isNull(), "identity_invalid"), *([F.when(identity.isNotNull() & (identity != F.col(record_id)), "identity_differs")] if record_id else []),
        *(F.when(late(FIELDS[k]), f"{k}_invalid") for k in ("published_at", "closes_at")), F.when(late(CHANGED) | late(REGISTERED), "effective_at_invalid"), F.when(get(FIELDS["estimated_amount"]).isNotNull() & ~F.coalesce(amount >= 0, F.lit(False)), "estimated_amount_invalid"),
    ]
    made = {
        "official_id": identity, "title": get(FIELDS["title"]), "buyer_name": F.coalesce(own, get(OTHER_BUYER)), "status": get(FIELDS["status"]), "lifecycle_stage": F.when(get(FIELDS["status"]) == AMENDED, "amendment").otherwise("tender"),
        "procurement_type": F.lit("services"), "currency": F.lit("KRW"), "estimated_amount": F.when(amount >= 0, decimal_text(amount)), "published_at": at(FIELDS["published_at"]), "closes_at": at(FIELDS["closes_at"]),
        "effective_at": F.coalesce(at(CHANGED), at(REGISTERED), at(FIELDS["published_at"])), "canonical_identity": F.concat(F.lit("services:"), get(NUMBER)), "normalized_identifiers": F.array(F.struct(F.lit(SCHEME).alias("scheme"), get(NUMBER).alias("value"))),
        "attachments": files, "evidence": F.map_from_entries(F.transform(F.array_compact(F.array(*pointers)), lambda p: F.struct(p["field"], F.struct(F.lit("raw").alias("kind"), p["json_pointer"].alias("json_pointer"), F.lit(NORMALIZER).alias("normalizer"))))), "errors": F.array_compact(F.array(*errors)),
    }
    return held(read, made).drop("_p")
