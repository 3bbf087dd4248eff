"""The published CPU scope as one plan: normalise, decide and rank generated records, and a delta for every tenth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators.decisions import eligibility, ranking
from noticeflow.operators.delta import compute_delta
from noticeflow.operators.normalize import accepted, normalize
from noticeflow.sources.synthetic import synthetic_records


def payloads(spark: SparkSession, n: int) -> DataFrame:
    """Generated records as raw rows with JSON payloads."""
    r = synthetic_records(spark, n)
    payload = F.to_json(F.struct(F.concat(F.lit("Cloud platform "), F.col("i").cast("string")).alias("title"), "buyer_name", F.lit("tender").alias("lifecycle_stage"), F.lit("services").alias("procurement_type"), F.col("estimated_amount").cast("string").alias("estimated_amount"), F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("published_at"), F.lit("2026-10-30T09:00:00Z").alias("closes_at"), "regions", F.array(F.lit("ISO 27001")).alias("required_certifications"), F.array(F.lit("cloud")).alias("required_capabilities")))
    at = F.col("published_at").cast("timestamp")
    return r.select(F.col("i").alias("obs_seq"), F.lit(1).cast("long").alias("source_id"), F.col("record_id").alias("source_record_id"), at.alias("fetched_at"), at.alias("source_updated_at"), payload.alias("payload"))


def decide_records(spark: SparkSession, n: int) -> DataFrame:
    good = accepted(normalize(payloads(spark, n)))
    texts = lambda *x: F.array(*map(F.lit, x))
    money = lambda x: F.lit(x).cast("decimal(18,2)")
    p = F.struct(texts("Seoul").alias("regions"), texts("ISO 27001").alias("certifications"), money(60_000_000).alias("min_contract_amount"), money(300_000_000).alias("max_contract_amount"), F.lit("KRW").alias("contract_currency"), texts("gambling").alias("excluded_keywords"), texts("services").alias("industries"), texts("cloud", "ocr").alias("capabilities"))
    pairs = good.withColumns({"p": p, "body": F.lit(""), "category": F.col("procurement_type"), "deadline": F.col("closes_at"), "as_of": F.lit("2026-10-01 00:00:00").cast("timestamp")})
    decided = ranking(eligibility(pairs))
    snap = lambda k: F.struct(*(F.lit(None).cast(t).alias(f) if f not in ("amount",) else (F.col("estimated_amount") + k).alias("amount") for f, t in (("amount", ""), ("contract_period", "string"), ("participation_constraints", "array<string>"))), "currency", "closes_at", "regions", "required_certifications", "required_capabilities")
    tenth = compute_delta(good.where("obs_seq % 10 = 0").select("obs_seq", snap(0).alias("before"), snap(1).alias("after"))).select("obs_seq", F.lit("delta").alias("kind"), F.col("impact").alias("result"))
    return decided.select("obs_seq", F.lit("decision").alias("kind"), F.concat_ws("|", F.col("score").cast("string"), F.col("recommended").cast("string"), F.array_join("hard_failures", ","))).toDF("obs_seq", "kind", "result").unionByName(tenth)
