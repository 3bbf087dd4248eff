"""Deterministic views of the driver's tables as domain relations, in Spark and (SQL text) in DuckDB.

Each adapter has a Spark function and a DuckDB WITH fragment of the same name and columns, so that operators and
oracles start from equal rows. Times are epoch seconds or timestamps without zone; money is decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch(c: str):
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an observation log: late event times and repeating states per user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("canonical_key"), F.col("event_id").alias("obs_seq"), (_epoch("ts") - (F.col("event_id") * 7919 % 11) * 7200).alias("effective_at"),
        F.concat_ws("/", F.when(F.col("event_type").isin("view", "click"), "browse").otherwise(F.col("event_type")), (F.col("event_id") % 2).cast("string")).alias("state_hash"),
        "event_type", F.col("value").cast("decimal(18,2)").alias("value"),
    )


OBSERVATIONS = """observations AS (SELECT user_id AS canonical_key, event_id AS obs_seq, date_diff('second', TIMESTAMP '1970-01-01', ts) - (event_id * 7919 % 11) * 7200 AS effective_at,
  (CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE event_type END) || '/' || CAST(event_id % 2 AS VARCHAR) AS state_hash, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events)"""


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as notices: segment words as titles, nations as regions, some fields unknown."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation is fixed at 25 rows
    k, day = F.col("o_orderkey"), lambda e: F.expr(f"cast(o_orderdate as timestamp_ntz) + make_dt_interval(cast({e} as int))")
    return j.select(
        k.alias("id"), F.col("o_custkey").alias("record_id"), k.alias("version_id"),
        F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" supply and OCR  services")).alias("title"), F.concat(F.lit("priority "), F.lower("o_orderpriority")).alias("body"),
        F.col("c_name").alias("buyer"), F.lower("c_mktsegment").alias("category"),
        F.when(k % 13 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("estimated_amount"), F.when(k % 17 != 0, F.lit("KRW")).alias("currency"),
        F.when(k % 11 != 0, F.array(F.col("n_name"))).alias("regions"), F.when(k % 7 != 0, F.when(k % 3 == 0, F.array(F.lit("ISO 9001"))).otherwise(F.array().cast("array<string>"))).alias("required_certifications"),
        F.when(k % 4 == 0, F.array(F.lit("ocr"), F.lit("Cloud"))).otherwise(F.array().cast("array<string>")).alias("required_capabilities"),
        day("0").alias("published_at"), F.when(k % 5 != 0, day("20 + o_orderkey % 40")).alias("deadline"),
        day("0").alias("effective_at"), day("o_orderkey % 9").alias("observed_at"), day("o_orderkey % 9 + 1").alias("created_at"),
        F.struct(day("30").alias("available_at"), F.when(k % 2 == 0, F.lit(150000).cast("decimal(18,2)")).alias("estimated_amount")).alias("enrichment"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


OPPORTUNITIES = """opportunities AS (SELECT o_orderkey AS id, o_custkey AS record_id, o_orderkey AS version_id,
  upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' supply and OCR  services' AS title, 'priority ' || lower(o_orderpriority) AS body, c_name AS buyer, lower(c_mktsegment) AS category,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS estimated_amount, CASE WHEN o_orderkey % 17 <> 0 THEN 'KRW' END AS currency,
  CASE WHEN o_orderkey % 11 <> 0 THEN [n_name] END AS regions, CASE WHEN o_orderkey % 7 <> 0 THEN (CASE WHEN o_orderkey % 3 = 0 THEN ['ISO 9001'] ELSE CAST([] AS VARCHAR[]) END) END AS required_certifications,
  CASE WHEN o_orderkey % 4 = 0 THEN ['ocr', 'cloud'] ELSE CAST([] AS VARCHAR[]) END AS required_capabilities,
  CAST(o_orderdate AS TIMESTAMP) AS published_at, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(20 + o_orderkey % 40 AS INTEGER)) END AS deadline,
  CAST(o_orderdate AS TIMESTAMP) AS effective_at, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS observed_at, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 9 + 1 AS INTEGER)) AS created_at,
  CAST(o_orderdate AS TIMESTAMP) + to_days(30) AS enriched_at, CASE WHEN o_orderkey % 2 = 0 THEN CAST(150000 AS DECIMAL(18,2)) END AS enriched_amount, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

REGIONS = ["INDIA", "FRANCE", "CHINA", "PERU", "CANADA", "BRAZIL", "NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8", "NATION_13"]
#: Company profiles: id, available_at, regions, certifications, capabilities, industries, minimum, maximum, currency, excluded keywords.
PROFILES = [
    (1, "1995-01-01", ["FRANCE", "GERMANY", "china"], ["ISO 9001"], ["OCR", "cloud migration"], ["building", "Machinery"], "1000", "300000", "KRW", ["furniture  supply"]),
    (2, "1997-06-01", ["JAPAN", "KENYA", "PERU", "EGYPT", "CHINA"], [], ["cloud", "data"], ["household"], "50000", "250000", "KRW", ["automobile supply"]),
    (3, "1999-01-01", REGIONS, ["iso 9001", "ISO 27001"], ["ocr", "cloud"], ["automobile", "building", "household"], None, "200000", "KRW", []),
    (4, "2030-01-01", ["FRANCE"], [], [], [], None, None, None, []),
]
INSTANTS = ["1996-03-01 00:00:00", "1998-02-15 12:00:00", "2000-07-01 06:30:00"]
FIELDS = ("profile_id", "available_at", "regions", "certifications", "capabilities", "industries", "min_contract_amount", "max_contract_amount", "contract_currency", "excluded_keywords")


def profiles(spark: SparkSession) -> DataFrame:
    texts = "array<string>"
    df = spark.createDataFrame(PROFILES, f"profile_id long, available_at string, regions {texts}, certifications {texts}, capabilities {texts}, industries {texts}, min_contract_amount string, max_contract_amount string, contract_currency string, excluded_keywords {texts}")
    return df.withColumns({"available_at": F.col("available_at").cast("timestamp_ntz"), "min_contract_amount": F.col("min_contract_amount").cast("decimal(18,2)"), "max_contract_amount": F.col("max_contract_amount").cast("decimal(18,2)")})


def instants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in INSTANTS], "as_of string").select(F.col("as_of").cast("timestamp_ntz").alias("as_of"))


def _lit(x) -> str:
    return "NULL" if x is None else "[" + ", ".join(f"'{y.lower()}'" for y in x) + "]::VARCHAR[]" if isinstance(x, list) else str(x) if isinstance(x, int) else f"'{x}'"


PROFILES_SQL = "profiles AS (SELECT profile_id, CAST(available_at AS TIMESTAMP) AS available_at, regions, certifications, capabilities, industries, CAST(min_contract_amount AS DECIMAL(18,2)) AS lo, CAST(max_contract_amount AS DECIMAL(18,2)) AS hi, contract_currency AS cur, excluded_keywords AS excluded FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, p)) + ")" for p in PROFILES) + f") t({', '.join(FIELDS)}))"
INSTANTS_SQL = "instants AS (SELECT CAST(as_of AS TIMESTAMP) AS as_of FROM (VALUES " + ", ".join(f"('{x}')" for x in INSTANTS) + ") t(as_of))"
