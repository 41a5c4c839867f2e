"""Stand-ins for records made of the driver's star schema, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read

#: What a nation key becomes as a country name, a country code and a region.
COUNTRIES = ["Canada", "usa", "", "Narnia", "gb", "United Kingdom", "", "germany", "Sri Lanka", "fr"]
CODES = ["", "", "", "", "", "gb", "usa", "", "", ""]
REGIONS = ["Ontario", "TX", "al", "", "Essex", "", "zz", "Berlin", "ontario", ""]


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({key} % {len(values)} + 1)::INT]"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier records: some fields blank, some null, by key."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"])
    return joined.select(
        key.alias("seq"),
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("  "), F.regexp_replace("s_name", "#", "  # "), F.lit(" "))).alias("name"),
        F.when(key % 5 == 0, None).otherwise(F.concat((key % 90).cast("string"), F.lit(" Main  St"))).alias("address"),
        F.when(key % 7 == 0, "").otherwise(F.initcap(F.lower("r_name"))).alias("city"),
        _pick(REGIONS, "n_nationkey").alias("region"),
        F.when(key % 4 == 0, "").otherwise(F.lpad(key.cast("string"), 5, "0")).alias("postalCode"),
        _pick(COUNTRIES, "n_nationkey").alias("country"),
        _pick(CODES, "n_nationkey").alias("countryCode"),
        F.when(key % 3 == 0, None).when(key % 11 == 0, "ext").otherwise(F.concat(F.lit("+1 (555) 555-"), F.lpad((key % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.when(key % 9 == 0, F.concat(F.lit("//s"), key.cast("string"), F.lit(".example.com"))).when(key % 2 == 0, F.concat(F.lit("s"), key.cast("string"), F.lit(".example.com"))).alias("website"),
        F.when(key % 6 == 0, F.concat(F.lit("https://list.example.org/"), (key % 40).cast("string"))).alias("sourceUrl"),
        F.when(key % 8 == 0, "abc").when(key % 8 == 1, "").otherwise((F.col("s_acctbal") / 100).cast("string")).alias("lat"),
        F.when(key % 8 < 3, None).otherwise((F.col("s_acctbal") / 50).cast("string")).alias("lng"),
        F.when(key % 10 == 0, None).otherwise(F.lower("r_name")).alias("services"),
    )


SUPPLIERS_SQL = f"""
SELECT s_suppkey AS seq,
  CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE '  ' || replace(s_name, '#', '  # ') || ' ' END AS name,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 90)::VARCHAR || ' Main  St' END AS address,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE ['Africa', 'America', 'Asia', 'Europe', 'Middle East'][(n_regionkey + 1)::INT] END AS city,
  {_sql_pick(REGIONS, "n_nationkey")} AS region,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE lpad(s_suppkey::VARCHAR, 5, '0') END AS postalCode,
  {_sql_pick(COUNTRIES, "n_nationkey")} AS country,
  {_sql_pick(CODES, "n_nationkey")} AS countryCode,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'ext' ELSE '+1 (555) 555-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') END AS phone,
  CASE WHEN s_suppkey % 9 = 0 THEN '//s' || s_suppkey || '.example.com' WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey || '.example.com' END AS website,
  CASE WHEN s_suppkey % 6 = 0 THEN 'https://list.example.org/' || (s_suppkey % 40) END AS sourceUrl,
  CASE WHEN s_suppkey % 8 = 0 THEN 'abc' WHEN s_suppkey % 8 = 1 THEN '' ELSE (s_acctbal / 100)::VARCHAR END AS lat,
  CASE WHEN s_suppkey % 8 < 3 THEN NULL ELSE (s_acctbal / 50)::VARCHAR END AS lng,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE lower(r_name) END AS services
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as value records of their user: a fold by user is an upsert by dedupe_key."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")

    def some(n: int, r: int, value: Column) -> Column:
        return F.when(k % n == r, value).otherwise("")

    return e.select(
        k.alias("seq"), F.sha2(F.col("user_id").cast("string"), 256).alias("dedupe_key"), F.concat(F.lit("User "), k.cast("string")).alias("name"),
        F.concat(F.lit("user "), k.cast("string")).alias("normalized_name"), F.col("event_type").alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in ("XX", "US", "CA", "GB", "XX", "US", "XX")]), (k % 7 + 1).cast("int")).alias("country_code"),
        some(5, 1, F.concat(F.lit("land "), k.cast("string"))).alias("country"), some(7, 2, F.concat(F.lit("city "), k.cast("string"))).alias("city"),
        some(900, 3, F.concat(F.lit("region "), k.cast("string"))).alias("region"), F.lit("").alias("postal_code"),
        some(11, 4, F.concat(F.lit("street "), k.cast("string"))).alias("address"), F.when(k % 3 == 0, F.concat(F.lit("555"), k.cast("string"))).alias("phone"),
        F.when(k % 13 == 0, F.concat(F.lit("https://e"), k.cast("string"))).alias("website"), F.when(k % 4 == 1, F.col("value")).alias("latitude"),
        F.when(k % 400 == 1, F.col("value")).alias("longitude"), F.col("value").alias("confidence_score"),
    )


EVENT_VALUES_SQL = """
SELECT event_id AS seq, sha256(user_id::VARCHAR) AS dedupe_key, 'User ' || event_id AS name, 'user ' || event_id AS normalized_name, event_type AS category,
  ['XX', 'US', 'CA', 'GB', 'XX', 'US', 'XX'][(event_id % 7 + 1)::INT] AS country_code,
  CASE WHEN event_id % 5 = 1 THEN 'land ' || event_id ELSE '' END AS country, CASE WHEN event_id % 7 = 2 THEN 'city ' || event_id ELSE '' END AS city,
  CASE WHEN event_id % 900 = 3 THEN 'region ' || event_id ELSE '' END AS region, '' AS postal_code,
  CASE WHEN event_id % 11 = 4 THEN 'street ' || event_id ELSE '' END AS address, CASE WHEN event_id % 3 = 0 THEN '555' || event_id END AS phone,
  CASE WHEN event_id % 13 = 0 THEN 'https://e' || event_id END AS website, CASE WHEN event_id % 4 = 1 THEN value END AS latitude,
  CASE WHEN event_id % 400 = 1 THEN value END AS longitude, value AS confidence_score
FROM events
"""
