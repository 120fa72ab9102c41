"""The generic tables in the catalog's roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How part types stand for sports in these queries: by the remainder of the key, the last for none.
SPORT_WORDS = ("Running", " cycling ", "Swimming", "Tri-athlon", "Multi Sport", "walking", "athletics", "")


def parts(spark, sf_dir) -> DataFrame:
    """p_partkey, sport_text, category_text."""
    words = F.array(*[F.lit(w) for w in SPORT_WORDS])
    word = F.get(words, F.pmod(F.col("p_partkey"), F.lit(len(SPORT_WORDS))).cast("int"))
    category = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 7 == 0, F.lit(" Kids Race ")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" K")))
    return table(spark, sf_dir, "part").select("p_partkey", word.alias("sport_text"), category.alias("category_text"))


PARTS_SQL = """parts AS (
  SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Running' WHEN 1 THEN ' cycling ' WHEN 2 THEN 'Swimming' WHEN 3 THEN 'Tri-athlon'
           WHEN 4 THEN 'Multi Sport' WHEN 5 THEN 'walking' WHEN 6 THEN 'athletics' ELSE '' END AS sport_text,
         CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN ' Kids Race ' ELSE CAST(p_size AS VARCHAR) || ' K' END AS category_text
  FROM part
), slugs AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(sport_text, '^\\s+|\\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS sport_slug,
         regexp_replace(regexp_replace(lower(regexp_replace(category_text, '^\\s+|\\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS category_slug
  FROM parts
), types AS (
  SELECT p_partkey, CASE WHEN sport_slug IN ('running', 'cycling', 'swimming', 'triathlon', 'multi_sport', 'walking', 'obstacle', 'other') THEN sport_slug ELSE 'other' END AS sport,
         CASE WHEN category_slug = 'kids_race' THEN 'junior' WHEN regexp_full_match(category_slug, '(5|10|15|20)_k') THEN replace(category_slug, '_k', 'k') ELSE category_slug END AS category
  FROM slugs
), labels_of AS (
  SELECT p_partkey, sport, category, CASE WHEN length(category) > 0 THEN sport || '_' || category END AS label FROM types
)"""


def types(spark, sf_dir) -> DataFrame:
    """p_partkey, sport, category, label."""
    from startline.functions import text

    p = parts(spark, sf_dir)
    return p.select("p_partkey", text.coerce_sport(F.col("sport_text")).alias("sport"), text.canonical_category(text.slugify(F.col("category_text"))).alias("category"), text.race_label(F.col("sport_text"), F.col("category_text")).alias("label"))


def organisers(spark, sf_dir) -> DataFrame:
    """id, name, active, source_type."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("aggregator")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("platform")).otherwise(F.lit("organiser"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("active"), kind.alias("source_type"))


def events(spark, sf_dir) -> DataFrame:
    """id, organiser_id, status, url, starts."""
    status = F.when(F.col("o_orderstatus") == "P", F.lit("invalid")).otherwise(F.lit("valid"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("organiser_id"), status.alias("status"), F.concat(F.lit("https://events.example/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("url"), F.col("o_orderdate").cast("date").alias("starts"))


def distance_lines(spark, sf_dir) -> DataFrame:
    """event_id, sort_order, distance_text, price_text, label. Line numbers repeat, so sort_order is over all columns."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    price = F.when(F.col("q") % 5 != 0, F.col("p").cast("string"))
    lines = lines.join(types(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "label"), "l_partkey", "left")
    return lines.select("event_id", F.struct("l_linenumber", "l_partkey", "q", "p").alias("sort_order"), F.concat(F.col("q").cast("string"), F.lit("k")).alias("distance_text"), price.alias("price_text"), "label")


#: The tree's arrays sort by the whole order, so no line needs a number of its own.
distances = distance_lines


DISTANCES_SQL = (
    PARTS_SQL
    + """, lines AS (
  SELECT l_orderkey AS event_id, l_partkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem
), distances AS (
  SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY l_linenumber, l_partkey, q, p) - 1 AS INTEGER) AS sort_order,
         q || 'k' AS distance_text, CASE WHEN q % 5 <> 0 THEN CAST(p AS VARCHAR) END AS price_text, label
  FROM lines LEFT JOIN labels_of ON l_partkey = p_partkey
), events_of AS (
  SELECT o_orderkey AS id, o_custkey AS organiser_id, CASE WHEN o_orderstatus = 'P' THEN 'invalid' ELSE 'valid' END AS status FROM orders
)"""
)
