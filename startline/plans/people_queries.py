"""What contributors change, take back and look for: history, reverts, the nearest places."""

from __future__ import annotations

from pyspark.sql import functions as F

from startline.operators import history, places
from startline.plans.roles import table


def contributions(spark, d):
    """Turns of conversations as changes of two fields of each; an old value is what the turn before had set."""
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    now = c.select(F.col("conv_id").alias("entity"), F.concat(F.lit("f"), (F.col("turn") % 2).cast("string")).alias("field"), F.col("turn").cast("long").alias("version"), F.col("t.role").alias("contributor"), F.substring(F.sha2(F.coalesce("t.text", F.lit("")), 256), 1, 1).alias("new"))
    before = now.select("entity", "field", (F.col("version") + 2).alias("version"), F.col("new").alias("old"))
    return now.join(before, ["entity", "field", "version"], "left").withColumn("at", F.col("version") * 10)


CHANGES = """WITH t AS (SELECT conv_id AS entity, turn AS version, min({'role': role, 'text': text}) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), n AS (SELECT entity, 'f' || (version % 2) AS field, version::BIGINT AS version, t.role AS contributor, sha256(coalesce(t.text, ''))[1] AS new, version * 10 AS moment FROM t
), c AS (SELECT n.*, b.new AS old FROM n LEFT JOIN n b ON b.entity = n.entity AND b.version = n.version - 2)
"""


def version_intervals(spark, d):
    return history.intervals(contributions(spark, d)).select("entity", "field", "version", "new", "valid_from", "valid_to")


def fields_as_of(spark, d):
    return history.as_of(contributions(spark, d), F.lit(25))


def reverted_fields(spark, d):
    """All of one role's changes taken back; later ones of others stay, and those built on them are conflicts."""
    return history.reverted(contributions(spark, d), F.lit("assistant"))


def fields_after_revert(spark, d):
    """Fields as they stand once the revert is one more version of each restored field."""
    c = contributions(spark, d)
    now = history.as_of(c, F.lit(1 << 40))
    more = history.taking_back(history.reverted(c, F.lit("assistant")), now, F.lit("moderator"), F.lit(1 << 41).cast(c.schema["at"].dataType))
    return history.as_of(c.unionByName(more), F.lit(1 << 42))


REVERT = CHANGES + """, g AS (SELECT entity, field, max(version) AS version, max(version) FILTER (contributor = 'assistant') AS own, max(version) FILTER (contributor IS DISTINCT FROM 'assistant') AS other, arg_min({'v': old}, version).v AS before FROM c GROUP BY ALL
), l AS (SELECT c.entity, c.field, min(c.version) AS nxt FROM c JOIN g USING (entity, field) WHERE c.version > g.own AND contributor IS DISTINCT FROM 'assistant' GROUP BY ALL
), r AS (SELECT g.entity, g.field, CASE WHEN o.version IS NULL THEN g.before ELSE o.new END AS value,
  CASE WHEN g.own = g.version THEN 'restored' WHEN n.old IS NOT DISTINCT FROM w.new THEN 'conflict' ELSE 'kept' END AS action, g.version
  FROM g LEFT JOIN l USING (entity, field) LEFT JOIN c o ON o.entity = g.entity AND o.field = g.field AND o.version = g.other
  LEFT JOIN c n ON n.entity = g.entity AND n.field = g.field AND n.version = l.nxt LEFT JOIN c w ON w.entity = g.entity AND w.field = g.field AND w.version = g.own WHERE g.own IS NOT NULL)
"""


def optimistic_edits(spark, d):
    """Orders as edits of customers that name the version they start from; the first of each version is stored."""
    writes = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 3).alias("base"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_orderkey").alias("id"))
    stored = table(spark, d, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("entity"), (F.col("c_custkey") % 3).alias("version"))
    return history.accepted(writes, stored).select("id", "entity", "outcome")


def nearest_suppliers(spark, d):
    """The five nearest suppliers of every customer, by places that the keys give them."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, d, "customer").select(c.alias("id"), F.when(c % 17 != 0, (c * 13) % 178 - 89 + 0.37).alias("lat"), ((c * 29) % 360 - 180 + 0.11).alias("lon"))
    venues = table(spark, d, "supplier").select(s.alias("place"), ((s * 31) % 120 - 60).cast("double").alias("lat"), ((s * 7) % 360 - 180).cast("double").alias("lon"))
    return places.nearest(points, venues, 5)


QUERIES = {
    "version_intervals": (version_intervals, CHANGES + "SELECT entity, field, version, new, moment AS valid_from, lead(moment) OVER (PARTITION BY entity, field ORDER BY version) AS valid_to FROM c"),
    "fields_as_of": (fields_as_of, CHANGES + "SELECT entity, field, arg_max(new, version) AS value FROM c WHERE moment <= 25 GROUP BY ALL"),
    "reverted_fields": (reverted_fields, REVERT + "SELECT * FROM r"),
    "fields_after_revert": (fields_after_revert, REVERT + "SELECT a.entity, a.field, CASE WHEN r.action = 'restored' THEN r.value ELSE a.value END AS value FROM (SELECT entity, field, arg_max(new, version) AS value FROM c GROUP BY ALL) a LEFT JOIN r USING (entity, field)"),
    "optimistic_edits": (
        optimistic_edits,
        """WITH w AS (SELECT o_orderkey AS id, o_custkey AS entity, o_orderkey % 3 = c_custkey % 3 AS fits, c_custkey IS NULL AS gone, o_orderdate AS day FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 11 <> 0)
SELECT id, entity, CASE WHEN gone THEN 'unknown' WHEN fits AND row_number() OVER (PARTITION BY entity, fits ORDER BY CAST(day AS DATE), id) = 1 THEN 'stored' ELSE 'changed since' END AS outcome FROM w""",
    ),
    "nearest_suppliers": (
        nearest_suppliers,
        """WITH p AS (SELECT c_custkey AS id, (c_custkey * 13) % 178 - 89 + 0.37::DOUBLE AS lat, (c_custkey * 29) % 360 - 180 + 0.11::DOUBLE AS lon FROM customer WHERE c_custkey % 17 <> 0
), v AS (SELECT s_suppkey AS place, ((s_suppkey * 31) % 120 - 60)::DOUBLE AS _lat, ((s_suppkey * 7) % 360 - 180)::DOUBLE AS _lon FROM supplier
), x AS (SELECT id, place, round(2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians(_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(_lat)) * pow(sin(radians(_lon - lon) / 2), 2)))), 6) AS km FROM p, v)
SELECT id, place, km, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, place) AS rank FROM x) WHERE rank <= 5""",
    ),
}
