"""Trees, groupings, dimensions, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from startline.functions import text
from startline.operators import decide, report, runs, store
from startline.plans import roles
from startline.plans.roles import DISTANCES_SQL, PARTS_SQL, table


def tree(spark, d, status="valid"):
    return report.event_tree(roles.events(spark, d), roles.organisers(spark, d), roles.distances(spark, d), status=status)


def event_organiser_join(spark, d):
    e, o = roles.events(spark, d), roles.organisers(spark, d)
    return e.where("status = 'valid'").join(o, e.organiser_id == o.id).select(e.id, "organiser_id", F.col("name").alias("organiser_name"))


def event_distance_tree(spark, d):
    return tree(spark, d).select("id", "organiser_name", F.size("distances").alias("n_distances"), report.distances_line(F.col("distances")).alias("distances"))


def entries_by_sport_type(spark, d):
    return report.totals(report.entries_of(roles.events(spark, d), roles.organisers(spark, d), roles.distance_lines(spark, d)))


def entries_by_organiser(spark, d):
    return report.by_organiser(tree(spark, d)).select("organiser_id", "organiser_name", "events", F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("event_ids"))


def overall_counts(spark, d):
    return report.overall(tree(spark, d))


def uncategorised_distances(spark, d):
    found = report.entries_of(roles.events(spark, d), roles.organisers(spark, d), roles.distance_lines(spark, d), None).where(F.col("sport") == report.UNCATEGORISED)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("entries"))


def events_without_distances(spark, d):
    return tree(spark, d, None).where(F.size("distances") == 0).select("id", "status")


def race_type_dimension(spark, d):
    stored = roles.types(spark, d).where("p_partkey % 2 = 0").select("label", "sport", F.col("category").alias("distance_category")).where("label IS NOT NULL").distinct()
    parts = roles.parts(spark, d).select(F.col("sport_text").alias("sport"), F.col("category_text").alias("distance_category"))
    return store.race_types(parts, stored)


def sport_coercion(spark, d):
    return roles.parts(spark, d).select("p_partkey", text.coerce_sport(F.col("sport_text")).alias("sport"))


def category_canon(spark, d):
    return roles.types(spark, d).select("p_partkey", "category")


def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slugify(F.concat(F.lit("  "), F.col("p_name"), F.lit(" -- "), F.col("p_type"), F.lit("!\t"))).alias("slug"))


def status_filter(status):
    def query(spark, d):
        quality = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = table(spark, d, "documents").select("doc_id").join(quality, "doc_id", "left")
        rows = rows.withColumn("status", F.when(F.col("quality") == 0, F.lit("invalid")).otherwise(F.lit("valid")))
        return rows.where(F.col("status") == status).select("doc_id", "status")

    return query


def eligible_organisers(spark, d):
    return decide.eligible(roles.organisers(spark, d)).select("id", "name")


def csv_export_shape(spark, d):
    return report.csv_rows(tree(spark, d)).select("id", "organiser_id", "organiser_name", "status", "distances", "url", F.col("name").isNull().alias("untitled"))


def csv_export_ordered(spark, d):
    return report.ordered(tree(spark, d)).select("id", "organiser_name")


def accented(spark, d):
    """Customers with names of many spellings."""
    k = F.col("c_custkey")
    word = F.get(F.array(*[F.lit(w) for w in ("Éclair", "eclair", "Eclair", "ECLAIR", "Zebra", "zèbre", "ébène", "Ebene", "apex", "Öl", "ol", "Straße", "strasse")]), (k % 13).cast("int"))
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("nation"), F.concat(word, F.lit(" "), (k % 3).cast("string")).alias("organiser_name"))


def collated_order(spark, d):
    """The place of every organiser in its nation by the order of a collation, not of bytes."""
    w = Window.partitionBy("nation").orderBy(report.collated("organiser_name", "de"), "id")
    return report.ordered(accented(spark, d), "de").withColumn("place", F.row_number().over(w))


def collated_spellings(spark, d):
    return report.spellings(accented(spark, d), "organiser_name")


ACCENTED = """WITH a AS (SELECT c_custkey AS id, c_nationkey AS nation, (['Éclair', 'eclair', 'Eclair', 'ECLAIR', 'Zebra', 'zèbre', 'ébène', 'Ebene', 'apex', 'Öl', 'ol', 'Straße', 'strasse'])[c_custkey % 13 + 1] || ' ' || (c_custkey % 3) AS organiser_name FROM customer)
"""


def detail_blocks(spark, d):
    k, e = F.col("id"), roles.events(spark, d)
    dates = e.where("id % 6 = 0").select(k.alias("event_id"), F.lit(0).alias("sort_order"), F.concat(F.lit("Day "), k.cast("string")).alias("date_text"), F.when(k % 4 == 0, F.lit("9 am")).alias("time_text"), F.lit(None).cast("string").alias("price_text"))
    t = report.event_tree(e, roles.organisers(spark, d), roles.distances(spark, d), dates, status=None).drop("url", "starts")
    t = t.withColumns({
        "name": F.when(k % 3 != 0, F.concat(F.lit("Race <"), k.cast("string"), F.lit("> & 'friends'"))),
        "sport": F.when(k % 2 == 0, F.lit("running")), "invalid_reason": F.lit(None).cast("string"), "lifecycle_text": F.when(k % 8 == 0, F.lit("ill")),
        "lifecycle_status": F.when(k % 4 == 0, F.lit("cancelled")).otherwise(F.lit("scheduled")), "location": F.when(k % 5 != 0, F.concat(F.lit("Town & "), k.cast("string"))),
        "latitude": F.when(k % 7 == 0, F.lit(51.5)), "longitude": F.lit(-1.25), "occurrence_weekdays": F.when(k % 9 == 0, F.array(F.lit("sat"), F.lit("sun"))),
    })
    return t.select("id", report.event_html(t.columns).alias("html"))


def upsert_events(spark, d):
    o = table(spark, d, "orders")
    rows = lambda df, at: df.select(F.concat(F.lit("https://events.example/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("url"), F.concat(F.col("o_orderpriority"), F.lit(at)).alias("name"), F.lit(at).alias("first_seen_at"), F.lit(at).alias("last_seen_at"))
    stored = rows(o.where("o_orderkey % 3 <> 0"), "2024-01-01")
    incoming = rows(o.where("o_orderkey % 2 = 0"), "2024-02-01").drop("first_seen_at", "last_seen_at")
    return store.upsert(stored, incoming, "url", F.lit("2024-02-01"), touch=("last_seen_at",))


def replace_children(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    touched = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    incoming = lines.where("l_orderkey % 4 = 0 AND l_quantity >= 25").withColumn("l_quantity", F.col("l_quantity") + 100)
    out = store.replace_children(lines, touched, incoming, "l_orderkey")
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("children"), F.sum("l_quantity").alias("quantity"))


def get_or_create_organiser(spark, d):
    o = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("source_type"), F.lit(None).cast("string").alias("homepage_url"), F.lit(None).cast("string").alias("discovered_via"))
    once = store.umbrella_organiser(o, "Feed organiser", "https://feed.example/", "feed")
    return store.umbrella_organiser(once, "Feed organiser", "https://feed.example/", "feed").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


def seed_sync(spark, d):
    """Stored organisers are the first rows of their home pages, the seed holds two customers in three, repeats included."""
    c = table(spark, d, "customer").withColumn("homepage_url", F.concat(F.lit("https://o"), (F.col("c_custkey") % 500).cast("string"), F.lit(".example/")))
    params = lambda v: F.create_map(F.lit("sitemap_url"), v)
    first = c.groupBy("homepage_url").agg(F.min(F.struct("c_custkey", "c_name")).alias("c")).where("c.c_custkey % 2 = 0")
    stored = first.select("homepage_url", F.col("c.c_name").alias("name"), params(F.lit("old")).alias("handler_params"), F.lit("bot").alias("registrator"))
    seed = c.where("c_custkey % 3 <> 0").select("homepage_url", F.concat(F.lit("seed "), "c_name").alias("name"), params(F.col("c_mktsegment")).alias("handler_params"), F.lit("person").alias("registrator"), F.col("c_custkey").alias("line"))
    return store.sync_seed(stored, seed, "line").select("homepage_url", "name", F.col("handler_params")["sitemap_url"].alias("sitemap_url"), "registrator")


def history_latest(spark, d):
    return store.latest(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.col("first_seen").alias("first_turn"))


def mass_revert(spark, d):
    """Every conversation as it stood before the turns of one role: the last turn of another."""
    kept = table(spark, d, "conversations").where("role <> 'assistant'")
    return store.latest(kept, "conv_id", "turn").select("conv_id", "turn", "role")


def coords_last_non_null(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("latitude")).withColumn("at", F.struct("ts", "event_id"))
    return runs.carried_forward(e, "user_id", "at", "latitude").select("event_id", "latitude_known")


def hash_change_detection(spark, d):
    h = table(spark, d, "documents").select("doc_id", "source", decide.content_hash(F.col("text")).alias("content_hash"))
    return runs.changed(h, "source", "doc_id", "content_hash").select("doc_id", "changed")


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", decide.content_hash(F.col("text")).alias("content_hash"))


def hash_dedupe(spark, d):
    h = content_hash(spark, d)
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def additive_schema(spark, d):
    from pyspark.sql import types as T

    wanted = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("active", T.BooleanType(), False), T.StructField("owner", T.StringType(), False)])
    rows, left_out = store.grow_schema(table(spark, d, "region"), wanted, {"active": True})
    return rows.withColumn("left_out", F.lit(",".join(left_out)))


CANON_SQL = f"WITH {PARTS_SQL} "
QUERIES = {
    "collated_order": (collated_order, ACCENTED + "SELECT *, CAST(row_number() OVER (PARTITION BY nation ORDER BY organiser_name COLLATE de, id) AS INTEGER) AS place FROM a"),
    "collated_spellings": (collated_spellings, ACCENTED + ", g AS (SELECT organiser_name AS x, replace(lower(strip_accents(organiser_name)), 'ß', 'ss') AS k, count(*) AS n FROM a GROUP BY ALL) SELECT min(x) AS spelling, count(*) AS n, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY k"),
    "event_organiser_join": (event_organiser_join, "SELECT o_orderkey AS id, o_custkey AS organiser_id, c_name AS organiser_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"),
    "event_distance_tree": (
        event_distance_tree,
        f"""WITH {DISTANCES_SQL}, x AS (
  SELECT event_id, count(*) AS n, string_agg(distance_text || coalesce(' [' || label || ']', '') || coalesce(': ' || price_text, ''), '; ' ORDER BY sort_order) AS line FROM distances GROUP BY event_id)
SELECT id, c_name AS organiser_name, CAST(coalesce(n, 0) AS INTEGER) AS n_distances, coalesce(line, '') AS distances
FROM events_of JOIN customer ON organiser_id = c_custkey LEFT JOIN x ON event_id = id WHERE status = 'valid'""",
    ),
    "entries_by_sport_type": (
        entries_by_sport_type,
        f"""WITH {DISTANCES_SQL}, x AS (
  SELECT CASE WHEN label IS NULL THEN 'uncategorised' WHEN label LIKE 'multi_sport_%' THEN 'multi_sport' ELSE split_part(label, '_', 1) END AS sport, coalesce(label, '(uncategorised)') AS label
  FROM distances JOIN events_of ON event_id = id JOIN customer ON organiser_id = c_custkey WHERE status = 'valid')
SELECT sport, label, count(*) AS entries, count(DISTINCT label) AS labels FROM x GROUP BY ROLLUP (sport, label)""",
    ),
    "entries_by_organiser": (entries_by_organiser, "SELECT o_custkey AS organiser_id, c_name AS organiser_name, count(*) AS events, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS event_ids FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL"),
    "overall_counts": (overall_counts, "SELECT count(*) AS events, count(DISTINCT o_custkey) AS organisers FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"),
    "uncategorised_distances": (uncategorised_distances, f"WITH {DISTANCES_SQL} SELECT id, count(*) AS entries FROM distances JOIN events_of ON event_id = id JOIN customer ON organiser_id = c_custkey WHERE label IS NULL GROUP BY id"),
    "events_without_distances": (events_without_distances, f"WITH {DISTANCES_SQL} SELECT id, status FROM events_of JOIN customer ON organiser_id = c_custkey WHERE NOT EXISTS (SELECT 1 FROM distances WHERE event_id = id)"),
    "race_type_dimension": (race_type_dimension, CANON_SQL + "SELECT DISTINCT label, sport, category AS distance_category FROM labels_of WHERE label IS NOT NULL"),
    "sport_coercion": (sport_coercion, CANON_SQL + "SELECT p_partkey, sport FROM types"),
    "category_canon": (category_canon, CANON_SQL + "SELECT p_partkey, category FROM types"),
    "slugify": (slugify, "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part"),
    "status_filter_valid": (status_filter("valid"), "SELECT doc_id, 'valid' AS status FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE coalesce(quality, 1) <> 0"),
    "status_filter_invalid": (status_filter("invalid"), "SELECT doc_id, 'invalid' AS status FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE quality = 0"),
    "eligible_organisers": (eligible_organisers, "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "csv_export_shape": (
        csv_export_shape,
        f"""WITH {DISTANCES_SQL}, x AS (
  SELECT event_id, string_agg(distance_text || coalesce(' [' || label || ']', '') || coalesce(': ' || price_text, ''), '; ' ORDER BY sort_order) AS line FROM distances GROUP BY event_id)
SELECT id, organiser_id, c_name AS organiser_name, status, coalesce(line, '') AS distances, 'https://events.example/' || id || '/' AS url, true AS untitled
FROM events_of JOIN customer ON organiser_id = c_custkey LEFT JOIN x ON event_id = id WHERE status = 'valid'""",
    ),
    "csv_export_ordered": (csv_export_ordered, "SELECT o_orderkey AS id, c_name AS organiser_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' ORDER BY c_name, o_orderkey"),
    "detail_blocks": (
        detail_blocks,
        f"""WITH {DISTANCES_SQL}, x AS (
  SELECT event_id, string_agg('<tr><td>' || distance_text || '</td><td>' || coalesce(price_text, '&mdash;') || '</td><td>' || coalesce('<code>' || label || '</code>', '&mdash;') || '</td></tr>', '' ORDER BY sort_order) AS line FROM distances GROUP BY event_id
), e AS (SELECT *, status = 'invalid' AS bad, id % 4 = 0 AS off, id % 7 = 0 AS exact, id % 5 <> 0 AS town FROM events_of JOIN customer ON organiser_id = c_custkey LEFT JOIN x ON event_id = id
), m AS (SELECT *, CASE WHEN exact THEN '51.5,-1.25' WHEN town THEN 'Town+%26+' || id END AS q FROM e)
SELECT id, '<details class=''event''><summary>' || CASE WHEN id % 3 <> 0 THEN 'Race &lt;' || id || '&gt; &amp; &#x27;friends&#x27;' ELSE '(untitled event #' || id || ')' END
  || CASE WHEN id % 2 = 0 THEN '<span class=''badge''>running</span>' ELSE '' END || CASE WHEN bad THEN '<span class=''badge badge-invalid''>INVALID</span>' ELSE '' END
  || CASE WHEN off THEN '<span class=''badge badge-cancelled''>CANCELLED</span>' ELSE '' END || '</summary><table class=''fields''>'
  || CASE WHEN bad THEN '<tr><th>Invalid reason</th><td>&mdash;</td></tr>' ELSE '' END || CASE WHEN off THEN '<tr><th>Lifecycle detail</th><td>' || CASE WHEN id % 8 = 0 THEN 'ill' ELSE '&mdash;' END || '</td></tr>' ELSE '' END
  || '<tr><th>Organiser ID</th><td>' || organiser_id || '</td></tr><tr><th>Sport</th><td>' || CASE WHEN id % 2 = 0 THEN 'running' ELSE '&mdash;' END || '</td></tr>'
  || '<tr><th>Recurs on</th><td>' || CASE WHEN id % 9 = 0 THEN 'sat, sun' ELSE '&mdash;' END || '</td></tr><tr><th>Location</th><td>' || CASE WHEN town THEN 'Town &amp; ' || id ELSE '&mdash;' END || '</td></tr></table>'
  || CASE WHEN line IS NULL THEN '<p class=''empty''>No distances listed.</p>' ELSE '<table class=''distances''><tr><th>Distance</th><th>Price</th><th>Race type</th></tr>' || line || '</table>' END
  || CASE WHEN id % 6 <> 0 THEN '<p class=''empty''>No specific dates listed.</p>' ELSE '<table class=''distances''><tr><th>Date</th><th>Time</th><th>Price</th></tr><tr><td>Day ' || id || '</td><td>' || CASE WHEN off THEN '9 am' ELSE '&mdash;' END || '</td><td>&mdash;</td></tr></table>' END
  || CASE WHEN q IS NULL THEN '<p class=''no-map''>No location available.</p>' ELSE '<p><a class=''maps-link'' href=''https://www.google.com/maps/search/?api=1&amp;query=' || q || chr(39) || '>Open ' || CASE WHEN exact THEN '' ELSE '&quot;Town &amp; ' || id || '&quot; ' END || 'in Google Maps</a></p><iframe class=''maps-embed'' src=''https://www.google.com/maps?q=' || q || '&amp;output=embed'' loading=''lazy''></iframe>' END
  || '</details>' AS html FROM m""",
    ),
    "upsert_events": (
        upsert_events,
        """SELECT 'https://events.example/' || o_orderkey || '/' AS url, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS name,
  CASE WHEN o_orderkey % 3 <> 0 THEN '2024-01-01' ELSE '2024-02-01' END AS first_seen_at, CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS last_seen_at
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    ),
    "replace_children": (
        replace_children,
        """SELECT l_orderkey, count(*) AS children, sum(CASE WHEN l_orderkey % 4 = 0 THEN l_quantity + 100 ELSE l_quantity END) AS quantity FROM lineitem
WHERE l_orderkey % 4 <> 0 OR l_quantity >= 25 GROUP BY l_orderkey""",
    ),
    "get_or_create_organiser": (get_or_create_organiser, "SELECT lower(c_mktsegment) AS source_type, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'platform', 1"),
    "seed_sync": (
        seed_sync,
        """WITH c AS (SELECT *, 'https://o' || (c_custkey % 500) || '.example/' AS homepage_url FROM customer
), o AS (SELECT homepage_url, min(c_custkey) AS k, arg_min(c_name, c_custkey) AS name FROM c GROUP BY homepage_url HAVING k % 2 = 0
), s AS (SELECT homepage_url, 'seed ' || arg_min(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS sitemap_url FROM c WHERE c_custkey % 3 <> 0 GROUP BY homepage_url)
SELECT homepage_url, coalesce(o.name, s.name) AS name, coalesce(s.sitemap_url, 'old') AS sitemap_url, CASE WHEN s.homepage_url IS NULL THEN 'bot' ELSE 'person' END AS registrator
FROM o FULL JOIN s USING (homepage_url)""",
    ),
    "history_latest": (history_latest, "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, min(turn) AS first_turn FROM conversations GROUP BY conv_id"),
    "mass_revert": (mass_revert, "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations WHERE role <> 'assistant' GROUP BY conv_id"),
    "coords_last_non_null": (coords_last_non_null, "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latitude_known FROM events"),
    "hash_change_detection": (hash_change_detection, "SELECT doc_id, coalesce(sha256(text) IS DISTINCT FROM lag(sha256(text)) OVER w OR lag(1) OVER w IS NULL, true) AS changed FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)"),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS content_hash FROM documents"),
    "hash_dedupe": (hash_dedupe, "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "additive_schema": (additive_schema, "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note, true AS active, 'owner' AS left_out FROM region"),
}
