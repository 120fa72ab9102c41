"""robots.txt as tables: policy by status, rules, matching and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from startline.functions.urls import path_and_query, site_root

DELAY_CAP = 30.0


def policy(status: Column) -> Column:
    """`parse` for an answer; unreachable sites and client errors allow all, server errors nothing."""
    return F.when(status.isNull(), F.lit("allow_all")).when(status >= 500, F.lit("disallow_all")).when(status >= 400, F.lit("allow_all")).otherwise(F.lit("parse"))


def pattern_regex(pattern: Column) -> Column:
    """A path pattern with * and a closing $ as a regular expression anchored at the start."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(F.endswith(pattern, F.lit("$")), F.lit("$")).otherwise(F.lit("")))


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """site, allow, pattern, delay: the rules for an agent, its own group before that of *.

    From site, status, body. A rule without a pattern is none. Sites whose files do not answer get one rule or none.
    """
    lines = robots.where(policy(F.col("status")) == "parse").select("site", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "line"))
    cut = F.regexp_replace("line", "#.*$", "")
    lines = lines.select(
        "site", "n", F.lower(F.trim(F.substring_index(cut, ":", 1))).alias("k"), F.trim(F.regexp_replace(cut, r"^[^:]*:", "")).alias("v")
    ).where(F.col("k").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("site").orderBy("n")
    lines = lines.withColumn("opens", ((F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(order), F.lit("")) != "user-agent")).cast("int"))
    lines = lines.withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = lines.where("k = 'user-agent'").select("site", "g", F.lower("v").alias("agent"))
    product = F.lower(F.lit(agent))
    fit = F.when(F.col("agent") == "*", 0).when((F.col("agent") != "") & F.contains(product, F.col("agent")), F.length("agent"))
    mine = agents.withColumn("fit", fit).where("fit IS NOT NULL")
    mine = mine.withColumn("best", F.max("fit").over(Window.partitionBy("site"))).where("fit = best").select("site", "g").distinct()
    own = lines.join(mine, ["site", "g"])
    delay = own.where("k = 'crawl-delay'").groupBy("site").agg(F.max(F.col("v").try_cast("double")).alias("delay"))
    paths = own.where("k IN ('allow', 'disallow') AND v <> ''").select("site", (F.col("k") == "allow").alias("allow"), F.col("v").alias("pattern"))
    shut = robots.where(policy(F.col("status")) == "disallow_all").select("site", F.lit(False).alias("allow"), F.lit("/").alias("pattern"))
    return paths.unionByName(shut).join(delay, "site", "full").select("site", "allow", "pattern", "delay")


def indexed(site_rules: DataFrame) -> DataFrame:
    """Distinct rules with the literal that they are looked up by: side (head or tail), key, and whether it is all of them.

    A path that a pattern matches begins with what stands before the pattern's first star, and if the pattern ends
    with a dollar, ends with what stands behind its last star; the longer of the two is the key.
    """
    pattern, closed = F.col("pattern"), F.endswith("pattern", F.lit("$"))
    body = F.regexp_replace(pattern, r"\$$", "")
    starred = F.contains(body, F.lit("*"))
    head, tail = F.substring_index(body, "*", 1), F.substring_index(body, "*", -1)
    by_tail = closed & starred & (F.length(tail) > F.length(head))
    rules_once = site_rules.where("pattern IS NOT NULL").select("site", "allow", "pattern").distinct()
    return rules_once.withColumns({"side": F.when(by_tail, F.lit("tail")).otherwise(F.lit("head")), "key": F.when(by_tail, tail).otherwise(head), "plain": ~starred & ~closed})


def met(asked: DataFrame, rules_by_key: DataFrame) -> DataFrame:
    """asked (site, path) with the rules whose key the path begins or ends with.

    A path is looked up under as many keys as its site has lengths of keys, whatever the number of its patterns.
    """
    lengths = rules_by_key.groupBy("site").agg(F.collect_set(F.struct("side", F.length("key").alias("n"))).alias("lengths"))
    keys = asked.join(lengths, "site").withColumn("at", F.explode("lengths")).where(F.col("at.n") <= F.length("path"))
    key = F.when(F.col("at.side") == "head", F.left("path", F.col("at.n"))).otherwise(F.right("path", F.col("at.n")))
    return keys.select(*asked.columns, F.col("at.side").alias("side"), key.alias("key")).join(rules_by_key, ["site", "side", "key"])


def allowed(urls: DataFrame, site_rules: DataFrame, registrator: Column | None = None, respect: bool = True) -> DataFrame:
    """urls (column url) with `allowed`: the longest matching pattern decides, allow wins ties, no match allows.

    A registrator other than blank and `bot` has the site's own permission. Paths meet patterns by the literals that
    these begin or end with; only patterns with a star or a dollar are then held against path and query. All rows of
    an address share its answer.
    """
    own = F.coalesce(registrator, F.lit("bot")) if registrator is not None else F.lit("bot")
    free = F.lit(not respect) | ~own.isin("", "bot")
    asked = urls.select("url").distinct().select("url", site_root(F.col("url")).alias("site"), path_and_query(F.col("url")).alias("path"))
    hit = met(asked, indexed(site_rules)).where(F.col("plain") | F.rlike("path", pattern_regex(F.col("pattern"))))
    verdict = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("verdict"))
    return urls.join(verdict, "url", "left").withColumn("allowed", free | F.coalesce("verdict", F.lit(True))).drop("verdict")


def paced(requests: DataFrame, site: str = "site", arrival: str = "arrival", delay: str = "delay", order: tuple[str, ...] = (), seconds: float = 3600.0) -> DataFrame:
    """requests with `starts`: when each may go if a site's requests keep their delay apart.

    arrival is in seconds; ties go by the order columns. With a site's delay d, request n starts at
    n d + max over earlier k of (arrival_k - k d). Delays over the cap count as the cap; none or zero do not wait. A
    request without an arrival has no start and holds up no other.

    A site is paced in two passes, so that none is one task: each of its ranges of time alone, then a range's count
    and its max(arrival - k d) go to the ranges after it, which wait for whatever those leave undone.
    """
    gap = F.least(F.coalesce(F.col(delay), F.lit(0.0)), F.lit(DELAY_CAP))
    own = requests.withColumns({"_range": F.floor(F.col(arrival) / seconds), "_d": gap})
    w = Window.partitionBy(site, "_range").orderBy(arrival, *order)
    own = own.withColumn("_n", (F.row_number().over(w) - 1).cast("double"))
    own = own.withColumn("_free", F.max(F.col(arrival) - F.col("_n") * F.col("_d")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = own.where("_range IS NOT NULL").groupBy(F.col(site).alias("_site"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"), F.max("_free").alias("_most"), F.max("_d").alias("_gap"))
    earlier = Window.partitionBy("_site").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).cast("double"))
    ranges = ranges.withColumn("_held", F.max(F.col("_most") - F.col("_before") * F.col("_gap")).over(earlier)).select("_site", "_at", "_before", "_held")
    out = own.join(ranges, F.col(site).eqNullSafe(F.col("_site")) & (F.col("_range") == F.col("_at")), "left")
    starts = F.greatest(F.col("_n") * F.col("_d") + F.col("_free"), (F.col("_before") + F.col("_n")) * F.col("_d") + F.col("_held"))
    return out.withColumn("starts", F.when(F.col("_d") > 0, starts).otherwise(F.col(arrival).cast("double"))).select(*requests.columns, "starts")


def paced_together(requests: DataFrame, delay: float, arrival: str = "arrival", order: tuple[str, ...] = (), seconds: float = 3600.0) -> DataFrame:
    """requests with `starts`: paced as one site."""
    return paced(requests.withColumns({"_one": F.lit(0), "_delay": F.lit(delay)}), "_one", arrival, "_delay", order, seconds).drop("_one", "_delay")
