"""The geocoder's pace is kept over ranges of time and over midnight."""

import random

from pyspark.sql import functions as F

from startline.operators import robots
from startline.plans import catalog


def loop(asked, delay):
    last, out = None, {}
    for at, key in sorted(asked):
        last = at if last is None else max(at, last + delay)
        out[key] = last
    return out


def test_a_queue_is_carried_over_midnight(spark, tmp_path):
    midnight = 1_704_153_600  # 2024-01-02 00:00 UTC
    asked = [(midnight - 2, k) for k in range(20)] + [(midnight + s, 100 + s) for s in (0, 3, 3, 40)]
    asked = list({k: (a, k) for a, k in asked}.values())
    events = spark.createDataFrame(asked, "at long, event_id long").select("event_id", F.timestamp_seconds("at").alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["starts"] for r in catalog.queries()["geocode_throttle"](spark, str(tmp_path)).collect()}
    assert got == loop(asked, 1)
    assert got[100] == midnight + 18


def test_ranges_against_a_loop(spark):
    rnd = random.Random(2)
    asked = [(float(rnd.choice((rnd.randrange(50), rnd.randrange(900)))), k) for k in range(200)]
    df = spark.createDataFrame(asked, "arrival double, k long").union(spark.sql("SELECT CAST(NULL AS DOUBLE), -1L"))
    got = {r["k"]: r["starts"] for r in robots.paced_together(df, 2.5, order=("k",), seconds=10.0).collect()}
    assert got == loop(asked, 2.5) | {-1: None}
