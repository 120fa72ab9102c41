import base64
import json
import os

from pyspark.sql import functions as F

from startline.operators import store
from startline.streaming import queue


def body(**message):
    return json.dumps({"message": {"data": base64.b64encode(json.dumps(message).encode()).decode()}})


def test_messages_fan_out(spark):
    bodies = spark.createDataFrame([(body(organiser_id=1),), ('{"wrong":1}',), (body(other=2),)], "body string")
    messages = queue.listing_messages(bodies)
    assert [r[0] for r in messages.collect()] == [1]
    assert queue.rejected(bodies).count() == 1
    listings = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "organiser_id long, urls array<string>")
    out = queue.fan_out(messages, listings)
    assert sorted(r["event_url"] for r in out.collect()) == ["a", "b"]
    assert json.loads(queue.publish(out, "event-crawl").first()["value"])["organiser_id"] == 1


def test_repeated_delivery_is_upserted_once(spark, tmp_path):
    for n, urls in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(u, f"run {n}") for u in urls], "url string, name string").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    table = store.SnapshotTable(spark, f"file://{tmp_path}/t")
    table.replace(spark.createDataFrame([], "url string, name string, first_seen_at string, last_seen_at string"))

    def apply(batch, _):
        table.replace(store.upsert(table.read(), batch.dropDuplicates(["url"]), "url", F.lit("now"), touch=("last_seen_at",)))

    stream = spark.readStream.schema("url string, name string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    for _ in range(2):  # a restart hands nothing on twice
        queue.upserts(stream, apply, f"file://{tmp_path}/ck").awaitTermination()
    assert sorted(r["url"] for r in table.read().collect()) == ["a", "b", "c"]


def test_pacing_as_a_stream(spark, tmp_path):
    """Three micro-batches of two sites, out of order within the watermark; requests leave in the batch that passes them."""
    from startline.operators import robots

    batches = [[("a", 1, 0, 5.0), ("a", 2, 3, 5.0), ("b", 3, 3, 0.0), ("a", 4, 2, 5.0)], [("a", 5, 1, 5.0), ("a", 6, 40, 5.0), ("b", 7, 3, 0.0)], [("a", 8, 41, 5.0), ("~", 9, 5000, 1.0)]]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        lines = [json.dumps({"site": s, "id": i, "arrival": f"2024-01-01T{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}Z", "delay": d}) for s, i, at, d in rows]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))  # files are read in the order of their times
    schema = "site string, id long, arrival timestamp, delay double"
    with queue.with_state(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        got = store.drained(queue.paced(stream, "10 seconds"), "paced").collect()
    rows = spark.read.schema(schema).json(f"file://{tmp_path}/in").withColumn("at", F.unix_seconds("arrival").cast("double"))
    want = robots.paced(rows, arrival="at", order=("id",)).where("site <> '~'").collect()
    assert sorted((r["site"], r["id"], r["starts"]) for r in got) == sorted((r["site"], r["id"], r["starts"]) for r in want)


def test_pacing_keeps_many_sites_in_one_state(spark, tmp_path):
    """Forty sites, one of them null, in three states: as each alone, over micro-batches that cut their queues."""
    from startline.operators import robots

    (tmp_path / "in").mkdir()
    for n in range(3):
        lines = [json.dumps({"site": i % 40 or None, "id": 1000 * n + i, "arrival": f"2024-01-01T00:{n * 10 + i * 7 % 10:02d}:{i % 60:02d}Z", "delay": float(i % 4 * 20)}) for i in range(200)]
        lines += [json.dumps({"site": -1, "id": 9999, "arrival": "2024-01-03T00:00:00Z", "delay": 1.0})] * (n == 2)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))
    schema = "site long, id long, arrival timestamp, delay double"
    with queue.with_state(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        found = queue.paced(stream, "10 minutes", buckets=3)
        assert found.schema["site"].dataType.simpleString() == "bigint"
        got = store.drained(found, "paced").collect()
    rows = spark.read.schema(schema).json(f"file://{tmp_path}/in").withColumn("at", F.unix_seconds("arrival").cast("double")).where("id <> 9999").fillna({"site": 0})
    want = robots.paced(rows, arrival="at", order=("id",)).collect()
    assert sorted((r["site"] or 0, r["id"], r["starts"]) for r in got) == sorted((r["site"], r["id"], r["starts"]) for r in want)


def test_provider_answers_like_a_lookup(spark, tmp_path):
    """Failures, tries and a site's waits, as a batch and as a stream that goes on where it ended."""
    from startline.sources import providers

    def stub(request, n):
        if request["id"] % 5 > n:
            raise ConnectionError("not yet")
        return {"markdown": f"page {request['id']}"} if request["id"] % 7 else None

    made = providers.source("stub", stub, "markdown string", tries=3, scale=0.0)
    asked = spark.range(40).select(F.col("id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("key"), (F.col("id") % 4).cast("string").alias("site"), F.lit(2.0).alias("delay"))
    asked = asked.unionByName(asked.limit(1).withColumn("key", F.lit(None).cast("string")))
    want = sorted((f"u{n}", f"page {n}", n % 5 + 1) for n in range(40) if n % 5 < 3 and n % 7)
    assert sorted(map(tuple, providers.answers(asked, made).collect())) == want
    for n in range(2):
        providers.requested(asked.where(F.col("id") % 2 == n), f"file://{tmp_path}/in/batch-{n}")
        stream = spark.readStream.format("stub").option("requests", f"file://{tmp_path}/in").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
        assert got == [w for w in want if n or int(w[0][1:]) % 2 == 0]


def test_waits_of_a_provider():
    from startline.sources import providers

    waits = []
    assert providers.call(lambda request, n: {"x": n} if n == 2 else None, {}, 4, waits.append) == ({"x": 2}, 3)
    assert providers.call(lambda request, n: None, {}, 6, waits.append) == (None, 6)
    assert waits == [2.0, 4.0, 2.0, 4.0, 8.0, 16.0, 30.0]
