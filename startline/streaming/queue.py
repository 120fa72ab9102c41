"""Crawl messages with Structured Streaming: fan-out, repeated delivery, pacing, scheduled batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from startline.operators.robots import DELAY_CAP
from startline.sources.files import decode_message

LISTING = "organiser_id long"
EVENT = "organiser_id long, event_url string"


def listing_messages(bodies: DataFrame) -> DataFrame:
    """organiser_id of every well-formed message; others are counted as rejected by rejected()."""
    return bodies.select(decode_message(F.col("body"), LISTING).alias("m")).where("m.organiser_id IS NOT NULL").select("m.*")


def event_messages(bodies: DataFrame) -> DataFrame:
    """organiser_id and event_url of every message that has both."""
    return bodies.select(decode_message(F.col("body"), EVENT).alias("m")).where("m.organiser_id IS NOT NULL AND m.event_url IS NOT NULL").select("m.*")


def envelope(value: Column) -> Column:
    """A message's JSON in the envelope that decode_message() opens."""
    return F.concat(F.lit('{"message":{"data":"'), F.regexp_replace(F.base64(F.encode(value, "UTF-8")), r"\s", ""), F.lit('"}}'))


def rejected(bodies: DataFrame) -> DataFrame:
    return bodies.where(F.get_json_object("body", "$.message.data").isNull())


def fan_out(messages: DataFrame, listings: DataFrame) -> DataFrame:
    """One event message for each new address of an organiser's listing (organiser_id, urls)."""
    return messages.join(listings, "organiser_id").select("organiser_id", F.explode("urls").alias("event_url"))


def once(messages: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Messages without repeats that arrive within the watermark."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def publish(messages: DataFrame, topic: str) -> DataFrame:
    """topic, key, value: what a queue sink takes."""
    return messages.select(F.lit(topic).alias("topic"), F.col(messages.columns[0]).cast("string").alias("key"), F.to_json(F.struct(*messages.columns)).alias("value"))


def upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, batch: bool = True):
    """Starts a query that hands each micro-batch to apply; batch=True reads what there is and ends."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if batch else writer).start()


class Pacing(StatefulProcessor):
    """Requests wait in the state of their bucket and leave when they are due, their site's delay apart at least.

    Requests of a site are put in order once the watermark has passed their arrival, so it does not matter how
    micro-batches cut them; one timer is set for the next of a bucket that is due. A site's last start outlives an
    empty queue. A bucket holds many sites, as every call and every read of state costs more than many rows; its state
    is one value: requests by site, last starts by site, the timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, last, timer = self._kept()
        for part in rows:
            for site, *request in zip(part["site"], part["at"].astype(float), part["id"].astype(int), part["delay"].astype(float), strict=True):
                waiting.setdefault(site, []).append(tuple(request))
        return self._leave(waiting, last, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._leave(*self._kept(), timerValues)

    def _kept(self) -> tuple[dict, dict, int | None]:
        found = self.state.get()
        return ({}, {}, None) if found is None else pickle.loads(bytes(found[0]))

    def _leave(self, waiting: dict, last: dict, timer: int | None, timer_values) -> Iterator[pd.DataFrame]:
        now = timer_values.getCurrentWatermarkInMs() / 1000
        gone, left, nexts = [], {}, []
        for site, queue in waiting.items():
            queue.sort()
            before, n = last.get(site), 0
            for at, id_, delay in queue:
                due = at if before is None or not delay > 0 else max(at, before + min(delay, DELAY_CAP))
                if due > now:  # those after it are due later
                    nexts.append(due)
                    break
                gone.append((site, id_, due))
                before = due if delay > 0 else before
                n += 1
            if n < len(queue):
                left[site] = queue[n:]
            if before is not None:
                last[site] = before
        wanted = int(min(nexts) * 1000) + 1 if nexts else None
        if timer != wanted:
            if timer is not None and timer > now * 1000:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.state.update((pickle.dumps((left, last, wanted)),))
        for k in range(0, len(gone), 10_000):
            yield pd.DataFrame(gone[k : k + 10_000], columns=["site", "id", "starts"])

    def close(self) -> None:
        pass


def paced(requests: DataFrame, late: str = "1 hour", buckets: int = 2048) -> DataFrame:
    """site, id, starts of a stream of site, id, arrival (timestamp) and delay; rows later than `late` are dropped.

    Sites share the state of `buckets`. Needs the RocksDB state store, see with_state().
    """
    seconds = F.unix_micros("arrival").cast("double") / 1_000_000
    # a site is a string on its way through Python, where a column of numbers with a null would be another type
    rows = requests.withWatermark("arrival", late).select(F.pmod(F.hash("site"), F.lit(buckets)).alias("bucket"), F.col("site").cast("string").alias("site"), "id", "arrival", "delay", seconds.alias("at"))
    found = rows.groupBy("bucket").transformWithStateInPandas(Pacing(), "site string, id long, starts double", "Append", "EventTime")
    return found.select(F.col("site").cast(requests.schema["site"].dataType).alias("site"), "id", "starts")


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams keep their state in RocksDB, which state with timers needs."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sessions(rows: DataFrame, by: str, time: str, gap: str, late: str) -> DataFrame:
    """by, starts, ends, n: runs of a key's rows less than `gap` apart, sent on once the watermark has passed their end."""
    found = rows.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), "n")
