"""Stateful streams against their batch twins, over several triggers with late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperfold.operators import jobs
from paperfold.session import shared_folder
from paperfold.streaming import ingest
from paperfold.streaming import jobs as streams

UPDATE = "event_id bigint, job_id bigint, ts timestamp, status string"
START = dt.datetime(2024, 1, 1)


def arrive(spark, deliveries):
    """The rows of each delivery as a file of its own, and a last one that moves the watermark on."""
    folder = shared_folder(spark, "test-arrivals")
    for k, rows in enumerate([*deliveries, [(None, None, START + dt.timedelta(days=400), None)]]):
        spark.createDataFrame(rows, UPDATE).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(spark, stream):
    streams.use_state_store(spark)
    out = shared_folder(spark, "test-out")
    ingest.run_to_end(stream, out, shared_folder(spark, "test-state"))
    return spark.read.parquet(out)


def late_rows(seed, statuses):
    """Rows of three deliveries; some come a delivery after their time."""
    rng = random.Random(seed)
    deliveries = [[], [], []]
    for event in range(150):
        hour = rng.randint(0, 71)
        due = hour // 24
        at = START + dt.timedelta(hours=hour, microseconds=rng.choice([0, 0, 1, 999_999]))
        deliveries[min(2, due + (rng.random() < 0.3))].append((event, rng.randint(0, 9), at, rng.choice(statuses)))
    return deliveries


@pytest.mark.parametrize("statuses", [["pending", "extracting"], ["pending", "extracting", "extracting", "confirmed", "failed"]])
def test_status_feed_equals_its_batch_twin(spark, statuses):
    deliveries = late_rows(len(statuses), statuses)
    got = run(spark, streams.status_change_stream(arrive(spark, deliveries), "3 days", 10**7))
    rows = spark.createDataFrame(sum(deliveries, []), UPDATE)
    want = jobs.status_changes(rows, ["status"], ["ts", "event_id"]).select("job_id", "ts", "event_id", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_ended_feed_is_forgotten_in_time(spark):
    def at(hours):
        return START + dt.timedelta(hours=hours)

    deliveries = [
        [(1, 5, at(0), "pending"), (2, 5, at(1), "confirmed")],
        [(3, 6, at(4), "pending")],
        [(4, 5, at(5), "extracting"), (5, 6, at(6), "pending")],  # remembered: the feed has ended
        [(6, 6, at(40), "extracting")],
        [(7, 6, at(60), "extracting")],
        [(8, 5, at(61), "extracting")],  # forgotten: a new feed
    ]
    got = run(spark, streams.status_change_stream(arrive(spark, deliveries), "1 hour", 24 * 3600))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 6, 8]


def test_trailing_rate_equals_its_batch_twin(spark):
    rng = random.Random(8)
    deliveries = [[], [], []]
    for event in range(200):
        second = rng.randint(0, 299)
        at = START + dt.timedelta(seconds=second, microseconds=rng.choice([0, 0, 1]))
        deliveries[min(2, second // 100 + (rng.random() < 0.3))].append((event, rng.randint(0, 2), at, "x"))
    # Exactly sixty seconds apart: the window is open there.
    deliveries[0] += [(1000, 9, START, "x"), (1001, 9, START, "x"), (1002, 9, START + dt.timedelta(seconds=60), "x")]
    stream = arrive(spark, deliveries).selectExpr("event_id AS request_id", "job_id AS key", "ts")
    got = run(spark, streams.trailing_rate_stream(stream, 60, 20, delay="10 minutes"))
    rows = spark.createDataFrame(sum(deliveries, []), UPDATE).select(F.col("event_id").alias("request_id"), F.col("job_id").alias("key"), "ts")
    want = jobs.request_rate(rows, 60, 20).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["request_id"]: r["in_window"] for r in got.collect() if r["key"] == 9} == {1000: 2, 1001: 2, 1002: 1}
    assert got.filter("over_quota").count() > 0
