"""Job-event reports in batch, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.operators import jobs
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import query
from paperfold.session import shared_folder
from paperfold.streaming import ingest
from paperfold.streaming import jobs as streams

_U = f"u AS ({fx.plain(fx.UPDATES_SQL)})"
_TERMINAL = "('awaiting_review', 'confirmed', 'rejected', 'failed')"
_CHANGES = f"""WITH {_U}, l AS (SELECT *, lag(status) OVER w AS last,
      sum(CASE WHEN status IN {_TERMINAL} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM u
      WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    SELECT job_id, event_id, status FROM l WHERE status IS DISTINCT FROM last AND COALESCE(ended, 0) = 0"""
_ORDER = ["ts", "event_id"]


@query("status_changes", _CHANGES)
def status_changes(t):
    return jobs.status_changes(fx.updates(t), ["status"], _ORDER).select("job_id", "event_id", "status")


def _update_stream(t):
    raw = t.spark.readStream.schema(t.events.schema).parquet(ingest.file_or_folder(f"{t.folder}/events.parquet"))
    return raw.selectExpr("event_id", "user_id AS job_id", "CAST(ts AS TIMESTAMP) AS ts", f"{fx._STATUS} AS status")


DELIVERIES = 4


def _arrivals(t):
    """(stream, delay): the events as files that arrive one by one, every seventh event
    a file late, and an event of no user behind them all that moves the watermark on."""
    folder = shared_folder(t.spark, "arrivals")
    low, high = (r for r in t.events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first())
    width = (high - low) // DELIVERIES + 1
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    number = F.floor((at - low) / width) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    delay = 2 * width // 1_000_000 + 1
    for k in range(DELIVERIES + 1):
        t.events.filter(number == k).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    last = t.spark.range(1).select(
        *[(F.timestamp_micros(F.lit(high + 3 * delay * 1_000_000)).cast(f.dataType) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.events.schema]
    )
    last.write.parquet(f"{folder}/{DELIVERIES + 1:03d}")
    raw = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return raw.selectExpr("event_id", "user_id AS job_id", "CAST(ts AS TIMESTAMP) AS ts", f"{fx._STATUS} AS status"), f"{delay} seconds"


@query("status_change_stream", _CHANGES)
def status_change_stream(t):
    streams.use_state_store(t.spark)
    out = shared_folder(t.spark, "changes")
    arriving, delay = _arrivals(t)
    # The batch twin remembers every feed that has ended; so does this, for ten years.
    changes = streams.status_change_stream(arriving, delay, 3650 * 86_400)
    ingest.run_to_end(changes, out, shared_folder(t.spark, "changes-state"))
    return t.spark.read.parquet(out).select("job_id", "event_id", "status")


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "claimable_jobs",
    f"""WITH {_U} SELECT event_id AS job_id, ts AS created_at FROM u WHERE status = 'pending'
    AND (value < 5 OR ts + INTERVAL 10 DAY <= {_NOW})""",
)
def claimable_jobs(t):
    waiting = fx.updates(t).selectExpr(
        "event_id AS job_id", "status", "ts AS created_at", "if(value < 5, NULL, ts + INTERVAL 10 DAYS) AS retry_not_before"
    )
    return jobs.claimable(waiting, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("job_id", "created_at")


_RATES = """SELECT event_id AS request_id, user_id AS key, count(*) OVER w AS in_window, 7 AS capacity, count(*) OVER w > 7 AS over_quota
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"""


@query("request_rates", _RATES)
def request_rates(t):
    requests = t.events.selectExpr("event_id AS request_id", "user_id AS key", "ts")
    return jobs.request_rate(requests, 86_400, 8).drop("ts")


@query("trailing_rate_stream", _RATES)
def trailing_rate_stream(t):
    streams.use_state_store(t.spark)
    out = shared_folder(t.spark, "trailing")
    arriving, delay = _arrivals(t)
    requests = arriving.selectExpr("event_id AS request_id", "job_id AS key", "ts")
    ingest.run_to_end(streams.trailing_rate_stream(requests, 86_400, 8, delay=delay), out, shared_folder(t.spark, "trailing-state"))
    return t.spark.read.parquet(out).drop("ts")


@query(
    "request_rate_stream",
    """SELECT user_id AS key, w AS window_start, count(*) AS requests FROM (
      SELECT user_id, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'),
        time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS w FROM events) q GROUP BY 1, 2""",
)
def request_rate_stream(t):
    requests = _update_stream(t).selectExpr("job_id AS key", "ts")
    out = shared_folder(t.spark, "rates")
    counted = streams.request_rate_stream(requests, "1 day", "12 hours")

    def keep(batch, _):
        # Complete mode hands over the whole result each time; the last one stands.
        batch.write.mode("overwrite").parquet(out)

    running = (
        counted.writeStream.outputMode("complete")
        .option("checkpointLocation", shared_folder(t.spark, "rates-state"))
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return t.spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "retry_states",
    f"""WITH {_U}, g AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS g FROM u),
    a AS (SELECT *, CASE WHEN status = 'failed' THEN CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)
      OVER (PARTITION BY job_id, g ORDER BY ts, event_id) AS INT) ELSE 0 END AS attempts FROM g)
    SELECT event_id, attempts, CASE WHEN attempts >= 3 THEN 'failed' WHEN attempts > 0 THEN 'pending' ELSE status END AS next_status,
      CASE WHEN attempts BETWEEN 1 AND 2 THEN ts + INTERVAL 30 SECOND END AS retry_not_before FROM a""",
)
def retry_states(t):
    states = jobs.retry_state(fx.updates(t), F.col("status") == "failed", _ORDER)
    return states.select("event_id", "attempts", "next_status", "retry_not_before")


_LATEST = f"""WITH {_U}, j AS (SELECT job_id, job_id % 10 AS batch_id, arg_max(status, (ts, event_id)) AS status FROM u GROUP BY 1)"""


_COMPLETION = f"""{_LATEST} SELECT batch_id, count(*) AS jobs, count(*) FILTER (WHERE status IN ('pending', 'extracting')) AS open_jobs,
    count(*) FILTER (WHERE status IN ('pending', 'extracting')) = 0 AS done FROM j GROUP BY 1"""


@query("batch_completion", _COMPLETION)
def batch_completion(t):
    latest = fx.updates(t).groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return jobs.batch_completion(latest.withColumn("batch_id", F.col("job_id") % 10))


@query("batch_completion_stream", _COMPLETION)
def batch_completion_stream(t):
    out = shared_folder(t.spark, "completion")
    marked = _update_stream(t).withColumn("batch_id", F.col("job_id") % 10)
    running = (
        streams.latest_status_stream(marked).writeStream.outputMode("update")
        .option("checkpointLocation", shared_folder(t.spark, "completion-state"))
        .foreachBatch(streams.keep_changes(out))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return streams.completion(t.spark.read.parquet(out).drop("trigger"))


@query(
    "stuck_jobs",
    f"""WITH {_U} SELECT event_id AS job_id, ts AS locked_at FROM u WHERE status = 'extracting' AND ts < {_NOW} - INTERVAL 6 HOUR""",
)
def stuck_jobs(t):
    held = fx.updates(t).selectExpr("event_id AS job_id", "status", "ts AS locked_at")
    return jobs.stuck_jobs(held, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "6 hours").select("job_id", "locked_at")


@query(
    "throughput",
    f"""WITH {_U} SELECT date_trunc('minute', ts) AS window_start, count(*) AS documents FROM u WHERE status = 'confirmed' GROUP BY 1""",
)
def throughput(t):
    done = fx.updates(t).filter("status = 'confirmed'")
    return jobs.throughput(done).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
