"""Reports over job updates: what changed, what waits, what retries.

updates: job_id, ts, status, error, plus columns of the caller. Batch forms;
the streaming forms are in `paperfold.streaming.jobs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperfold.functions.ordering import along, previous_within, running_within
from paperfold.operators.browse import TERMINAL

RETRY_LIMIT = 3
RETRY_DELAY_SECONDS = 30
QUOTA_MARGIN = 0.9


def minute_slice(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(60_000_000))


def status_changes(updates: DataFrame, watched: list[str], order: list[str]) -> DataFrame:
    """Updates that differ from the job's previous one in a watched column.

    The feed of a job ends with its first terminal status. A job with very many
    updates is cut by minute.
    """
    keys = ["job_id"]
    before = along(
        updates,
        keys,
        minute_slice(),
        lambda rows, cut: previous_within(rows, keys, order, watched, "__before", cut),
    )
    changed = F.col("__before").isNull()
    for column in watched:
        changed = changed | ~F.col(column).eqNullSafe(F.col(f"__before.{column}"))
    ends = updates.filter(F.col("status").isin(*TERMINAL)).groupBy("job_id").agg(
        F.min(F.struct(*order)).alias("__end")
    )
    return (
        before.filter(changed)
        .join(ends, "job_id", "left")
        .filter(F.col("__end").isNull() | (F.struct(*order) <= F.col("__end")))
        .drop("__before", "__end")
    )


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs whose not-before time has come, oldest first."""
    due = F.col("retry_not_before").isNull() | (F.col("retry_not_before") <= now)
    return jobs.filter((F.col("status") == "pending") & due).orderBy("created_at", "job_id")


def request_rate(requests: DataFrame, seconds: int, limit: int, margin: float = QUOTA_MARGIN) -> DataFrame:
    """Requests of the same key in the trailing window, open at exactly `seconds`.

    requests: key, ts, request_id. capacity = max(1, int(limit * margin)).
    Counted per time slice as wide as the window; each slice also sees the
    requests of the one before it, so a key with most requests spreads over
    its slices.
    """
    capacity = max(1, int(limit * margin))
    width = seconds * 1_000_000
    timed = requests.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "__slice", F.floor(F.col("__at") / width)
    )
    seen_by = F.explode(F.array(F.col("__slice"), F.col("__slice") + 1))
    spread = timed.withColumn("__home", F.col("__slice")).withColumn("__slice", seen_by)
    trailing = W.partitionBy("key", "__slice").orderBy("__at").rangeBetween(-(width - 1), 0)
    return (
        spread.withColumn("in_window", F.count(F.lit(1)).over(trailing))
        .filter("__slice = __home")
        .withColumn("capacity", F.lit(capacity))
        .withColumn("over_quota", F.col("in_window") > capacity)
        .drop("__at", "__slice", "__home")
    )


def retry_state(updates: DataFrame, limited: Column, order: list[str]) -> DataFrame:
    """Consecutive rate-limited runs per job, reset by any other run.

    Adds attempts, and for a limited run: next_status (failed from the third on,
    else pending) and retry_not_before (+30 s). Attempts are the running count
    of limited runs minus its value at the last reset.
    """
    flagged = updates.withColumn("__limited", limited.cast("int"))
    keys = ["job_id"]
    reset = F.when(F.col("__limited") == 0, F.col("__total"))

    def count(rows: DataFrame, cut: Column | None) -> DataFrame:
        counted = running_within(rows, keys, order, sums={"__total": F.col("__limited")}, coarse=cut)
        return running_within(counted, keys, order, maxima={"__base": reset}, coarse=cut)

    based = along(flagged, keys, minute_slice(), count)
    attempts = F.when(F.col("__limited") == 1, F.col("__total") - F.coalesce("__base", F.lit(0))).otherwise(0)
    hit = F.col("attempts") > 0
    return (
        based.withColumn("attempts", attempts.cast("int"))
        .withColumn(
            "next_status",
            F.when(hit & (F.col("attempts") >= RETRY_LIMIT), "failed").when(hit, "pending").otherwise(F.col("status")),
        )
        .withColumn(
            "retry_not_before",
            F.when(
                hit & (F.col("attempts") < RETRY_LIMIT),
                F.col("ts") + F.expr(f"INTERVAL {RETRY_DELAY_SECONDS} SECONDS"),
            ),
        )
        .drop("__limited", "__total", "__base")
    )


def batch_completion(jobs: DataFrame) -> DataFrame:
    """(batch_id, jobs, open_jobs, done): done when no job is pending or extracting."""
    unfinished = ~F.col("status").isin(*TERMINAL)
    return jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(unfinished).alias("open_jobs"),
        (~F.bool_or(unfinished)).alias("done"),
    )


def stuck_jobs(jobs: DataFrame, now: Column, age: str = "1 hour") -> DataFrame:
    """Jobs extracting since longer than `age`."""
    return jobs.filter((F.col("status") == "extracting") & (F.col("locked_at") < now - F.expr(f"INTERVAL {age}")))


def throughput(jobs: DataFrame, width: str = "1 minute") -> DataFrame:
    """Finished documents per time window."""
    return (
        jobs.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"))
        .agg(F.count(F.lit(1)).alias("documents"))
        .select(F.col("w.start").alias("window_start"), "documents")
    )
