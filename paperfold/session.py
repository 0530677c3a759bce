"""Session settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import paperfold

# Settings that change results, so they are set on any session we are handed.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


# Functions sent to Python workers carry their code along, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(paperfold)


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", app: str = "paperfold") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Stream state and tables written between steps must be readable by every
    executor, so they go where `spark.checkpoint.dir` points. When that is unset,
    a temporary folder stands in for it, but only where driver and executors are
    one process; on a cluster each machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"paperfold-{os.getpid()}")
    return f"{root.rstrip('/')}/paperfold/{purpose}-{uuid.uuid4().hex}"


def spread(df, *keys: str):
    """The same rows, dealt over tasks by their keys.

    A file is read by as many tasks as it has row groups, often one; costly work on
    single rows is shared out before it begins.
    """
    return df.repartition(*keys)


def as_table(df, purpose: str):
    """`df` written once to the shared folder and read back.

    For a result that several later steps read: they scan files instead of
    repeating the work, and a lost executor costs a re-read.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(spark: SparkSession) -> None:
    """Frees the disk of shuffles that no plan in use refers to.

    Spark removes them once the driver has collected the plans they belong to, which in a
    driver with room left may be never. For a step that leaves much behind.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Rows that are sent to every task to pick out others: about 120 MB at most.
SENT_ROWS = 2_000_000


def among(df, wanted, on: list[str], most: int | None = None):
    """The rows of `df` whose `on` are in the stored table `wanted`, which is sent to all
    tasks if its rows, counted first, are few enough: then `df` is not shuffled."""
    few = wanted.count() <= (SENT_ROWS if most is None else most)
    kept = wanted.select(*on)
    return df.join(kept.hint("broadcast") if few else kept, on, "left_semi")
