"""Writers for the live tables: whole new state first, then one swap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_records(records: DataFrame, path: str) -> None:
    """Records by schema; a schema present in `records` replaces its partition.

    The writer commits a partition only when all its files are there, so a job
    that loses executors leaves the old state or the new one. The sort keeps one
    open file per task; several tasks may write one large schema.
    """
    (
        records.sortWithinPartitions("schema_id", "document_id", "row_index")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("schema_id")
        .parquet(path)
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def write_view(view: DataFrame, path: str) -> None:
    """A typed view as its own table, so that filters reach column statistics."""
    view.write.mode("overwrite").parquet(path)


def replace_table(spark: SparkSession, state: DataFrame, path: str) -> None:
    """Puts `state`, computed from the table at `path`, in its place.

    The new files are complete in a side folder before the old folder moves
    aside, and the old folder goes last. Hadoop reports a failed rename by its
    result, so every one is checked; if the new files can't take their place,
    the old folder is put back and the error raised.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = files.Path(path)
    staged, old = files.Path(path.rstrip("/") + ".next"), files.Path(path.rstrip("/") + ".old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)  # left by a run that ended after its swap
        elif not fs.rename(old, target):  # left by a run that ended inside it
            raise OSError(f"cannot restore {target} from {old}")
    state.write.mode("overwrite").parquet(staged.toString())
    replaces = fs.exists(target)
    if replaces and not fs.rename(target, old):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(staged, target):
        if replaces and not fs.rename(old, target):
            raise OSError(f"cannot put {staged} in place; the old table is at {old}")
        raise OSError(f"cannot put {staged} in place; the old table stands")
    if replaces:
        fs.delete(old, True)
