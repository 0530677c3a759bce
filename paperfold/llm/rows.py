"""Rows with a number of their own, so that stages choose rows and not doc_ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.session import as_table

ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a column that names each, the same whenever they are read.

    Rows that come straight from files are named by file (its path's hash) and place
    in it. Any others are stored once, with a number.
    """
    if _from_files(docs):
        file = F.xxhash64("_metadata.file_path").alias("file")
        return docs.withColumn(ROW, F.struct(file, F.col("_metadata.row_index").alias("at")))
    number = F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("at"))
    return as_table(docs.withColumn(ROW, number), "numbered")


def _from_files(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, perhaps filtered, with columns chosen or renamed."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    if not node.nodeName().startswith("LogicalRelation") and "LogicalRelation" not in node.getClass().getName():
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except Exception:  # no such columns: another source, or one of the same name
        return False
    return True


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The numbered rows that `dropped` does not name, without their number. Few rows
    are dropped as a rule, so Spark can send their numbers to all tasks where its
    size check allows it, and texts stay where they are."""
    return rows.join(dropped.select(ROW), ROW, "left_anti").drop(ROW)
