"""New files become documents with a pending job, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.sources.files import document_inventory

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_ingest_stream(spark: SparkSession, folder: str, batch_id: str, glob: str = "*") -> DataFrame:
    """Streaming inventory of the files arriving in `folder`."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", 10_000)
        .load(folder)
    )
    named = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return document_inventory(named, F.lit(batch_id))


def file_or_folder(path: str) -> str:
    """`path` as a pattern that a file stream takes whether it is one file or a folder of files."""
    return f"{path[:-1]}[{path[-1]}]"


def run_to_end(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, writes parquet and stops."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
