"""Exact duplicates through a persistent digest index.

The index is a table with one row per distinct text: its digest and the document
that stays. It is bucketed and sorted by digest, so a delivery of new documents
is matched against it by a sort-merge anti-join that neither shuffles nor sorts
the index; what the join leaves is appended. Only digests and ids move, never
texts.

Defined results: a null text counts as empty; rows without a doc_id never win
against rows with one; several rows of one doc_id and one text have one verdict, and
of those that stay the stage keeps one; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.llm.rows import ROW, numbered, without
from paperfold.session import as_table, shared_folder

# Fixed value: the characters that count as white space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

# Buckets of an index; one file each per delivery. At 100 TB of texts, take thousands.
BUCKETS = 32


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space as one blank."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "), 256))


def marks(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest and the columns `keep` of each row."""
    return docs.select("doc_id", digest(F.col("text")).alias("digest"), *keep)


class DigestIndex:
    """Which document stays for each text seen so far.

    `name` is a table name, `path` its folder; a path that holds an index from
    an earlier session is opened as it is. The number of buckets belongs to the
    index and is the same for every delivery.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.name, self.buckets = spark, name, buckets
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, delivery: DataFrame) -> None:
        """Adds what a delivery (doc_id, digest) brings that the index lacks.

        Repeating a delivery that was already appended adds nothing, so a failed
        run is simply run again.
        """
        found = (
            delivery.groupBy("digest")
            .agg(F.min("doc_id").alias("keep_id"))
            .repartition(self.buckets, "digest")
        )
        new = found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )


def verdicts(marked: DataFrame, index: DigestIndex, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each marked row, and its columns `keep`.

    Counting a group combines before it shuffles. Handing its verdict back to
    its members is a plain join of two shuffled sides, which adaptive execution
    splits when one text holds a large part of all rows.
    """
    sizes = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = as_table(sizes.join(index.rows(), "digest"), "copies")
    return marked.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *keep,
    )


def exact_dedup(docs: DataFrame, deliveries: int = 2, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deduplicates a whole table through a new index.

    The rows arrive in `deliveries` by ascending doc_id, so the index holds the
    smallest doc_id of every text; each delivery is matched against what the
    earlier ones left.
    """
    spark = docs.sparkSession
    marked = as_table(marks(docs, keep), "digests")
    folder = shared_folder(spark, "digest-index")
    index = DigestIndex(spark, "digests_" + folder.rsplit("-", 1)[-1], folder, buckets)
    low, high = marked.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        index.append(marked)
        return verdicts(marked, index, keep)
    step = (high - low) // deliveries + 1
    for k in range(deliveries):
        there = F.col("doc_id").between(low + k * step, low + (k + 1) * step - 1)
        index.append(marked.filter(there))
    if marked.filter(F.col("doc_id").isNull()).limit(1).count():
        index.append(marked.filter(F.col("doc_id").isNull()))
    return verdicts(marked, index, keep)


def kept_documents(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    rows = numbered(docs)
    found = as_table(exact_dedup(rows, buckets=buckets, keep=(ROW,)).select("kept", "text_sha256", ROW), "verdicts")
    stay = found.filter("kept").groupBy("text_sha256").agg(F.min(ROW).alias(ROW))
    return without(rows, found.join(stay, ROW, "left_anti"))
