"""A persistent index of live identities, so that deduplication does not rebuild them.

One row per identity that a confirm made earliest: a digest of schema and identity
values, and the record. The table is bucketed and sorted by the digest; staged
documents are matched by a sort-merge join that shuffles them alone, and a confirm
appends what its records change. An identity may have several rows, since an older
record can be confirmed after a newer one: the earliest counts, which an
aggregation inside the buckets finds without a shuffle.

Deleting live records is not seen by an index; it is built anew then.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files of a delivery. At 100 TB of records, take thousands.
BUCKETS = 32


def identity_digest() -> Column:
    """32 bytes of schema_id and identity; lengths keep values from running together."""
    parts = F.transform("identity", lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v))
    schema = F.col("schema_id").cast("string")
    return F.unhex(F.sha2(F.concat(F.length(schema).cast("string"), F.lit(":"), schema, F.array_join(parts, "")), 256))


class IdentityIndex:
    """The earliest live record of every identity.

    `name` is a table name, `path` its folder; a path that holds an index from an
    earlier session is opened as it is, with the number of buckets it was made with.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.name, self.buckets = spark, name, buckets
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, created_at TIMESTAMP, id STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def earliest(self) -> DataFrame:
        """digest, first (created_at, id) of every identity; no shuffle."""
        return self.rows().groupBy("digest").agg(F.min(F.struct("created_at", "id")).alias("first"))

    def append(self, live: DataFrame) -> None:
        """Adds what confirmed records change. live: id, schema_id, identity, created_at.

        Records that are no earlier than what the index has add nothing, so a
        delivery that failed half-way is appended again.
        """
        told = F.struct(F.col("created_at").cast("timestamp").alias("created_at"), F.col("id").cast("string").alias("id"))
        brought = (
            live.groupBy(identity_digest().alias("digest")).agg(F.min(told).alias("new")).repartition(self.buckets, "digest")
        )
        known = self.earliest().hint("merge")
        better = brought.join(known, "digest", "left").filter(F.col("first").isNull() | (F.col("new") < F.col("first")))
        (
            better.select("digest", "new.created_at", "new.id")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )

    def match(self, staged: DataFrame) -> DataFrame:
        """document_id, schema_id, identity, matched_record_id of the staged documents
        (document_id, schema_id, identity) whose identity a live record has."""
        asked = staged.select("document_id", "schema_id", "identity", identity_digest().alias("digest")).repartition(self.buckets, "digest")
        return asked.join(self.earliest().hint("merge"), "digest").select(
            "document_id", "schema_id", "identity", F.col("first.id").alias("matched_record_id")
        )
