"""Business duplicates: documents that carry the same identity values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identity_values(cells: DataFrame, identity_fields: list[str]) -> DataFrame:
    """(document_id, field, value, disagrees): first non-null value by row.

    Later rows may disagree after edits; the first is kept and the fact shown.
    """
    return (
        cells.filter(F.col("field").isin(*identity_fields) & F.col("value").isNotNull())
        .groupBy("document_id", "field")
        .agg(
            F.min_by("value", "row_index").alias("value"),
            (F.min("value") != F.max("value")).alias("disagrees"),
        )
    )


def identity_tuple(identities: DataFrame, identity_fields: list[str]) -> DataFrame:
    """(document_id, identity array) for documents that have ALL identity values."""
    values = identities.groupBy("document_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{i}") for i, f in enumerate(identity_fields)]
    )
    columns = [F.col(f"__{i}") for i in range(len(identity_fields))]
    complete = columns[0].isNotNull()
    for column in columns[1:]:
        complete = complete & column.isNotNull()
    return values.filter(complete).select("document_id", F.array(*columns).alias("identity"))


def row_identities(rows: DataFrame, identity_fields: list[str]) -> DataFrame:
    """(document_id, identity array) of flattened records that have ALL identity
    values: per field the first non-null value by row, read from the map."""
    values = rows.select(
        "document_id", "row_index", *[F.try_element_at("data", F.lit(f)).alias(f"__{i}") for i, f in enumerate(identity_fields)]
    )
    columns = [F.col(f"__{i}") for i in range(len(identity_fields))]
    first = [F.min_by(c, F.when(c.isNotNull(), F.col("row_index"))).alias(f"__{i}") for i, c in enumerate(columns)]
    identity = F.array(*columns)
    return (
        values.groupBy("document_id").agg(*first)
        .select("document_id", identity.alias("identity"))
        .filter(~F.exists("identity", lambda v: v.isNull()))
    )


def record_identities(records: DataFrame, fields: DataFrame, identity_columns: DataFrame) -> DataFrame:
    """Identity of live records, each read under the names of its own version.

    identity_columns: schema_id, column, ord. A version that does not declare
    one of them gives a NULL and so never matches.
    """
    names = (
        identity_columns.join(fields.select("schema_id", "column", "version", "name"), ["schema_id", "column"])
        .groupBy("schema_id", F.col("version").alias("schema_version_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda e: e["name"]).alias("__names"))
    )
    wanted = identity_columns.groupBy("schema_id").agg(F.count(F.lit(1)).cast("int").alias("__wanted"))
    read = F.transform("__names", lambda n: F.try_element_at(F.col("data"), n))
    return (
        records.join(names.join(wanted, "schema_id").filter("size(__names) = __wanted"), ["schema_id", "schema_version_id"])
        .withColumn("identity", read)
        .filter(~F.exists("identity", lambda v: v.isNull()))
        .drop("__names", "__wanted")
    )


def dedup_match(staged: DataFrame, live: DataFrame) -> DataFrame:
    """The earliest live record with the staged document's identity.

    staged: document_id, schema_id, identity; live: id, schema_id, identity,
    created_at. Live records are reduced to one per identity before the join,
    so an identity shared by very many records meets each document once.
    """
    earliest = live.groupBy("schema_id", "identity").agg(
        F.min(F.struct("created_at", "id")).alias("first")
    )
    return staged.join(earliest, ["schema_id", "identity"]).select(
        "document_id", "schema_id", "identity", F.col("first.id").alias("matched_record_id")
    )


def dedup_banner(matches: DataFrame, records: DataFrame, fields: DataFrame, identity_columns: DataFrame) -> DataFrame:
    """Per match and identity field: the label now, and the matched record's value
    read under the name its own version used."""
    latest = fields.groupBy("schema_id", "column").agg(F.max_by("name", "version").alias("label"))
    own = fields.select(
        "schema_id", "column", F.col("version").alias("schema_version_id"), F.col("name").alias("__name")
    )
    matched = matches.select("document_id", F.col("matched_record_id").alias("id")).join(
        records.select("id", "schema_id", "schema_version_id", "data"), "id"
    )
    return (
        matched.join(identity_columns.select("schema_id", "column"), "schema_id")
        .join(latest, ["schema_id", "column"])
        .join(own, ["schema_id", "column", "schema_version_id"], "left")
        .select(
            "document_id",
            F.col("id").alias("matched_record_id"),
            "label",
            F.try_element_at("data", F.coalesce("__name", F.lit(""))).alias("value"),
        )
    )


def batch_twins(staged: DataFrame) -> DataFrame:
    """Unconfirmed documents sharing an identity with another (document_id, identity).

    Counted first; only identities seen twice go back to the documents.
    """
    shared = (
        staged.groupBy("identity")
        .agg(F.count(F.lit(1)).alias("twins"), F.min("document_id").alias("first_document_id"))
        .filter("twins > 1")
    )
    return staged.join(shared, "identity")
