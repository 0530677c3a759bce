"""Deleting documents, batches, schemas and records: new table states and counts.

Each function returns a dict of the tables it changes, computed functionally,
plus `impact` (impact, n). Files are immutable, so a caller writes the states
and swaps them in (`sources.sinks.replace_table`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.operators.confirm import detach_duplicates
from paperfold.operators.topics import STAGED


def _impact(**counted: DataFrame) -> DataFrame:
    rows = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("impact"), "n")
        for name, df in counted.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("schema_id").distinct().join(after.select("schema_id").distinct(), "schema_id", "left_anti")


def purge_documents(doomed: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Erases documents (document_id) and all derived rows; a batch left empty goes too.

    tables: documents, records, chunks, document_topics, jobs, batches.
    """
    ids = doomed.select("document_id").distinct()
    gone = {n: tables[n].join(ids, "document_id", "left_semi") for n in ("documents", "records", "chunks", "jobs")}
    kept = {
        n: tables[n].join(ids, "document_id", "left_anti")
        for n in ("documents", "records", "chunks", "document_topics", "jobs")
    }
    kept["records"] = detach_duplicates(kept["records"], gone["records"])
    referenced = kept["documents"].select("batch_id").unionByName(kept["jobs"].select("batch_id")).distinct()
    candidates = gone["documents"].select("batch_id").distinct().join(referenced, "batch_id", "left_anti")
    kept["batches"] = tables["batches"].join(candidates, "batch_id", "left_anti")
    kept["impact"] = _impact(
        documents=gone["documents"],
        records=gone["records"],
        chunks=gone["chunks"],
        jobs=gone["jobs"],
        batches=tables["batches"].join(candidates, "batch_id", "left_semi"),
        emptied_schemas=_emptied(gone["records"], kept["records"]),
    )
    return kept


def committed_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """Documents with a confirmed job, a record or a chunk."""
    return (
        tables["jobs"].filter("status = 'confirmed'").select("document_id")
        .unionByName(tables["records"].select("document_id"))
        .unionByName(tables["chunks"].select("document_id"))
        .distinct()
    )


def purge_batch(batch_id, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Discards the unconfirmed documents of a batch; committed ones stay and are listed."""
    members = tables["documents"].filter(F.col("batch_id") == batch_id).select("document_id")
    committed = committed_documents(tables)
    doomed = members.join(committed, "document_id", "left_anti")
    state = purge_documents(doomed, tables)
    state["kept_documents"] = members.join(committed, "document_id", "left_semi")
    return state


def drop_schema(schema_id, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Deletes a lineage and its records; documents are detached, chunks survive.

    tables: schemas, versions, records, documents, batches (default_schema_id),
    staged (job_id, status, matched_schema_id, schema_version_id).
    """
    own = F.col("schema_id") == schema_id
    doomed = tables["records"].filter(own)
    # Either reference would break a later confirm, so either clears the match.
    matched = F.col("status").isin(*STAGED) & F.coalesce(F.col("matched_schema_id") == schema_id, F.lit(False))
    detached = tables["documents"].filter(own)
    nothing = F.lit(None)
    return {
        "schemas": tables["schemas"].filter(~own),
        "versions": tables["versions"].filter(~own),
        "records": detach_duplicates(tables["records"].filter(~own), doomed),
        "documents": tables["documents"].withColumns(
            {
                "schema_version_id": F.when(own, nothing).otherwise(F.col("schema_version_id")),
                "schema_id": F.when(own, nothing).otherwise(F.col("schema_id")),
            }
        ),
        "batches": tables["batches"].withColumn(
            "default_schema_id",
            F.when(F.col("default_schema_id") == schema_id, nothing).otherwise(F.col("default_schema_id")),
        ),
        "staged": tables["staged"].withColumns(
            {
                "schema_version_id": F.when(matched, nothing).otherwise(F.col("schema_version_id")),
                "matched_schema_id": F.when(matched, nothing).otherwise(F.col("matched_schema_id")),
            }
        ),
        "impact": _impact(
            records=doomed,
            versions=tables["versions"].filter(own),
            documents=detached,
            jobs=tables["staged"].filter(matched),
        ),
    }


def delete_record(schema_id, record_id, records: DataFrame) -> DataFrame:
    """Drops one record of the schema; pointers to it become NULL.

    A record of another schema is not touched.
    """
    doomed = (F.col("schema_id") == schema_id) & (F.col("id") == record_id)
    return detach_duplicates(records.filter(~doomed), records.filter(doomed).select("id"))
