"""Reading records and documents: filters, pages, lists and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("awaiting_review", "confirmed", "rejected", "failed")


def filter_records(view: DataFrame, wanted: dict[str, str | None], columns: list[str]) -> DataFrame:
    """Equality on known column keys, all of them; blank and unknown filters drop out.

    The literal takes the column's type, so a persisted view still prunes by
    column statistics; text that does not cast matches nothing.
    """
    used = {k: v for k, v in wanted.items() if k in columns and v not in (None, "")}
    tests = [
        F.col(k) == F.lit(v).try_cast(view.schema[k].dataType.simpleString()) for k, v in used.items()
    ]
    return view.filter(reduce(lambda a, b: a & b, tests)) if tests else view


def page_records(view: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first; ties broken by document and row."""
    return (
        view.orderBy(F.col("created_at").desc(), "document_id", "row_index")
        .offset(offset)
        .limit(limit)
    )


def page_after(view: DataFrame, last: tuple, limit: int = 50) -> DataFrame:
    """The page after the row with (created_at, document_id, row_index) `last`.

    Unlike a deep offset it never sorts the pages before it.
    """
    at, document, row = (F.lit(value) for value in last)
    older = (F.col("created_at") < at) | (
        (F.col("created_at") == at)
        & ((F.col("document_id") > document) | ((F.col("document_id") == document) & (F.col("row_index") > row)))
    )
    return page_records(view.filter(older), limit)


def total_records(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("total"))


def without_scope_column(view: DataFrame) -> DataFrame:
    return view.drop("topic_ids")


def latest_status(jobs: DataFrame) -> DataFrame:
    """(document_id, status) of the newest job."""
    return jobs.groupBy("document_id").agg(
        F.max_by("status", F.struct("created_at", "job_id")).alias("status")
    )


def list_documents(
    documents: DataFrame,
    jobs: DataFrame,
    document_topics: DataFrame | None = None,
    topic_id: str | None = None,
    schema_id=None,
    statuses: list[str] | None = None,
    order: bool = True,
) -> DataFrame:
    """Documents with their latest status, newest upload first, under the filters given."""
    out = documents if schema_id is None else documents.filter(F.col("schema_id") == F.lit(schema_id))
    if topic_id is not None:
        out = out.join(document_topics.filter(F.col("topic_id") == topic_id), "document_id", "left_semi")
    out = out.join(latest_status(jobs), "document_id", "left")
    if statuses:
        out = out.filter(F.col("status").isin(*statuses))
    return out.orderBy(F.col("uploaded_at").desc(), "document_id") if order else out


def document_detail(documents: DataFrame, records: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per document: its latest record, chunk count and job count."""
    record = records.groupBy("document_id").agg(
        F.max_by("id", F.struct("created_at", "row_index")).alias("latest_record_id"),
        F.count(F.lit(1)).alias("record_count"),
    )
    chunk = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    job = jobs.groupBy("document_id").agg(F.count(F.lit(1)).alias("job_count"))
    return (
        documents.join(record, "document_id", "left")
        .join(chunk, "document_id", "left")
        .join(job, "document_id", "left")
        .fillna(0, ["record_count", "chunk_count", "job_count"])
    )


def batch_summary(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per batch ("ungrouped" without one): documents, jobs, in progress, failed."""
    batch = F.coalesce("batch_id", F.lit("ungrouped")).alias("batch_id")
    docs = documents.groupBy(batch).agg(F.count(F.lit(1)).alias("documents"))
    work = (
        jobs.join(documents.select("document_id", "batch_id"), "document_id")
        .groupBy(batch)
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.count_if(F.col("status").isin("pending", "extracting")).alias("in_progress"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )
    return docs.join(work, "batch_id", "left").fillna(0, ["jobs", "in_progress", "failed"])


def topic_status_counts(document_topics: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents per topic and latest status; `unknown` without a job."""
    return (
        document_topics.join(latest_status(jobs), "document_id", "left")
        .groupBy("topic_id", F.coalesce("status", F.lit("unknown")).alias("status"))
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def emptied_schemas(schemas: DataFrame, records: DataFrame) -> DataFrame:
    return schemas.join(records.select("schema_id").distinct(), "schema_id", "left_anti")


def total_over_header(view: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """SUM of a document-level field: it repeats on every row of a document, so
    one value per document (MAX) is taken before summing."""
    per_document = view.groupBy(*(by or []), "document_id").agg(F.max(column).alias("__value"))
    return per_document.groupBy(*(by or [])).agg(
        F.sum("__value").alias("total"), F.count(F.lit(1)).alias("documents")
    )


def total_over_rows(view: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Plain aggregates of a row-level field; an all-NULL column sums to NULL."""
    return view.groupBy(*(by or [])).agg(
        F.sum(column).alias("total"),
        F.avg(column).alias("average"),
        F.min(column).alias("smallest"),
        F.max(column).alias("largest"),
        F.count(column).alias("filled"),
    )


def top_entity(view: DataFrame, entity: str, column: str, k: int = 1) -> DataFrame:
    """The entities with the highest totals; ties go to the smaller key."""
    return (
        view.groupBy(entity)
        .agg(F.sum(column).alias("total"))
        .orderBy(F.col("total").desc_nulls_last(), entity)
        .limit(k)
    )


def in_date_range(view: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= column < end on the typed date; NULL dates are left out."""
    test: Column = F.col(column).isNotNull()
    if start:
        test = test & (F.col(column) >= F.lit(start).cast("date"))
    if end:
        test = test & (F.col(column) < F.lit(end).cast("date"))
    return view.filter(test)


def json_safe(df: DataFrame) -> DataFrame:
    """Each row as JSON text; types JSON lacks (decimals, dates) go as text."""
    plain = ("string", "boolean", "int", "bigint", "double", "float", "smallint", "tinyint")
    columns = [
        F.col(f"`{f.name}`") if f.dataType.simpleString() in plain or f.dataType.simpleString().startswith(("array", "map", "struct"))
        else F.col(f"`{f.name}`").cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_json"))


def preview_rows(df: DataFrame, order_by: list, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(first rows as JSON text, full count) of a result."""
    return json_safe(df.orderBy(*order_by).limit(limit)), total_records(df)
