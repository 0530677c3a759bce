"""Confirming staged documents: the only writer of live records and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.ordering import ordered_index
from paperfold.operators.extraction import ROW_SLICE

UNCATEGORIZED = "Uncategorized"


def confirm_outcome(staged: DataFrame, schemas: DataFrame, versions: DataFrame) -> DataFrame:
    """What confirming each staged document does.

    staged: document_id, status, has_proposed_fields, save_schema_as,
    matched_schema_id, schema_version_id, cells. Outcomes: new_schema, records,
    chunks_only (cells are dropped, and counted), or error with its reason.
    """
    named = schemas.select(F.col("name").alias("save_schema_as"), F.lit(True).alias("__taken")).distinct()
    live = versions.select(
        F.col("schema_id").alias("matched_schema_id"),
        F.col("version").alias("schema_version_id"),
        F.lit(True).alias("__exists"),
    )
    looked = staged.join(named, "save_schema_as", "left").join(
        live, ["matched_schema_id", "schema_version_id"], "left"
    )
    promote = F.col("has_proposed_fields") & (F.coalesce("save_schema_as", F.lit("")) != "")
    matched = F.col("matched_schema_id").isNotNull()
    error = (
        F.when(F.col("status") != "awaiting_review", "not awaiting review")
        .when(promote & F.col("__taken"), "schema name exists")
        .when(~promote & matched & F.col("schema_version_id").isNull(), "no schema version")
        .when(~promote & matched & F.col("__exists").isNull(), "schema no longer exists")
    )
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when(promote, "new_schema")
        .when(matched, "records")
        .otherwise("chunks_only")
    )
    return (
        looked.withColumn("error", error)
        .withColumn("outcome", outcome)
        .select(
            "document_id",
            "outcome",
            "error",
            F.when(F.col("outcome") == "chunks_only", F.col("cells")).otherwise(F.lit(0)).alias("discarded_cells"),
        )
    )


def materialize(documents: DataFrame, records: DataFrame) -> DataFrame:
    """At least one record per confirmed document: `{}` when it staged none.

    records: document_id, position, data (already coerced once more, since
    values may have been typed by hand on review).
    """
    staged = records.select("document_id").distinct()
    empty = documents.join(staged, "document_id", "left_anti").select(
        "document_id", F.lit(0).alias("position"), F.create_map().cast("map<string,string>").alias("data")
    )
    return records.select("document_id", "position", "data").unionByName(empty)


def insert_records(
    staged: DataFrame,
    schema_id: Column,
    schema_version_id: Column,
    created_at: Column,
    start_index: int = 0,
    is_duplicate_of: Column | None = None,
) -> DataFrame:
    """Live records from staged ones (document_id, position, data): row_index is
    the position among the document's records, from `start_index`."""
    indexed = ordered_index(
        staged, ["document_id"], ["position"], F.floor(F.col("position") / ROW_SLICE), "row_index"
    )
    row_index = F.col("row_index") + start_index
    return indexed.select(
        record_id(F.col("document_id"), schema_id, row_index).alias("id"),
        "document_id",
        schema_id.alias("schema_id"),
        schema_version_id.alias("schema_version_id"),
        row_index.cast("int").alias("row_index"),
        "data",
        (is_duplicate_of if is_duplicate_of is not None else F.lit(None).cast("string")).alias("is_duplicate_of"),
        created_at.alias("created_at"),
    )


def record_id(document_id: Column, schema_id: Column, row_index: Column) -> Column:
    """A readable id that re-running a task gives again."""
    return F.concat_ws("-", document_id.cast("string"), schema_id.cast("string"), row_index.cast("string"))


def detach_duplicates(records: DataFrame, doomed: DataFrame) -> DataFrame:
    """Nulls is_duplicate_of where it points at a record about to go (id)."""
    gone = doomed.select(F.col("id").alias("is_duplicate_of")).distinct().withColumns(
        {"__gone": F.lit(True), "__deal": F.xxhash64(F.col("is_duplicate_of").cast("string"))}
    )
    # Most records point nowhere: without a second key they would all go to one task.
    own = F.xxhash64("id")
    deal = F.when(F.col("is_duplicate_of").isNull(), own).otherwise(F.xxhash64(F.col("is_duplicate_of").cast("string")))
    return (
        records.withColumn("__deal", deal)
        .join(gone, ["is_duplicate_of", "__deal"], "left")
        .withColumn("is_duplicate_of", F.when(F.col("__gone").isNull(), F.col("is_duplicate_of")))
        .select(*records.columns)
    )


def backfill_replace(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """New table state: the whole record set of each re-read (document, schema)
    is replaced, whatever its row count, and pointers to old rows are cut."""
    touched = fresh.select("document_id", "schema_id").distinct()
    doomed = records.join(touched, ["document_id", "schema_id"], "left_semi")
    kept = records.join(touched, ["document_id", "schema_id"], "left_anti")
    return detach_duplicates(kept, doomed).unionByName(fresh.select(*records.columns))


def dedup_apply(records: DataFrame, staged: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table state, errors) after confirming documents that matched a record.

    staged: record columns of the new documents, row_index from 0
    decisions: document_id, matched_record_id, decision
    keep_both (default): inserted, every row pointing at the match. skip:
    nothing. A match that does not exist is an error, and its document inserts
    nothing; one that another decision strands is a match no longer, so the
    pointer to it is empty. replace: the match keeps its id but takes row 0 of the new
    document; its document's other rows go; rows 1.. are inserted. Two new
    documents replacing one record: the smaller document_id wins, the other
    reports that its match is gone. Anything else is an error.
    """
    decided = decisions.withColumn("decision", F.coalesce("decision", F.lit("keep_both")))
    known = decided.filter(F.col("decision").isin("keep_both", "skip", "replace"))
    exists = known.join(
        records.select(
            F.col("id").alias("matched_record_id"), F.col("document_id").alias("__old_doc"), "schema_id"
        ),
        "matched_record_id",
        "left",
    )
    winners = (
        exists.filter("decision = 'replace' AND __old_doc IS NOT NULL")
        .groupBy("matched_record_id")
        .agg(
            F.min("document_id").alias("document_id"),
            F.first("__old_doc").alias("__old_doc"),
            F.first("schema_id").alias("schema_id"),
        )
    )
    vanished = exists.filter("decision = 'keep_both' AND __old_doc IS NULL").select(
        "document_id", F.lit("matched record no longer exists").alias("error")
    )
    lost = (
        exists.filter("decision = 'replace'")
        .join(winners.select("document_id", "matched_record_id"), ["document_id", "matched_record_id"], "left_anti")
        .select("document_id", F.lit("matched record no longer exists").alias("error"))
    )
    unknown = decided.filter(~F.col("decision").isin("keep_both", "skip", "replace")).select(
        "document_id", F.concat(F.lit("unknown dedup_decision "), "decision").alias("error")
    )

    keep = staged.join(
        exists.filter("decision = 'keep_both' AND __old_doc IS NOT NULL").select("document_id", "matched_record_id"),
        "document_id",
    ).withColumn("is_duplicate_of", F.col("matched_record_id"))
    placed = staged.join(winners.select("document_id", "matched_record_id"), "document_id")
    swapped = placed.filter("row_index = 0").select(
        F.col("matched_record_id").alias("__id"),
        F.col("document_id").alias("__document_id"),
        F.col("schema_version_id").alias("__version"),
        F.col("data").alias("__data"),
    )
    # Rows of the replaced documents other than the matched ones are stranded.
    matched_ids = winners.select(F.col("matched_record_id").alias("id"))
    stranded = records.join(
        winners.select(F.col("__old_doc").alias("document_id"), "schema_id").distinct(),
        ["document_id", "schema_id"],
        "left_semi",
    ).join(matched_ids, "id", "left_anti")
    kept = records.join(stranded.select("id"), "id", "left_anti").select(*records.columns)
    in_place = (
        kept.join(swapped, F.col("id") == F.col("__id"), "left")
        .withColumns(
            {
                "document_id": F.coalesce("__document_id", "document_id"),
                "schema_version_id": F.coalesce("__version", "schema_version_id"),
                "row_index": F.when(F.col("__id").isNotNull(), F.lit(0)).otherwise(F.col("row_index")),
                "data": F.coalesce("__data", "data"),
            }
        )
        .select(*records.columns)
    )
    tail = placed.filter("row_index > 0").select(*records.columns)
    state = in_place.unionByName(keep.select(*records.columns)).unionByName(tail)
    # Old rows and those just inserted may both point at a stranded row.
    return detach_duplicates(state, stranded), lost.unionByName(vanished).unionByName(unknown)


def link_topics(
    staged_topics: DataFrame, confirmed: DataFrame, existing: DataFrame, fallback: Column
) -> DataFrame:
    """Links to add: (document_id, topic_id) not there yet.

    staged_topics holds live suggestions and accepted new topics; a confirmed
    document with none of them is filed under the fallback topic.
    """
    bare = confirmed.select("document_id").join(
        staged_topics.select("document_id").distinct(), "document_id", "left_anti"
    ).select("document_id", fallback.alias("topic_id"))
    wanted = staged_topics.select("document_id", "topic_id").distinct().unionByName(bare)
    return wanted.join(existing, ["document_id", "topic_id"], "left_anti")


def load_chunks(staged: DataFrame, document_topics: DataFrame) -> DataFrame:
    """Live chunks from `chunks` arrays: index by order, topics copied at confirm."""
    topics = document_topics.groupBy("document_id").agg(F.sort_array(F.collect_set("topic_id")).alias("topic_ids"))
    return (
        staged.join(topics, "document_id", "left")
        .withColumn("topic_ids", F.coalesce("topic_ids", F.array().cast("array<string>")))
        .select("document_id", "topic_ids", F.posexplode("chunks").alias("chunk_index", "chunk"))
        .select("document_id", "chunk_index", "chunk.*", "topic_ids")
    )
