"""Topics: get-or-create, typeahead and deletion, set-based.

topics: topic_id, name; document_topics: document_id, topic_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.operators.confirm import UNCATEGORIZED
from paperfold.operators.retrieval import resync_chunk_topics

STAGED = ("pending", "extracting", "awaiting_review", "failed")


def get_or_create_topics(topics: DataFrame, names: DataFrame) -> DataFrame:
    """(topic_id, name, created) for asked names (ord, name), ignoring case and outer blanks.

    The first spelling wins, so an existing topic keeps its own.
    """
    asked = names.withColumn("name", F.trim("name")).withColumn("__key", F.lower("name"))
    firsts = asked.groupBy("__key").agg(F.min_by("name", "ord").alias("__first"))
    have = topics.select(F.lower("name").alias("__key"), "topic_id", F.col("name").alias("__have"))
    new_id = F.substring(F.sha2("__key", 256), 1, 32)
    return firsts.join(have, "__key", "left").select(
        F.coalesce("topic_id", new_id).alias("topic_id"),
        F.coalesce("__have", "__first").alias("name"),
        F.col("topic_id").isNull().alias("created"),
    )


def topic_typeahead(topics: DataFrame, text: str | None = None, ids: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Topics whose name contains the text, by name; an id list ignores text and limit."""
    if ids:
        return topics.filter(F.col("topic_id").isin(*ids)).orderBy("name", "topic_id")
    hits = topics.filter(F.lower("name").contains(text.lower())) if text else topics
    return hits.orderBy("name", "topic_id").limit(limit)


@dataclass
class TopicDeletion:
    """New state of every table a topic deletion touches, and its four counts."""

    topics: DataFrame
    document_topics: DataFrame
    chunks: DataFrame
    batches: DataFrame
    staged: DataFrame
    impact: DataFrame


def delete_topic(
    topic_id: str,
    topics: DataFrame,
    document_topics: DataFrame,
    chunks: DataFrame,
    batches: DataFrame,
    staged: DataFrame,
    uncategorized_id: str,
) -> TopicDeletion:
    """Removes a label, never what was filed under it.

    A document left bare is filed under the fallback topic; chunk copies follow
    the links; the id leaves batch hints and staged suggestions.
    batches: batch_id, default_topic_ids; staged: job_id, status, suggested_topic_ids.
    """
    # The topics table holds names only, so one row of it can be looked at here.
    row = topics.filter(F.col("topic_id") == topic_id).select("name").first()
    if row is None:
        raise LookupError("topic not found")
    if row["name"] == UNCATEGORIZED:
        raise ValueError(f"{UNCATEGORIZED!r} is the fallback topic and cannot be deleted")

    unlinked = document_topics.filter(F.col("topic_id") == topic_id).select("document_id").distinct()
    left = document_topics.filter(F.col("topic_id") != topic_id)
    bare = unlinked.join(left.select("document_id").distinct(), "document_id", "left_anti")
    links = left.unionByName(bare.withColumn("topic_id", F.lit(uncategorized_id)))

    touched = chunks.join(unlinked, "document_id", "left_semi")
    untouched = chunks.join(unlinked, "document_id", "left_anti")
    resynced = resync_chunk_topics(touched, links.join(unlinked, "document_id", "left_semi"))
    hit = F.col("status").isin(*STAGED) & F.array_contains("suggested_topic_ids", topic_id)

    counts = [
        unlinked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unlinked_documents").alias("impact"), "n"),
        bare.agg(F.count(F.lit(1)).alias("n")).select(F.lit("uncategorized_documents").alias("impact"), "n"),
        touched.agg(F.count(F.lit(1)).alias("n")).select(F.lit("resynced_chunks").alias("impact"), "n"),
        staged.filter(hit).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cleared_jobs").alias("impact"), "n"),
    ]
    impact = counts[0]
    for count in counts[1:]:
        impact = impact.unionByName(count)
    return TopicDeletion(
        topics=topics.filter(F.col("topic_id") != topic_id),
        document_topics=links,
        chunks=untouched.unionByName(resynced.select(*chunks.columns)),
        batches=batches.withColumn("default_topic_ids", F.array_remove("default_topic_ids", topic_id)),
        staged=staged.withColumn(
            "suggested_topic_ids",
            F.when(hit, F.array_remove("suggested_topic_ids", topic_id)).otherwise(F.col("suggested_topic_ids")),
        ),
        impact=impact,
    )
