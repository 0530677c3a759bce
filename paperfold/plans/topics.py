"""Topic and deletion operators: new states and impact counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.operators import removal, topics
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import Tables, query

_LINKS = f"links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)})"


@query(
    "topics_created",
    """WITH n AS (SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN '  ' || lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' '
      ELSE 'nation ' || c_nationkey END AS name FROM customer),
    f AS (SELECT lower(trim(name)) AS k, arg_min(trim(name), ord) AS first_name FROM n GROUP BY 1)
    SELECT CASE WHEN k LIKE 'nation%' THEN first_name ELSE upper(k) END AS name, k LIKE 'nation%' AS created FROM f""",
)
def topics_created(t):
    names = t.customer.selectExpr(
        "c_custkey AS ord",
        "CASE c_custkey % 3 WHEN 0 THEN '  ' || lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' ' ELSE 'nation ' || c_nationkey END AS name",
    )
    return topics.get_or_create_topics(fx.run(t, fx.TOPICS_SQL), names).select("name", "created")


@query(
    "topic_typeahead",
    "SELECT c_name AS topic_id, c_name AS name FROM customer WHERE lower(c_name) LIKE '%omer#0000000%' ORDER BY name LIMIT 50",
)
def topic_typeahead(t):
    return topics.topic_typeahead(t.customer.selectExpr("c_name AS topic_id", "c_name AS name"), "OMER#0000000")


def _chunks(t: Tables):
    links = fx.run(t, fx.DOCUMENT_TOPICS_SQL).groupBy("document_id").agg(F.sort_array(F.collect_set("topic_id")).alias("topic_ids"))
    lines = t.documents.selectExpr("doc_id AS document_id", "posexplode(split(text, '\\n')) AS (chunk_index, content)")
    return lines.join(links, "document_id", "left").withColumn(
        "topic_ids", F.coalesce("topic_ids", F.array().cast("array<string>"))
    )


def _delete_machinery(t: Tables) -> topics.TopicDeletion:
    batches = t.customer.selectExpr("c_custkey AS batch_id", "array(c_mktsegment, 'x') AS default_topic_ids")
    staged = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS job_id",
        "if(o_orderstatus = 'F', 'confirmed', 'awaiting_review') AS status",
        "array(c_mktsegment, o_orderpriority) AS suggested_topic_ids",
    )
    return topics.delete_topic(
        "MACHINERY", fx.run(t, fx.TOPICS_SQL), fx.run(t, fx.DOCUMENT_TOPICS_SQL), _chunks(t), batches, staged, "Uncategorized"
    )


_GONE = f"""{_LINKS}, gone AS (SELECT DISTINCT document_id FROM links WHERE topic_id = 'MACHINERY'),
  bare AS (SELECT document_id FROM gone WHERE document_id NOT IN (SELECT document_id FROM links WHERE topic_id <> 'MACHINERY')),
  chunks AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content FROM documents)"""


@query(
    "topic_deletion_impact",
    f"""WITH {_GONE} SELECT 'unlinked_documents' AS impact, count(*) AS n FROM gone
    UNION ALL SELECT 'uncategorized_documents', count(*) FROM bare
    UNION ALL SELECT 'resynced_chunks', count(*) FROM chunks WHERE document_id IN (SELECT document_id FROM gone)
    UNION ALL SELECT 'cleared_jobs', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_mktsegment = 'MACHINERY'""",
)
def topic_deletion_impact(t):
    return _delete_machinery(t).impact


@query(
    "topic_deletion_links",
    f"""WITH {_GONE} SELECT document_id, topic_id FROM links WHERE topic_id <> 'MACHINERY'
    UNION ALL SELECT document_id, 'Uncategorized' FROM bare""",
)
def topic_deletion_links(t):
    return _delete_machinery(t).document_topics


@query(
    "topic_deletion_chunks",
    f"""WITH {_GONE}, after AS (SELECT document_id, topic_id FROM links WHERE topic_id <> 'MACHINERY' UNION ALL SELECT document_id, 'Uncategorized' FROM bare),
    a AS (SELECT document_id, string_agg(topic_id, ',' ORDER BY topic_id) AS topics FROM after GROUP BY 1)
    SELECT document_id, count(*) AS chunks, COALESCE(any_value(topics), '') AS topic_ids FROM chunks LEFT JOIN a USING (document_id) GROUP BY 1""",
)
def topic_deletion_chunks(t):
    return _delete_machinery(t).chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.array_join(F.any_value("topic_ids"), ",").alias("topic_ids")
    )


# --- Removal --------------------------------------------------------------------


def _tables(t: Tables) -> dict:
    """Orders as documents of customer batches, lines as records, first texts as chunks."""
    records = fx.order_lines_raw(t).selectExpr(
        "document_id || '-' || row_index AS id",
        "document_id",
        "l_suppkey AS schema_id",
        "row_index",
        "if(document_id % 5 = 0, (document_id - 1) || '-0', NULL) AS is_duplicate_of",
    )
    return {
        "documents": t.orders.selectExpr("o_orderkey AS document_id", "o_custkey AS batch_id"),
        "records": records,
        "chunks": t.documents.selectExpr("doc_id AS document_id", "text AS content"),
        "document_topics": fx.run(t, fx.DOCUMENT_TOPICS_SQL),
        "jobs": t.orders.selectExpr(
            "o_orderkey AS job_id", "o_orderkey AS document_id", "o_custkey AS batch_id",
            "if(o_orderstatus = 'F', 'confirmed', 'pending') AS status",
        ),
        "batches": t.customer.selectExpr("c_custkey AS batch_id"),
    }


_PURGED = "doomed AS (SELECT o_orderkey AS document_id FROM orders WHERE o_totalprice > 100000)"


@query(
    "purge_impact",
    f"""WITH {_PURGED}, left_docs AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT document_id FROM doomed)),
    r AS (SELECT l_suppkey AS schema_id, l_orderkey IN (SELECT document_id FROM doomed) AS gone FROM lineitem)
    SELECT 'documents' AS impact, count(*) AS n FROM doomed
    UNION ALL SELECT 'records', count(*) FROM r WHERE gone
    UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id IN (SELECT document_id FROM doomed)
    UNION ALL SELECT 'jobs', count(*) FROM doomed
    UNION ALL SELECT 'batches', count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey
      WHERE o_orderkey IN (SELECT document_id FROM doomed) AND o_custkey NOT IN (SELECT o_custkey FROM left_docs)
    UNION ALL SELECT 'emptied_schemas', count(*) FROM (SELECT schema_id FROM r GROUP BY 1 HAVING bool_and(gone)) q""",
)
def purge_impact(t):
    doomed = t.orders.filter("o_totalprice > 100000").selectExpr("o_orderkey AS document_id")
    return removal.purge_documents(doomed, _tables(t))["impact"]


@query(
    "purged_records",
    f"""WITH {_PURGED}, {fx.R1} SELECT document_id || '-' || row_index AS id, CASE WHEN document_id % 5 = 0
      AND NOT EXISTS (SELECT 1 FROM doomed d WHERE d.document_id = r1.document_id - 1
                      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = d.document_id))
      THEN (document_id - 1) || '-0' END AS is_duplicate_of
    FROM r1 WHERE amount IS NOT NULL AND document_id NOT IN (SELECT document_id FROM doomed)""",
)
def purged_records(t):
    doomed = t.orders.filter("o_totalprice > 100000").selectExpr("o_orderkey AS document_id")
    return removal.purge_documents(doomed, _tables(t))["records"].select("id", "is_duplicate_of")


@query(
    "batch_purge",
    """WITH docs AS (SELECT o_orderkey AS document_id, o_orderstatus AS s FROM orders WHERE o_custkey = 7),
    c AS (SELECT *, s = 'F' OR document_id IN (SELECT l_orderkey FROM lineitem) OR document_id IN (SELECT doc_id FROM documents) AS committed FROM docs)
    SELECT document_id FROM c WHERE committed""",
)
def batch_purge(t):
    return removal.purge_batch(7, _tables(t))["kept_documents"]


def _drop(t: Tables) -> dict:
    tables = {
        "schemas": fx.part_schemas(t),
        "versions": fx.part_versions(t),
        "records": t.lineitem.selectExpr(
            "l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id", "l_partkey AS schema_id", "CAST(NULL AS STRING) AS is_duplicate_of"
        ),
        "documents": t.orders.selectExpr("o_orderkey AS document_id", "o_custkey AS schema_id", "1 AS schema_version_id"),
        "batches": t.customer.selectExpr("c_custkey AS batch_id", "c_nationkey AS default_schema_id"),
        "staged": t.orders.selectExpr(
            "o_orderkey AS job_id", "if(o_orderstatus = 'F', 'confirmed', 'awaiting_review') AS status",
            "o_custkey AS matched_schema_id", "1 AS schema_version_id",
        ),
    }
    return removal.drop_schema(8, tables)


@query(
    "schema_drop_impact",
    """SELECT 'records' AS impact, count(*) AS n FROM lineitem WHERE l_partkey = 8
    UNION ALL SELECT 'versions', 8 % 3 + 1
    UNION ALL SELECT 'documents', count(*) FROM orders WHERE o_custkey = 8
    UNION ALL SELECT 'jobs', count(*) FROM orders WHERE o_custkey = 8 AND o_orderstatus <> 'F'""",
)
def schema_drop_impact(t):
    return _drop(t)["impact"]


@query(
    "schema_drop_staged",
    """SELECT o_orderkey AS job_id, CASE WHEN o_custkey <> 8 OR o_orderstatus = 'F' THEN o_custkey END AS matched_schema_id,
    CASE WHEN o_custkey <> 8 OR o_orderstatus = 'F' THEN 1 END AS schema_version_id FROM orders""",
)
def schema_drop_staged(t):
    return _drop(t)["staged"].select("job_id", "matched_schema_id", "schema_version_id")


@query(
    "record_deleted",
    """SELECT o_orderkey || '-r' AS id, CASE WHEN o_orderkey % 5 <> 3 AND o_orderkey > 7 THEN '7-r' WHEN o_orderkey % 5 = 3 THEN '4-r' END AS is_duplicate_of
    FROM orders WHERE o_orderkey <> 7""".replace("'7-r'", "CAST(NULL AS VARCHAR)"),
)
def record_deleted(t):
    records = t.orders.selectExpr(
        "o_orderkey || '-r' AS id",
        "'orders' AS schema_id",
        "CASE WHEN o_orderkey % 5 = 3 THEN '4-r' WHEN o_orderkey > 7 THEN '7-r' END AS is_duplicate_of",
    )
    return removal.delete_record("orders", "7-r", records).select("id", "is_duplicate_of")
