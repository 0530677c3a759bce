"""Typed view, safe casts, browsing and totals over the orders lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.operators import browse, views
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import Tables, query


def order_view(t: Tables, topics: bool = False):
    """The stored view; browsing it reads typed columns."""
    rows = fx.order_views(t).rows("view_orders", fx.order_specs(t))
    return views.with_topics(rows, fx.run(t, fx.DOCUMENT_TOPICS_SQL)) if topics else rows


def order_header(t: Tables):
    return fx.order_views(t).header("view_orders", fx.order_specs(t))


_LINKS = f"links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)})"


@query(
    "header_field_total",
    f"""WITH {fx.R1}, d AS (SELECT document_id, max(total) AS v FROM r1 GROUP BY document_id)
    SELECT CAST(sum(v) AS DOUBLE) AS total, count(*) AS documents FROM d""",
)
def header_field_total(t):
    return browse.total_over_header(order_header(t), fx.TOTAL).select(F.col("total").cast("double").alias("total"), "documents")


@query(
    "row_field_totals",
    f"""WITH {fx.R1} SELECT status, CAST(sum(amount) AS DOUBLE) AS total, CAST(min(amount) AS DOUBLE) AS smallest,
    CAST(max(amount) AS DOUBLE) AS largest, count(amount) AS filled FROM r1 GROUP BY status""",
)
def row_field_totals(t):
    totals = browse.total_over_rows(order_view(t).withColumnRenamed(fx.STATUS, "status"), fx.AMOUNT, ["status"])
    return totals.select("status", *[F.col(c).cast("double").alias(c) for c in ("total", "smallest", "largest")], "filled")


@query(
    "top_customer",
    f"""WITH {fx.R1} SELECT customer, CAST(sum(amount) AS DOUBLE) AS total FROM r1 GROUP BY customer
    ORDER BY sum(amount) DESC NULLS LAST, customer LIMIT 1""",
)
def top_customer(t):
    top = browse.top_entity(order_view(t).withColumnRenamed(fx.CUSTOMER, "customer"), "customer", fx.AMOUNT)
    return top.select(F.col("customer").cast("bigint").alias("customer"), F.col("total").cast("double").alias("total"))


@query(
    "shipped_in_range",
    f"""WITH {fx.R1} SELECT CAST(year(ship_date) AS INT) AS ship_year, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total
    FROM r1 WHERE ship_date >= DATE '1998-01-01' AND ship_date < DATE '2000-07-01' GROUP BY 1""",
)
def shipped_in_range(t):
    chosen = browse.in_date_range(order_view(t), fx.SHIP_DATE, "1998-01-01", "2000-07-01")
    return chosen.groupBy(F.year(fx.SHIP_DATE).alias("ship_year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fx.AMOUNT).cast("double").alias("total")
    )


@query(
    "null_honest_total",
    f"""WITH {fx.R1} SELECT version, CAST(sum(points) AS BIGINT) AS points, count(*) AS n FROM r1 GROUP BY version""",
)
def null_honest_total(t):
    # Versions 1 and 2 do not declare the field: their total is NULL, not 0.
    return order_view(t).groupBy(F.col("schema_version_id").alias("version")).agg(
        F.sum(fx.POINTS).cast("bigint").alias("points"), F.count(F.lit(1)).alias("n")
    )


@query(
    "typed_view_rows",
    f"""WITH {fx.R1} SELECT document_id, row_index, version, CAST(total AS DOUBLE) AS total, CAST(points AS INT) AS points,
    order_date, status, CAST(amount AS DOUBLE) AS amount, ship_date FROM r1""",
)
def typed_view_rows(t):
    return views.typed_view(fx.order_records(t), fx.order_specs(t)).select(
        "document_id",
        "row_index",
        F.col("schema_version_id").alias("version"),
        F.col(fx.TOTAL).cast("double").alias("total"),
        F.col(fx.POINTS).alias("points"),
        F.col(fx.ORDER_DATE).alias("order_date"),
        F.col(fx.STATUS).alias("status"),
        F.col(fx.AMOUNT).cast("double").alias("amount"),
        F.col(fx.SHIP_DATE).alias("ship_date"),
    )


@query(
    "view_bookkeeping_columns",
    f"""WITH {fx.R1} SELECT document_id || '-' || row_index AS id, document_id, row_index, version AS schema_version_id,
    CAST(NULL AS VARCHAR) AS is_duplicate_of FROM r1""",
)
def view_bookkeeping_columns(t):
    return order_view(t).select("id", "document_id", "row_index", "schema_version_id", "is_duplicate_of")


@query(
    "records_with_topics",
    f"""WITH {fx.R1}, {_LINKS}, arr AS (SELECT document_id, string_agg(topic_id, ',' ORDER BY topic_id) AS topics
    FROM links GROUP BY document_id)
    SELECT r1.document_id, row_index, COALESCE(topics, '') AS topics FROM r1 LEFT JOIN arr USING (document_id)""",
)
def records_with_topics(t):
    return order_view(t, topics=True).select(
        "document_id", "row_index", F.array_join("topic_ids", ",").alias("topics")
    )


@query(
    "additive_evolution",
    f"""WITH {fx.R1} SELECT version, count(total) AS totals, count(points) AS points, count(amount) AS amounts
    FROM r1 GROUP BY version""",
)
def additive_evolution(t):
    return order_view(t).groupBy(F.col("schema_version_id").alias("version")).agg(
        F.count(fx.TOTAL).alias("totals"), F.count(fx.POINTS).alias("points"), F.count(fx.AMOUNT).alias("amounts")
    )


@query(
    "typed_cells_all_lineages",
    f"""WITH {fx.FIELDS}, u AS (
      SELECT p_partkey AS schema_id, p_partkey % 3 + 1 AS version, p_retailprice FROM part)
    SELECT f.schema_id, f."column" AS "column",
      CASE f.name WHEN 'Total' THEN format('{{:.2f}}', p_retailprice) WHEN 'Net' THEN format('{{:.2f}}', p_retailprice) END AS value
    FROM fields f JOIN u ON f.schema_id = u.schema_id AND f.version = u.version""",
)
def typed_cells_all_lineages(t):
    records = t.part.selectExpr(
        "CAST(p_partkey AS STRING) AS id",
        "p_partkey AS document_id",
        "p_partkey AS schema_id",
        "CAST(p_partkey % 3 + 1 AS INT) AS schema_version_id",
        "0 AS row_index",
        "map('Total', printf('%.2f', p_retailprice), 'Net', printf('%.2f', p_retailprice)) AS data",
        "CAST(NULL AS STRING) AS is_duplicate_of",
        "TIMESTAMP '2024-01-01 00:00:00' AS created_at",
    )
    return views.typed_cells(records, fx.part_fields(t)).select("schema_id", "column", "value")


@query(
    "rebuilt_views",
    f"""WITH {fx.R1} SELECT status, count(*) AS n, CAST(max(total) AS DOUBLE) AS largest FROM r1 GROUP BY status""",
)
def rebuilt_views(t):
    lineages = {"view_orders": (fx.order_records(t), fx.order_specs(t))}
    views.rebuild_views(t.spark, lineages, fx.run(t, fx.DOCUMENT_TOPICS_SQL))
    return t.sql(
        f"SELECT {fx.STATUS} AS status, count(*) AS n, CAST(max({fx.TOTAL}) AS DOUBLE) AS largest"
        f" FROM view_orders GROUP BY {fx.STATUS}"
    )


# --- Browsing -------------------------------------------------------------------


@query(
    "filtered_records",
    f"""WITH {fx.R1} SELECT document_id, row_index FROM r1 WHERE status = 'F' AND customer = 7""",
)
def filtered_records(t):
    wanted = {fx.STATUS: "F", fx.CUSTOMER: "7", "no_such_key": "x", fx.PRIORITY: ""}
    columns = [s.column for s in fx.order_specs(t)]
    return browse.filter_records(order_view(t), wanted, columns).select("document_id", "row_index")


@query(
    "records_page",
    f"""WITH {fx.R1} SELECT document_id, row_index FROM r1 ORDER BY order_date DESC, document_id, row_index
    LIMIT 50 OFFSET 100""",
)
def records_page(t):
    return browse.page_records(order_view(t), 50, 100).select("document_id", "row_index")


@query("records_total", f"WITH {fx.R1} SELECT count(*) AS total FROM r1")
def records_total(t):
    return browse.total_records(order_view(t))


@query(
    "records_without_topics",
    f"""WITH {fx.R1} SELECT id, document_id, row_index, schema_version_id, is_duplicate_of, created_at FROM (
    SELECT document_id || '-' || row_index AS id, document_id, row_index, version AS schema_version_id,
    CAST(NULL AS VARCHAR) AS is_duplicate_of, CAST(order_date AS TIMESTAMP) AS created_at FROM r1) q""",
)
def records_without_topics(t):
    shown = browse.without_scope_column(views.typed_view(fx.order_records(t), [], fx.run(t, fx.DOCUMENT_TOPICS_SQL)))
    return shown.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


_DOCS_SQL = """SELECT o_orderkey AS document_id, o_custkey AS schema_id, o_orderdate AS uploaded_at,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS batch_id FROM {orders}"""


@query(
    "documents_list",
    f"""WITH {_LINKS}, docs AS ({fx.plain(_DOCS_SQL)}), jobs AS ({fx.plain(fx.JOBS_SQL)}),
    latest AS (SELECT document_id, arg_max(status, (created_at, job_id)) AS status FROM jobs GROUP BY document_id)
    SELECT d.document_id, l.status FROM docs d LEFT JOIN latest l USING (document_id)
    WHERE l.status IN ('confirmed', 'failed', 'awaiting_review')
      AND d.document_id IN (SELECT document_id FROM links WHERE topic_id = 'MACHINERY')""",
)
def documents_list(t):
    listed = browse.list_documents(
        fx.run(t, _DOCS_SQL),
        fx.jobs(t),
        fx.run(t, fx.DOCUMENT_TOPICS_SQL),
        topic_id="MACHINERY",
        statuses=["confirmed", "failed", "awaiting_review"],
    )
    return listed.select("document_id", "status")


@query(
    "document_details",
    f"""WITH {fx.R1}, jobs AS ({fx.plain(fx.JOBS_SQL)}),
    r AS (SELECT document_id, max(row_index) AS last_row, count(*) AS record_count FROM r1 GROUP BY document_id),
    c AS (SELECT doc_id AS document_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS chunk_count FROM documents),
    j AS (SELECT document_id, count(*) AS job_count FROM jobs GROUP BY document_id)
    SELECT o_orderkey AS document_id, o_orderkey || '-' || last_row AS latest_record_id, record_count,
    COALESCE(chunk_count, 0) AS chunk_count, COALESCE(job_count, 0) AS job_count
    FROM orders JOIN r ON r.document_id = o_orderkey LEFT JOIN c ON c.document_id = o_orderkey
    LEFT JOIN j ON j.document_id = o_orderkey""",
)
def document_details(t):
    chunks = t.documents.selectExpr("doc_id AS document_id", "explode(split(text, '\\n')) AS content")
    docs = t.orders.selectExpr("o_orderkey AS document_id")
    return browse.document_detail(docs, fx.order_records(t), chunks, fx.jobs(t))


_BATCH_JOBS_SQL = f"""SELECT event_id AS job_id, event_id AS document_id, ts AS created_at, {fx._STATUS} AS status FROM {{events}}"""


@query(
    "batch_summaries",
    f"""WITH docs AS ({fx.plain(_DOCS_SQL)}), jobs AS ({fx.plain(_BATCH_JOBS_SQL)}),
    d AS (SELECT COALESCE(batch_id, 'ungrouped') AS batch_id, count(*) AS documents FROM docs GROUP BY 1),
    j AS (SELECT COALESCE(batch_id, 'ungrouped') AS batch_id, count(*) AS jobs,
      count(*) FILTER (WHERE status IN ('pending', 'extracting')) AS in_progress,
      count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs JOIN docs USING (document_id) GROUP BY 1)
    SELECT batch_id, documents, COALESCE(jobs, 0) AS jobs, COALESCE(in_progress, 0) AS in_progress,
    COALESCE(failed, 0) AS failed FROM d LEFT JOIN j USING (batch_id)""",
)
def batch_summaries(t):
    return browse.batch_summary(fx.run(t, _DOCS_SQL), fx.run(t, _BATCH_JOBS_SQL))


@query(
    "topic_status_counts",
    f"""WITH {_LINKS}, jobs AS ({fx.plain(fx.JOBS_SQL)}),
    latest AS (SELECT document_id, arg_max(status, (created_at, job_id)) AS status FROM jobs GROUP BY document_id)
    SELECT topic_id, COALESCE(status, 'unknown') AS status, count(*) AS documents
    FROM links LEFT JOIN latest USING (document_id) GROUP BY 1, 2""",
)
def topic_status_counts(t):
    return browse.topic_status_counts(fx.run(t, fx.DOCUMENT_TOPICS_SQL), fx.jobs(t))


@query(
    "emptied_schemas",
    "SELECT p_partkey AS schema_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
)
def emptied_schemas(t):
    left = t.lineitem.filter("l_quantity > 40").selectExpr("l_partkey AS schema_id")
    return browse.emptied_schemas(t.part.selectExpr("p_partkey AS schema_id"), left)


@query(
    "preview_rows",
    f"""WITH {fx.R1} SELECT '{{"document_id":' || document_id || ',"row_index":' || row_index || ',"amount":'
    || COALESCE('"' || CAST(amount AS VARCHAR) || '"', 'null') || ',"ship_date":'
    || COALESCE('"' || CAST(ship_date AS VARCHAR) || '"', 'null') || '}}' AS row_json
    FROM r1 ORDER BY document_id, row_index LIMIT 50""",
)
def preview_rows(t):
    shown = order_view(t).select(
        "document_id",
        "row_index",
        F.col(fx.AMOUNT).cast("decimal(18,2)").alias("amount"),
        F.col(fx.SHIP_DATE).alias("ship_date"),
    )
    return browse.preview_rows(shown, ["document_id", "row_index"])[0]


# --- Safe casts -----------------------------------------------------------------


@query(
    "safe_casts",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) END AS number,
    CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS INT) END AS whole,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS flag
    FROM lineitem""",
)
def safe_casts(t):
    from paperfold.functions.casts import safe_cast

    raw = t.lineitem.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "if(l_linenumber % 3 = 0, 'about ', '') || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS n",
        "if(l_linenumber % 4 = 0, CAST(l_quantity + 0.5 AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS i",
        "CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'off' ELSE 'maybe' END AS b",
    )
    return raw.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        safe_cast("n", "number").cast("double").alias("number"),
        safe_cast("i", "integer").alias("whole"),
        safe_cast("b", "boolean").alias("flag"),
    )


@query(
    "safe_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def safe_dates(t):
    from paperfold.functions.casts import safe_cast

    # ISO, "3 Oct 1998", "October 3, 1998" and 19981003 parse; slashes and a bare year do not.
    raw = t.orders.selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'd MMM yyyy')
           WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd')
           WHEN 4 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'yyyy') END AS d""",
    )
    return raw.select("o_orderkey", safe_cast("d", "date").alias("day"))


@query(
    "safe_timestamps",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts) END AS ts
    FROM events""",
)
def safe_timestamps(t):
    from paperfold.functions.casts import safe_cast

    raw = t.events.selectExpr(
        "event_id",
        """CASE event_id % 3 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS") || 'Z'
           WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE 'around ' || date_format(ts, 'HH:mm') END AS d""",
    )
    return raw.select("event_id", safe_cast("d", "datetime").cast("timestamp_ntz").alias("ts"))
