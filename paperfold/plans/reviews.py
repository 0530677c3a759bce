"""Deduplication, review and confirm over the orders lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.operators import confirm, dedup, extraction, review
from paperfold.operators.identity_index import IdentityIndex
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import Tables, query
from paperfold.session import as_table, shared_folder
from paperfold.sources.commits import TableStore

IDENTITY = ["Customer", "Priority", "Status"]


def cells(t: Tables):
    return extraction.staged_cells(fx.order_staged(t))


# The long form of the staged payload in the SQL twins.
CELLS = f"""{fx.R1}, cells AS (
  SELECT document_id, row_index, unnest(['Customer', 'Priority', 'Status', 'Order Date',
      CASE WHEN version = 1 THEN 'Total' ELSE 'Net' END]) AS field,
    unnest([CAST(customer AS VARCHAR), priority, status, CAST(order_date AS VARCHAR),
      format('{{:,.2f}}', CAST(total AS DOUBLE))]) AS value, (customer % 100) / 100.0 AS confidence FROM r1
  UNION ALL SELECT document_id, row_index, 'Total', CAST(points AS VARCHAR), NULL FROM r1 WHERE version = 3
  UNION ALL SELECT document_id, row_index, unnest(['Line Amount', 'Quantity', 'Ship Date']),
    unnest([format('{{:,.2f}}', CAST(amount AS DOUBLE)), CAST(CAST(quantity AS DOUBLE) AS VARCHAR), CAST(ship_date AS VARCHAR)]),
    (partkey % 100) / 100.0 FROM r1 WHERE amount IS NOT NULL)"""


@query(
    "staged_cells",
    f"""WITH {CELLS} SELECT document_id, row_index, field, value, CAST(confidence AS DOUBLE) AS confidence FROM cells""",
)
def staged_cells(t):
    return cells(t)


@query(
    "identity_values",
    f"""WITH {fx.R1}, v AS (SELECT document_id, row_index, unnest(['Customer', 'Priority', 'Ship Date']) AS field,
      unnest([CAST(customer AS VARCHAR), priority, CAST(ship_date AS VARCHAR)]) AS value FROM r1)
    SELECT document_id, field, arg_min(value, row_index) AS value, min(value) <> max(value) AS disagrees
    FROM v WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def identity_values(t):
    return dedup.identity_values(cells(t), ["Customer", "Priority", "Ship Date"])


# Open orders wait for review; the others are live records.
_STAGED = "status = 'O'"


def _staged_identities(t: Tables):
    found = dedup.row_identities(fx.order_staged(t, "o_orderstatus = 'O'"), ["Customer", "Priority"])
    return found.withColumn("schema_id", F.lit(fx.ORDER_SCHEMA))


def _live(t: Tables):
    return fx.order_records(t, "o_orderstatus <> 'O'")


def _identity_columns(t: Tables, *columns: str):
    rows = ", ".join(f"('{fx.ORDER_SCHEMA}', '{c}', {i})" for i, c in enumerate(columns))
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS c(schema_id, column, ord)")


def _matches(t: Tables, live):
    live = dedup.record_identities(live, fx.order_fields(t), _identity_columns(t, fx.CUSTOMER, fx.PRIORITY))
    return dedup.dedup_match(_staged_identities(t), live)


_MATCHES = f"""{fx.R1}, live AS (SELECT *, document_id || '-' || row_index AS id FROM r1 WHERE status <> 'O'),
  best AS (SELECT customer, priority, arg_min(id, (order_date, id)) AS id FROM live GROUP BY 1, 2),
  matches AS (SELECT DISTINCT r.document_id, b.id AS matched_record_id FROM r1 r JOIN best b
    ON b.customer = r.customer AND b.priority = r.priority WHERE r.status = 'O')"""


@query("dedup_matches", f"WITH {_MATCHES} SELECT * FROM matches")
def dedup_matches(t):
    return _matches(t, _live(t)).select("document_id", "matched_record_id")


@query("indexed_dedup_matches", f"WITH {_MATCHES} SELECT * FROM matches")
def indexed_dedup_matches(t):
    """`dedup_matches` from the index that two confirms filled, the newer records first."""
    folder = shared_folder(t.spark, "identities")
    index = IdentityIndex(t.spark, "identities_" + folder.rsplit("-", 1)[-1], folder)
    live = dedup.record_identities(_live(t), fx.order_fields(t), _identity_columns(t, fx.CUSTOMER, fx.PRIORITY))
    live = as_table(live.select("id", "schema_id", "identity", "created_at", "document_id"), "live-identities")
    for part in ("document_id % 2 = 1", "document_id % 2 = 0"):
        index.append(live.filter(part))
    return index.match(_staged_identities(t)).select("document_id", "matched_record_id")


@query(
    "committed_confirm",
    f"""WITH {fx.R1}, links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)})
    SELECT 'records' AS "table", count(*) AS "rows", 2 AS version FROM r1 WHERE status <> 'O' OR document_id % 2 = 0
    UNION ALL SELECT 'links', count(*), 2 FROM links JOIN orders ON o_orderkey = document_id WHERE o_orderstatus <> 'O' OR document_id % 2 = 0""",
)
def committed_confirm(t):
    """Records and links of live documents, then those of a confirm, each visible in one step."""
    store = TableStore(t.spark, shared_folder(t.spark, "store"))
    links = as_table(
        fx.run(t, fx.DOCUMENT_TOPICS_SQL).join(t.orders.selectExpr("o_orderkey AS document_id", "o_orderstatus"), "document_id"), "links"
    )
    store.commit("live", {"records": _live(t), "links": links.filter("o_orderstatus <> 'O'")})
    now = store.tables()
    confirmed = {
        "records": now["records"].unionByName(fx.order_records(t, "o_orderstatus = 'O' AND o_orderkey % 2 = 0")),
        "links": now["links"].unionByName(links.filter("o_orderstatus = 'O' AND document_id % 2 = 0")),
    }
    version = store.commit("confirm", confirmed)
    counts = [
        rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(version).alias("version"))
        for name, rows in store.tables().items()
    ]
    return counts[0].unionByName(counts[1])


@query(
    "dedup_banners",
    f"""WITH {_MATCHES}, l AS (SELECT m.document_id, m.matched_record_id, live.* EXCLUDE (document_id, row_index)
      FROM matches m JOIN live ON live.id = m.matched_record_id)
    SELECT document_id, matched_record_id, 'Customer' AS label, CAST(customer AS VARCHAR) AS value FROM l
    UNION ALL SELECT document_id, matched_record_id, 'Net', CAST(total AS VARCHAR) FROM l
    UNION ALL SELECT document_id, matched_record_id, 'Total', CAST(points AS VARCHAR) FROM l""",
)
def dedup_banners(t):
    shown = _identity_columns(t, fx.CUSTOMER, fx.TOTAL, fx.POINTS)
    live = as_table(_live(t), "live")
    return dedup.dedup_banner(_matches(t, live), live, fx.order_fields(t), shown)


@query(
    "batch_twins",
    """WITH i AS (SELECT o_custkey, o_orderpriority, count(*) AS twins, min(o_orderkey) AS first_document_id
      FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT o_orderkey AS document_id, twins, first_document_id FROM orders JOIN i USING (o_custkey, o_orderpriority)
    WHERE o_orderstatus = 'O'""",
)
def batch_twins(t):
    return dedup.batch_twins(_staged_identities(t)).select("document_id", "twins", "first_document_id")


# --- Review ---------------------------------------------------------------------


def _edited(t: Tables):
    """The second line of every order gets a typed amount; every first line is copied as an added row."""
    old = fx.order_staged(t, fixed=True).select("document_id", "row_index", "data", "data_confidence")
    typed = F.transform_values("data", lambda field, value: F.when(field == "Line Amount", "1,250.00").otherwise(value))
    edited = F.when(F.col("row_index") == 1, typed).otherwise(F.col("data"))
    places = F.when(F.col("row_index") == 0, F.array(F.lit(0), F.lit(1_000))).otherwise(F.array("row_index"))
    return old, old.select("document_id", edited.alias("data"), F.explode(places).alias("row_index"))


@query(
    "surviving_confidence",
    f"""WITH {CELLS} SELECT document_id, row_index, field,
      CASE WHEN NOT (row_index = 1 AND field = 'Line Amount') OR value = '1,250.00' THEN CAST(confidence AS DOUBLE) END AS confidence FROM cells
    UNION ALL SELECT document_id, 1000, field, NULL FROM cells WHERE row_index = 0""",
)
def surviving_confidence(t):
    scored = review.surviving_row_confidence(*_edited(t))
    each = scored.select("document_id", "row_index", "data_confidence", F.explode("data").alias("field", "value"))
    return each.select("document_id", "row_index", "field", F.try_element_at("data_confidence", F.col("field")).alias("confidence"))


_CLEAN = f"""{CELLS}, clean AS (SELECT document_id, NOT bool_or(COALESCE(confidence < 0.75, false)) AS clean FROM cells GROUP BY 1)"""


@query("clean_documents", f"WITH {_CLEAN} SELECT * FROM clean")
def clean_documents(t):
    return review.is_clean_rows(fx.order_staged(t))


@query(
    "bulk_confirm",
    f"""WITH {_CLEAN} SELECT o_orderpriority AS batch_id, document_id, CASE WHEN clean AND o_custkey % 2 = 0
      THEN 'confirmed' ELSE 'skipped' END AS outcome FROM orders JOIN clean ON document_id = o_orderkey WHERE o_orderstatus = 'O'""",
)
def bulk_confirm(t):
    jobs = t.orders.selectExpr(
        "o_orderpriority AS batch_id",
        "o_orderkey AS document_id",
        "if(o_orderstatus = 'O', 'awaiting_review', 'confirmed') AS status",
    )
    refused = t.orders.filter("o_custkey % 2 = 1").selectExpr("o_orderkey AS document_id")
    return review.confirm_all_clean(jobs, review.is_clean_rows(fx.order_staged(t)), refused)


@query(
    "low_confidence_cells",
    f"""WITH {CELLS} SELECT document_id, field, count(*) AS low_cells, CAST(min(confidence) AS DOUBLE) AS lowest
    FROM cells WHERE confidence < 0.75 GROUP BY 1, 2""",
)
def low_confidence_cells(t):
    return review.low_confidence_cells(cells(t))


@query(
    "filled_down",
    f"""WITH {CELLS} SELECT document_id, row_index, field, CASE WHEN field = 'Status' THEN 'closed'
      WHEN field = 'Quantity' AND row_index = 0 THEN '99' ELSE value END AS value FROM cells""",
)
def filled_down(t):
    staged = fx.order_staged(t)
    edits = extraction.staged_cells(staged).filter("row_index = 0 AND field IN ('Status', 'Quantity')").select(
        "document_id", "row_index", "field", F.expr("if(field = 'Status', 'closed', '99')").alias("value")
    )
    scopes = fx.order_fields(t).select(F.col("name").alias("field"), "scope").distinct()
    filled = review.fill_down_rows(staged, as_table(edits, "edits"), scopes, fx.hot_orders(t))
    return filled.select("document_id", "row_index", "field", "value")


@query(
    "review_columns",
    f"""WITH {CELLS}, d AS (SELECT o_orderkey AS document_id, unnest(['Status', 'Line Amount', 'Discount']) AS field,
      unnest([0, 1, 2]) AS pos FROM orders),
    s AS (SELECT document_id, field, min(row_index) AS first_row FROM cells GROUP BY 1, 2)
    SELECT COALESCE(s.document_id, d.document_id) AS document_id, COALESCE(s.field, d.field) AS field,
      row_number() OVER (PARTITION BY COALESCE(s.document_id, d.document_id)
        ORDER BY pos NULLS LAST, first_row NULLS LAST, COALESCE(s.field, d.field)) - 1 AS position, pos IS NOT NULL AS declared
    FROM s FULL JOIN d ON s.document_id = d.document_id AND s.field = d.field""",
)
def review_columns(t):
    declared = t.orders.selectExpr(
        "o_orderkey AS document_id", "posexplode(array('Status', 'Line Amount', 'Discount')) AS (pos, field)"
    )
    return review.review_columns(cells(t), declared).withColumn("position", F.col("position").cast("bigint"))


@query(
    "patched_schemas",
    f"""WITH {fx.VERSIONS}, v AS (SELECT schema_id, max(version) AS version FROM versions GROUP BY 1)
    SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'O' AND v.version IS NOT NULL THEN o_orderkey % 3000 ELSE o_custkey END AS matched_schema_id,
      CASE WHEN o_orderstatus = 'O' AND v.version IS NOT NULL THEN v.version ELSE 1 END AS schema_version_id,
      CASE WHEN o_orderstatus = 'O' AND v.version IS NULL THEN 'unknown schema_id' END AS error
    FROM orders LEFT JOIN v ON v.schema_id = o_orderkey % 3000""",
)
def patched_schemas(t):
    staged = t.orders.selectExpr("o_orderkey AS document_id", "o_custkey AS matched_schema_id", "1 AS schema_version_id")
    choices = t.orders.filter("o_orderstatus = 'O'").selectExpr(
        "o_orderkey AS document_id", "o_orderkey % 3000 AS chosen_schema_id"
    )
    return review.patch_schema(staged, choices, fx.part_versions(t))


@query(
    "live_suggestions",
    f"""WITH links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)}) SELECT document_id, topic_id FROM links WHERE topic_id <> 'MACHINERY'""",
)
def live_suggestions(t):
    topics = fx.run(t, fx.TOPICS_SQL).filter("name <> 'MACHINERY'")
    return review.drop_dead_topics(fx.run(t, fx.DOCUMENT_TOPICS_SQL), topics).select("document_id", "topic_id")


@query(
    "chunks_without_vectors",
    "SELECT doc_id AS document_id, text AS content FROM documents",
)
def chunks_without_vectors(t):
    chunks = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").selectExpr(
        "doc_id AS document_id", "text AS content", "embedding"
    )
    return review.strip_embeddings(chunks)


# --- Confirm --------------------------------------------------------------------


@query(
    "confirm_outcomes",
    f"""WITH {fx.VERSIONS}, s AS (SELECT o_orderkey AS document_id, o_orderstatus <> 'F' AS waiting, o_orderkey % 5 = 0 AS proposed,
      CASE o_orderkey % 10 WHEN 0 THEN 'fresh ' || o_orderkey WHEN 5 THEN p_name END AS save_as,
      CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey + CASE WHEN o_orderkey % 8 = 1 THEN 1000000 ELSE 0 END END AS matched,
      CASE WHEN o_orderkey % 7 <> 2 THEN 1 END AS version, o_orderkey % 6 AS cells
      FROM orders LEFT JOIN part ON p_partkey = o_custkey),
    e AS (SELECT *, proposed AND save_as IS NOT NULL AS promote, EXISTS (SELECT 1 FROM part WHERE p_name = save_as) AS taken,
      EXISTS (SELECT 1 FROM versions v WHERE v.schema_id = matched AND v.version = s.version) AS live FROM s),
    r AS (SELECT *, CASE WHEN NOT waiting THEN 'not awaiting review' WHEN promote AND taken THEN 'schema name exists'
      WHEN NOT promote AND matched IS NOT NULL AND version IS NULL THEN 'no schema version'
      WHEN NOT promote AND matched IS NOT NULL AND NOT live THEN 'schema no longer exists' END AS error FROM e)
    SELECT document_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN promote THEN 'new_schema'
      WHEN matched IS NOT NULL THEN 'records' ELSE 'chunks_only' END AS outcome, error,
      CASE WHEN error IS NULL AND NOT promote AND matched IS NULL THEN cells ELSE 0 END AS discarded_cells FROM r""",
)
def confirm_outcomes(t):
    names = t.part.select(F.col("p_partkey").alias("o_custkey"), "p_name")
    staged = t.orders.join(names, "o_custkey", "left").selectExpr(
        "o_orderkey AS document_id",
        "if(o_orderstatus = 'F', 'failed', 'awaiting_review') AS status",
        "o_orderkey % 5 = 0 AS has_proposed_fields",
        "CASE o_orderkey % 10 WHEN 0 THEN 'fresh ' || o_orderkey WHEN 5 THEN p_name END AS save_schema_as",
        "if(o_orderkey % 4 <> 3, o_custkey + if(o_orderkey % 8 = 1, 1000000, 0), NULL) AS matched_schema_id",
        "if(o_orderkey % 7 <> 2, 1, NULL) AS schema_version_id",
        "o_orderkey % 6 AS cells",
    )
    return confirm.confirm_outcome(staged, fx.part_schemas(t), fx.part_versions(t))


def _confirmed_records(t: Tables, start: int = 0):
    lines = fx.order_lines_raw(t).selectExpr(
        "document_id", "l_linenumber * 1000000L + row_index AS position", "map('Part', CAST(l_partkey AS STRING)) AS data"
    )
    documents = t.orders.selectExpr("o_orderkey AS document_id")
    staged = confirm.materialize(documents, lines)
    return confirm.insert_records(
        staged, F.lit("orders"), F.lit(1), F.lit("2024-01-01").cast("timestamp"), start
    )


@query(
    "inserted_records",
    f"""WITH {fx.R1} SELECT document_id || '-orders-' || row_index AS id, document_id, row_index, CAST(partkey AS VARCHAR) AS part FROM r1""",
)
def inserted_records(t):
    return _confirmed_records(t).select(
        "id", "document_id", "row_index", F.try_element_at("data", F.lit("Part")).alias("part")
    )


def _simple_records(t: Tables):
    """One record per line plus one for orders without lines, some pointing at an earlier order."""
    pointer = F.when(F.col("document_id") % 7 == 3, F.concat_ws("-", F.col("document_id") - 1, F.lit("orders"), F.lit(0)))
    return _confirmed_records(t).withColumn("is_duplicate_of", pointer)


@query(
    "backfill_replaced",
    f"""WITH {fx.R1} SELECT document_id, row_index, 1 AS schema_version_id,
      CASE WHEN document_id % 7 = 3 AND (SELECT o.o_orderstatus FROM orders o WHERE o.o_orderkey = document_id - 1) <> 'F'
        THEN (document_id - 1) || '-orders-0' END AS is_duplicate_of FROM r1 WHERE status <> 'F'
    UNION ALL SELECT o_orderkey, CAST(i AS INT), 2, NULL FROM orders, range(2) x(i) WHERE o_orderstatus = 'F'""",
)
def backfill_replaced(t):
    # Re-reading the finished orders under version 2 gives two rows each.
    fresh = confirm.insert_records(
        t.orders.filter("o_orderstatus = 'F'").selectExpr(
            "o_orderkey AS document_id", "posexplode(array(map('Part', 'a'), map('Part', 'b'))) AS (position, data)"
        ),
        F.lit("orders"),
        F.lit(2),
        F.lit("2024-02-01").cast("timestamp"),
    )
    state = confirm.backfill_replace(as_table(_simple_records(t), "records"), fresh)
    return state.select("document_id", "row_index", "schema_version_id", "is_duplicate_of")


@query(
    "dedup_applied",
    f"""WITH {fx.R1}, base AS (SELECT document_id || '-orders-' || row_index AS id, document_id, row_index FROM r1 WHERE status <> 'O'),
    d AS (SELECT n.o_orderkey AS document_id, o.o_orderkey AS old_doc, o.o_orderkey || '-orders-0' AS matched,
        CASE n.o_orderkey % 4 WHEN 0 THEN 'keep_both' WHEN 1 THEN 'skip' WHEN 2 THEN 'replace' ELSE 'merge' END AS decision
      FROM orders n JOIN orders o ON o.o_orderkey = n.o_orderkey - 1 AND o.o_orderstatus <> 'O' WHERE n.o_orderstatus = 'O'),
    fresh AS (SELECT r1.document_id || '-orders-' || row_index AS id, r1.document_id, row_index, d.* EXCLUDE (document_id)
      FROM r1 JOIN d ON d.document_id = r1.document_id)
    SELECT b.id, COALESCE(r.document_id, b.document_id) AS document_id, b.row_index, NULL AS is_duplicate_of
      FROM base b LEFT JOIN d r ON r.decision = 'replace' AND r.matched = b.id
      WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.decision = 'replace' AND d.old_doc = b.document_id AND b.row_index > 0)
    UNION ALL SELECT id, document_id, row_index, matched FROM fresh WHERE decision = 'keep_both'
    UNION ALL SELECT id, document_id, row_index, NULL FROM fresh WHERE decision = 'replace' AND row_index > 0
    UNION ALL SELECT 'error', document_id, -1, 'unknown dedup_decision merge' FROM d WHERE decision = 'merge'""",
)
def dedup_applied(t):
    statuses = t.orders.select(F.col("o_orderkey").alias("document_id"), "o_orderstatus")
    everything = as_table(_confirmed_records(t).join(statuses, "document_id"), "records")
    live = everything.filter("o_orderstatus <> 'O'").drop("o_orderstatus")
    old = statuses.filter("o_orderstatus <> 'O'").selectExpr("document_id + 1 AS document_id")
    decisions = statuses.filter("o_orderstatus = 'O'").join(old, "document_id").selectExpr(
        "document_id",
        "(document_id - 1) || '-orders-0' AS matched_record_id",
        "element_at(array('keep_both', 'skip', 'replace', 'merge'), CAST(document_id % 4 + 1 AS INT)) AS decision",
    )
    staged = everything.filter("o_orderstatus = 'O'").drop("o_orderstatus")
    state, errors = confirm.dedup_apply(live, staged, decisions)
    return state.select("id", "document_id", "row_index", "is_duplicate_of").unionByName(
        errors.selectExpr("'error' AS id", "document_id", "-1 AS row_index", "error AS is_duplicate_of")
    )


@query(
    "detached_duplicates",
    f"""WITH {fx.R1} SELECT document_id, row_index, CASE WHEN document_id % 7 = 3
      AND (SELECT o.o_orderstatus FROM orders o WHERE o.o_orderkey = document_id - 1) <> 'P' THEN (document_id - 1) || '-orders-0' END AS is_duplicate_of FROM r1""",
)
def detached_duplicates(t):
    pending = t.orders.filter("o_orderstatus = 'P'").selectExpr("o_orderkey || '-orders-0' AS id")
    return confirm.detach_duplicates(_simple_records(t), pending).select("document_id", "row_index", "is_duplicate_of")


@query(
    "linked_topics",
    f"""WITH links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)})
    SELECT document_id, topic_id FROM links WHERE document_id % 2 = 1
    UNION ALL SELECT o_orderkey, 'Uncategorized' FROM orders WHERE o_orderstatus = 'P'""",
)
def linked_topics(t):
    suggested = fx.run(t, fx.DOCUMENT_TOPICS_SQL)
    confirmed = t.orders.selectExpr("o_orderkey AS document_id")
    existing = suggested.filter("document_id % 2 = 0")
    return confirm.link_topics(suggested, confirmed, existing, F.lit(confirm.UNCATEGORIZED))


@query(
    "loaded_chunks",
    f"""WITH links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)}), a AS (SELECT document_id, string_agg(topic_id, ',' ORDER BY topic_id) AS topics
      FROM links GROUP BY 1), c AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS parts FROM documents)
    SELECT document_id, CAST(i AS INT) AS chunk_index, parts[i + 1] AS content, COALESCE(topics, '') AS topic_ids
    FROM (SELECT document_id, parts, unnest(range(len(parts))) AS i FROM c) q LEFT JOIN a USING (document_id)""",
)
def loaded_chunks(t):
    staged = t.documents.selectExpr(
        "doc_id AS document_id", "transform(split(text, '\\n'), s -> named_struct('content', s)) AS chunks"
    )
    chunks = confirm.load_chunks(staged, fx.run(t, fx.DOCUMENT_TOPICS_SQL))
    return chunks.withColumn("topic_ids", F.array_join("topic_ids", ","))
