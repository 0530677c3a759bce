"""Files, previews, blocks, sinks and the ingest stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.functions.sql_functions import register_sql_functions
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import query
from paperfold.session import shared_folder, spread
from paperfold.sources import elements, files, sinks
from paperfold.streaming import ingest

_FILES = f"files AS ({fx.plain(fx.FILES_SQL)})"


def _inventory(t):
    named = fx.files(t).selectExpr("document_id AS path", "filename", "batch_id", "CAST(text AS BINARY) AS content")
    return files.document_inventory(named, F.col("batch_id"))


@query(
    "document_inventory",
    f"""WITH {_FILES} SELECT substr(sha256(batch_id || '|' || document_id), 1, 32) AS document_id, batch_id,
    CASE WHEN filename = '' THEN 'unnamed' ELSE filename END AS filename, strlen(text) AS file_size, sha256(text) AS file_hash,
    'pending' AS job_status, 'extract' AS job_kind FROM files""",
)
def document_inventory(t):
    return _inventory(t).drop("job_id", "default_schema_id", "default_topic_ids")


@query(
    "repeated_content",
    """SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_document_id FROM documents
    GROUP BY 1 HAVING count(*) > 1""",
)
def repeated_content(t):
    hashed = t.documents.select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"))
    return files.repeated_content(hashed)


@query(
    "upload_batches",
    """SELECT source AS batch_id, 'schema of ' || source AS default_schema_id, source || ',all' AS topics, count(*) AS documents,
    count(*) AS jobs FROM documents GROUP BY source""",
)
def upload_batches(t):
    given = t.documents.selectExpr("doc_id AS path", "text AS content", "concat('f', doc_id) AS filename", "source")
    found = files.document_inventory(
        given, F.col("source"), F.concat(F.lit("schema of "), "source"), F.array(F.col("source"), F.lit("all"))
    )
    jobs = found.groupBy("batch_id").agg(F.countDistinct("job_id").alias("jobs"))
    topics = F.array_join("default_topic_ids", ",").alias("topics")
    return files.batch_table(found).join(jobs, "batch_id").select("batch_id", "default_schema_id", topics, "documents", "jobs")


@query(
    "media_types",
    f"""WITH {_FILES} SELECT document_id, CASE document_id % 20 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png'
    WHEN 2 THEN 'audio/mpeg' WHEN 3 THEN 'video/mp4' WHEN 4 THEN 'text/html' WHEN 5 THEN 'text/csv' WHEN 6 THEN 'text/tab-separated-values'
    WHEN 7 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 8 THEN 'message/rfc822'
    WHEN 9 THEN 'text/plain' WHEN 10 THEN 'text/markdown' WHEN 11 THEN 'application/json' WHEN 12 THEN 'text/x-python'
    WHEN 13 THEN 'application/zip' WHEN 14 THEN 'image/tiff' WHEN 17 THEN 'application/yaml' WHEN 18 THEN 'image/svg+xml'
    WHEN 19 THEN 'video/webm'
    ELSE CASE WHEN mime_type IS NULL OR mime_type = '' THEN 'application/octet-stream' ELSE mime_type END END AS media_type FROM files""",
)
def media_types(t):
    return fx.files(t).select("document_id", files.media_type().alias("media_type"))


@query(
    "preview_kinds",
    f"""WITH {_FILES} SELECT document_id, CASE document_id % 20 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'audio'
    WHEN 3 THEN 'video' WHEN 4 THEN 'html' WHEN 5 THEN 'elements' WHEN 6 THEN 'elements' WHEN 7 THEN 'elements' WHEN 8 THEN 'elements'
    WHEN 9 THEN 'text' WHEN 10 THEN 'text' WHEN 11 THEN 'text' WHEN 12 THEN 'text' WHEN 13 THEN 'unsupported' WHEN 14 THEN 'elements'
    WHEN 17 THEN 'text' WHEN 18 THEN 'image' WHEN 19 THEN 'video'
    ELSE CASE mime_type WHEN 'text/plain; charset=utf-8' THEN 'text' WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'image'
      ELSE 'elements' END END AS kind FROM files""",
)
def preview_kinds(t):
    return fx.files(t).select("document_id", files.preview_kind().alias("kind"))


_CSV = """c_custkey || ',"' || c_name || ', of ' || c_mktsegment || '"' || chr(10) || ' , ' || chr(10)
  || 'balance,' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR(30)) || ',"say ' || '""hi""' || '"' || chr(10)"""


@query(
    "delimited_previews",
    """SELECT c_custkey AS document_id, 0 AS row_no, c_custkey || '~' || c_name || ', of ' || c_mktsegment AS cells, false AS truncated FROM customer
    UNION ALL SELECT c_custkey, 1, 'balance~' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '~say "hi"', false FROM customer""",
)
def delimited_previews(t):
    texts = t.customer.selectExpr("c_custkey AS document_id", f"{_CSV} AS content")
    return files.read_delimited(texts, ",").withColumn("cells", F.array_join("cells", "~")).drop("error")


@query(
    "delimited_scan",
    """SELECT c_custkey AS customer, c_name AS name, n_name || ', ' || c_mktsegment AS place FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def delimited_scan(t):
    # Written as quoted pipe files first, then read back as a table.
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(
        "c_custkey AS customer", "c_name AS name", "n_name || ', ' || c_mktsegment AS place"
    )
    path = shared_folder(t.spark, "psv")
    rows.write.csv(path, sep="|", header=True, quoteAll=True)
    return files.scan_delimited(t.spark, path, "|").withColumn("customer", F.col("customer").cast("bigint"))


@query(
    "clipped_texts",
    "SELECT doc_id, length(text) > 1000 AS truncated, substr(text, 1, 1000) AS text FROM documents",
)
def clipped_texts(t):
    return files.clip_text(t.documents.select("doc_id", "text"), "text", 1000)


_LIST_ITEMS = "len(regexp_extract_all(html, '<li>'))"


@query(
    "html_blocks",
    f"""SELECT page_id AS document_id, CAST({_LIST_ITEMS} AS BIGINT) AS list_items, 2 AS titles FROM pages""",
)
def html_blocks(t):
    pages = t.pages.selectExpr("page_id AS document_id", "html")
    return elements.partition_html(pages).groupBy("document_id").agg(
        F.count_if(F.col("type") == "ListItem").alias("list_items"),
        F.count_if((F.col("type") == "Title") & (F.length("text") > 0)).cast("int").alias("titles"),
    )


_ELEMENTS = """lines AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')),
    lambda s: s <> '') AS parts FROM documents),
  els AS (SELECT document_id, i AS seq, parts[i + 1] AS text, CASE WHEN len(regexp_split_to_array(parts[i + 1], ' +')) <= 8
    AND NOT ends_with(parts[i + 1], '.') THEN 'Title' ELSE 'NarrativeText' END AS type
    FROM (SELECT document_id, parts, CAST(unnest(range(len(parts))) AS INT) AS i FROM lines) q)"""


@query("text_blocks", f"WITH {_ELEMENTS} SELECT document_id, seq, type, text FROM els")
def text_blocks(t):
    docs = t.documents.selectExpr("doc_id AS document_id", "text")
    return elements.partition_text(docs).select("document_id", "seq", "type", "text")


@query(
    "preview_blocks",
    f"""WITH {_ELEMENTS} SELECT document_id, seq, CASE WHEN type = 'Title' THEN 'heading' ELSE 'text' END AS kind,
    text, NULL::VARCHAR AS rows, false AS truncated FROM els""",
)
def preview_blocks(t):
    docs = t.documents.selectExpr("doc_id AS document_id", "text")
    shown = elements.preview_elements(elements.partition_text(docs)).drop("page_number")
    return shown.withColumn("rows", F.to_json("rows"))


@query(
    "document_texts",
    f"""WITH {_ELEMENTS} SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS full_text FROM els GROUP BY 1""",
)
def document_texts(t):
    docs = t.documents.selectExpr("doc_id AS document_id", "text")
    return elements.elements_text(elements.partition_text(docs))


_TABLE_HTML = """'<table><tr><th>Name</th><th> Segment </th></tr><tr></tr><tr><td>' || c_name || ' &amp; co</td><td>' || c_mktsegment || '</td></tr></table>'
  || CASE WHEN c_nationkey = 1 THEN '<table><tr><td>open' || c_custkey || '</td>' ELSE '' END"""
_TABLE_ROWS = """SELECT c_custkey AS document_id, 0 AS table_no, unnest([0, 0, 1, 1]) AS row_no, unnest([0, 1, 0, 1]) AS col_no,
    unnest(['Name', 'Segment', c_name || ' & co', c_mktsegment]) AS cell FROM customer
  UNION ALL SELECT c_custkey, 1, 0, 0, 'open' || c_custkey FROM customer WHERE c_nationkey = 1"""


@query("html_table_rows", _TABLE_ROWS)
def html_table_rows(t):
    docs = t.customer.selectExpr("c_custkey AS document_id", f"{_TABLE_HTML} AS html")
    return elements.html_table_rows(docs)


@query(
    "preview_tables",
    """SELECT c_custkey AS document_id, 0 AS seq, 'table' AS kind, 'Name Segment ' || c_name || ' & co ' || c_mktsegment AS text,
      '[["Name","Segment"],["' || c_name || ' & co","' || c_mktsegment || '"]]' AS rows, false AS truncated FROM customer
    UNION ALL SELECT c_custkey, 1, CASE WHEN c_nationkey = 1 THEN 'table' ELSE 'text' END,
      CASE WHEN c_nationkey = 1 THEN 'open' || c_custkey ELSE 'no rows ' || c_custkey END,
      CASE WHEN c_nationkey = 1 THEN '[["open' || c_custkey || '"]]' END, false FROM customer WHERE c_nationkey <= 1""",
)
def preview_tables(t):
    rowless = "CASE WHEN c_nationkey = 0 THEN '<table><caption>no rows ' || c_custkey || '</caption></table>' ELSE '' END"
    docs = t.customer.selectExpr("c_custkey AS document_id", f"{_TABLE_HTML} || {rowless} AS html")
    shown = elements.preview_elements(elements.partition_html(docs)).drop("page_number")
    return shown.withColumn("rows", F.to_json("rows"))


@query(
    "nested_table_rows",
    """SELECT c_custkey AS document_id, unnest([0, 0, 1, 1]) AS table_no, unnest([0, 1, 0, 0]) AS row_no, unnest([0, 2, 0, 1]) AS col_no,
      unnest(['wide', 'after', c_name, c_mktsegment]) AS cell FROM customer
    UNION ALL SELECT c_custkey, 0, 1, 0, 'outer' FROM customer UNION ALL SELECT c_custkey, 0, 1, 1, '' FROM customer""",
)
def nested_table_rows(t):
    html = """concat('<table><tr><td colspan=3>wide<tr><td>outer<td><table><tr><td>', c_name, '<td>', c_mktsegment, '</table><td>after</table>')"""
    return elements.html_table_rows(t.customer.selectExpr("c_custkey AS document_id", f"{html} AS html"))


@query("html_table_rows_sql", _TABLE_ROWS)
def html_table_rows_sql(t):
    register_sql_functions(t.spark)
    docs = spread(t.customer, "c_custkey").selectExpr("c_custkey AS document_id", f"{_TABLE_HTML} AS html")
    return t.sql(
        "SELECT d.document_id, r.table_no, r.row_no, r.col_no, r.cell FROM {docs} d, LATERAL html_table_rows(d.html) r", docs=docs
    )


@query("html_elements_sql", f"SELECT page_id AS document_id, CAST({_LIST_ITEMS} AS BIGINT) AS list_items FROM pages")
def html_elements_sql(t):
    register_sql_functions(t.spark)
    return t.sql(
        "SELECT d.page_id AS document_id, count_if(e.type = 'ListItem') AS list_items"
        " FROM {pages} d, LATERAL html_elements(d.html) e GROUP BY d.page_id",
        pages=t.pages,
    )


@query(
    "written_records",
    f"""WITH {fx.R1} SELECT 'orders' AS schema_id, count(*) AS records, count(DISTINCT document_id) AS documents FROM r1""",
)
def written_records(t):
    path = shared_folder(t.spark, "records")
    sinks.write_records(fx.order_records(t), path)
    return t.spark.read.parquet(path).groupBy("schema_id").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("document_id").alias("documents")
    )


@query(
    "replaced_table",
    f"""WITH {fx.R1} SELECT document_id, count(*) AS records FROM r1 WHERE CAST(document_id AS BIGINT) % 3 <> 0 GROUP BY 1""",
)
def replaced_table(t):
    # The new state is computed from the table it replaces.
    path = shared_folder(t.spark, "replaced")
    fx.order_records(t).write.parquet(path)
    state = t.spark.read.parquet(path).filter("CAST(document_id AS BIGINT) % 3 <> 0")
    sinks.replace_table(t.spark, state, path)
    return t.spark.read.parquet(path).groupBy("document_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    "ingest_stream",
    """SELECT source AS batch_id, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS contents
    FROM documents GROUP BY 1""",
)
def ingest_stream(t):
    # The document table as an arriving file source; a folder of files works alike.
    arriving = t.spark.readStream.schema(t.documents.schema).parquet(ingest.file_or_folder(f"{t.folder}/documents.parquet"))
    named = arriving.selectExpr(
        "doc_id AS path", "'doc_' || doc_id AS filename", "source AS batch_id", "CAST(text AS BINARY) AS content"
    )
    out = shared_folder(t.spark, "inventory")
    ingest.run_to_end(files.document_inventory(named, F.col("batch_id")), out, shared_folder(t.spark, "inventory-state"))
    return t.spark.read.parquet(out).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("file_size").alias("bytes"),
        F.countDistinct("file_hash").alias("contents"),
    )
