"""Extraction: prompts, replies, coercion, merging, matching and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.functions import coerce
from paperfold.operators import extraction, matching
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import Tables, query
from paperfold.session import spread


def _newest(fields):
    newest = fields.groupBy("schema_id").agg(F.max("version").alias("version"))
    return fields.join(newest.hint("merge"), ["schema_id", "version"])


@query(
    "field_prompts",
    f"""WITH {fx.FIELDS}, m AS (SELECT schema_id, max(version) AS version FROM fields GROUP BY 1),
    l AS (SELECT schema_id, pos, CASE WHEN scope = 'row' THEN 'row' ELSE 'document' END AS scope,
      '- ' || name || ' (' || type || '): ' || description AS line FROM fields JOIN m USING (schema_id, version)),
    g AS (SELECT schema_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE scope = 'document') AS d,
      string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE scope = 'row') AS r FROM l GROUP BY 1)
    SELECT schema_id, CASE WHEN r IS NULL THEN 'Fields:' || chr(10) || d
      ELSE 'Document-level fields:' || chr(10) || d || chr(10) || chr(10) || 'Per-row fields:' || chr(10) || r END
      || CASE WHEN p_size % 4 = 0 THEN chr(10) || chr(10) || '--- REVIEWER FEEDBACK ---' || chr(10) || 'check ' || p_brand
           || chr(10) || '--- END REVIEWER FEEDBACK ---' ELSE '' END AS prompt
    FROM g JOIN part ON p_partkey = schema_id""",
)
def field_prompts(t):
    feedback = t.part.filter("p_size % 4 = 0").selectExpr("p_partkey AS schema_id", "'check ' || p_brand AS feedback")
    return extraction.render_field_prompt(_newest(fx.part_fields(t)), feedback)


def _counting_client():
    """A deterministic stand-in for a hosted model: replies with the text's length."""

    def ask(prompt: str):
        if not prompt.strip():
            raise ValueError("empty prompt")
        return f'{{"values":{{"length":"{len(prompt)}"}}}}', len(prompt) % 10 != 0

    return ask


@query(
    "model_replies",
    """SELECT doc_id, CASE WHEN length(text) % 10 <> 0 THEN '{"values":{"length":"' || length(text) || '"}}' END AS reply_json,
    CASE WHEN length(text) % 10 = 0 THEN 'reply was cut off at the length limit' END AS error FROM documents""",
)
def model_replies(t):
    prompts = t.documents.selectExpr("doc_id", "text AS prompt")
    return extraction.model_map(prompts, _counting_client).drop("prompt")


@query(
    "extraction_routes",
    "SELECT CASE WHEN length(text) <= 1500 THEN 'one_shot' ELSE 'chunked' END AS route, count(*) AS documents FROM documents GROUP BY 1",
)
def extraction_routes(t):
    return extraction.route_by_length(t.documents, "text", 1500).groupBy("route").agg(F.count(F.lit(1)).alias("documents"))


def _word_client():
    """A stand-in that reads every word of its part as a row; a part with junk is cut off."""
    import json
    import re

    def ask(prompt: str) -> tuple[str, bool]:
        rows = [{"values": {"word": w}, "confidence": {"word": 0.9}} for w in re.findall(r"[^\x20\x09-\x0D]+", prompt)]
        head = {"values": {"seen": "yes"}, "confidence": {"seen": 0.8}}
        return json.dumps({"document": head, "rows": rows}), "***" not in prompt

    return ask


@query(
    "long_documents",
    """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents)
    SELECT doc_id AS document_id, greatest(len(words), 1) AS rows, md5(array_to_string(words, ' ')) AS said, 'yes' AS seen, NULL::VARCHAR AS error
    FROM w WHERE NOT contains(text, '***')
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 'reply was cut off at the length limit' FROM w WHERE contains(text, '***')""",
)
def long_documents(t):
    """Texts far beyond one prompt, extracted in full or not at all."""
    docs = spread(t.documents.selectExpr("doc_id AS document_id", "text"), "document_id")
    records, errors = extraction.extract_documents(docs, _word_client, limit=1500)
    words = F.array_sort(F.collect_list(F.struct("row_index", F.try_element_at("data", F.lit("word")).alias("w"))))
    done = records.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.md5(F.array_join(F.transform(words, lambda x: x["w"]), " ")).alias("said"),
        F.max(F.try_element_at("data", F.lit("seen"))).alias("seen"),
    )
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def order_replies(t: Tables):
    """One reply per order: a header, and its lines as rows."""
    part = F.struct("values", "confidence")
    lines = fx.order_lines(t).select("document_id", "row_index", F.to_json(part).alias("row"))
    # A reply is one model answer, so its rows come together in one cell anyway.
    rows = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "row"))).alias("rows"))
    header = fx.order_headers(t).select("document_id", "schema_version_id", F.to_json(part, {"ignoreNullFields": "false"}).alias("head"))
    body = F.concat(
        F.lit('{"document":'), "head", F.lit(',"rows":['),
        F.coalesce(F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("")), F.lit("]}"),
    )
    return header.join(rows, "document_id", "left").select("document_id", "schema_version_id", body.alias("reply_json"))


@query(
    "parsed_replies",
    f"""WITH {fx.R1} SELECT document_id, count(amount) AS line_count,
    any_value(status) AS status, CAST(any_value(customer % 100) AS DOUBLE) / 100 AS confidence,
    COALESCE(sum(CAST(round(quantity) AS BIGINT)), 0) AS quantity, NULL::VARCHAR AS error FROM r1 GROUP BY document_id""",
)
def parsed_replies(t):
    parsed = extraction.parse_reply(order_replies(t), F.lit(True))
    return parsed.select(
        "document_id",
        "error",
        F.size("rows").cast("bigint").alias("line_count"),
        F.col("values")["Status"].alias("status"),
        F.col("confidence")["Status"].alias("confidence"),
        F.expr("aggregate(rows, 0L, (a, r) -> a + CAST(round(CAST(r.values['Quantity'] AS DOUBLE)) AS BIGINT))").alias("quantity"),
    )


_PLAIN = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


@query(
    "coerced_numbers",
    f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN '-' || {_PLAIN} WHEN 5 THEN 'n/a' WHEN 6 THEN NULL
      WHEN 7 THEN format('{{:,.2f}}', o_totalprice) || '-' ELSE {_PLAIN} END AS number,
    CASE o_orderkey % 4 WHEN 1 THEN o_custkey || '.50' ELSE CAST(o_custkey AS VARCHAR) END AS whole,
    CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'maybe' END AS flag,
    '03/04/2026' AS day FROM orders""",
)
def coerced_numbers(t):
    raw = t.orders.selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 8 WHEN 0 THEN format_number(o_totalprice, 2) WHEN 1 THEN '₹ ' || format_number(o_totalprice, 2)
           WHEN 2 THEN '(' || format_number(o_totalprice, 2) || ')'
           WHEN 3 THEN 'EUR ' || replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',')
           WHEN 4 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || '%' WHEN 5 THEN 'n/a' WHEN 6 THEN '  '
           ELSE format_number(o_totalprice, 2) || '-' END AS n""",
        """CASE o_orderkey % 4 WHEN 0 THEN format_number(o_custkey, 2) WHEN 1 THEN o_custkey || '.50'
           WHEN 2 THEN '+' || o_custkey ELSE 'No ' || o_custkey END AS i""",
        "CASE o_orderkey % 5 WHEN 0 THEN ' Paid ' WHEN 1 THEN 'OFF' WHEN 2 THEN 'y' WHEN 3 THEN 'maybe' ELSE ' ' END AS b",
        "'03/04/2026' AS d",
    )
    return raw.select(
        "o_orderkey",
        coerce.coerce_number("n").alias("number"),
        coerce.coerce_integer("i").alias("whole"),
        coerce.coerce_boolean("b").alias("flag"),
        coerce.coerce_value("d", "'date'").alias("day"),
    )


@query(
    "coerced_records",
    f"""WITH {fx.R1} SELECT document_id, row_index, CAST(amount AS VARCHAR) AS amount, CAST(total AS VARCHAR) AS total, status FROM r1""",
)
def coerced_records(t):
    name = F.when(F.col("schema_version_id") == 1, "Total").otherwise("Net")
    return fx.order_records(t).select(
        "document_id",
        "row_index",
        F.try_element_at("data", F.lit("Line Amount")).alias("amount"),
        F.try_element_at("data", name).alias("total"),
        F.col("data")["Status"].alias("status"),
    )


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate"
_CHUNK_VALUES = f"""SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS chunk_no,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS value, (l_partkey % 100) / 100.0 AS confidence FROM lineitem"""


@query(
    "merged_headers",
    f"""WITH c AS ({_CHUNK_VALUES}), s AS (SELECT *, lag(value) OVER w AS last FROM c WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY document_id ORDER BY chunk_no)),
    g AS (SELECT *, sum(CASE WHEN last IS NULL OR last = value THEN 1 ELSE 0 END)
      OVER (PARTITION BY document_id ORDER BY chunk_no) AS g FROM s)
    SELECT document_id, 'Flag' AS field, arg_max(value, chunk_no) AS value,
      CAST(min(confidence) FILTER (WHERE g = top) AS DOUBLE) AS confidence
    FROM (SELECT *, max(g) OVER (PARTITION BY document_id) AS top FROM g) q GROUP BY document_id""",
)
def merged_headers(t):
    # Each line of an order stands for one chunk's view of the header.
    cells = fx.order_lines_raw(t).selectExpr(
        "document_id",
        "row_index AS chunk_no",
        "'Flag' AS field",
        "if(l_returnflag <> 'N', l_returnflag, NULL) AS value",
        "(l_partkey % 100) / 100D AS confidence",
    )
    return extraction.merge_header_chunks(cells)


@query(
    "chunk_rows_in_order",
    f"""SELECT l_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber % 2, {_LINE_ORDER}) - 1 AS BIGINT) AS row_index, l_partkey AS partkey
    FROM lineitem WHERE l_partkey % 11 <> 0""",
)
def chunk_rows_in_order(t):
    rows = fx.order_lines_raw(t).selectExpr(
        "document_id",
        "l_linenumber % 2 AS chunk_no",
        "row_index AS pos",
        "map('Part', if(l_partkey % 11 = 0, NULL, CAST(l_partkey AS STRING)), 'Note', CAST(NULL AS STRING)) AS values",
        "l_partkey AS partkey",
    )
    return extraction.concat_chunk_rows(rows).select("document_id", "row_index", "partkey")


@query(
    "flattened_records",
    f"""WITH {fx.R1} SELECT document_id, row_index, status, format('{{:,.2f}}', CAST(amount AS DOUBLE)) AS amount,
    CASE WHEN amount IS NULL THEN 5 ELSE 8 END + CASE WHEN version = 3 THEN 1 ELSE 0 END AS fields,
    CAST(partkey % 100 AS DOUBLE) / 100 AS confidence FROM r1""",
)
def flattened_records(t):
    return fx.order_staged(t).select(
        "document_id",
        "row_index",
        F.col("data")["Status"].alias("status"),
        F.try_element_at("data", F.lit("Line Amount")).alias("amount"),
        F.size("data").alias("fields"),
        F.try_element_at("data_confidence", F.lit("Line Amount")).alias("confidence"),
    )


@query(
    "reextracted",
    """SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS note,
    CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN 'first,fix ' || o_custkey ELSE 'first' END AS history,
    CASE WHEN o_orderstatus <> 'F' AND o_custkey % 3 = 0 THEN 'fix ' || o_custkey END AS reextract_feedback FROM orders""",
)
def reextracted(t):
    staged = t.orders.selectExpr(
        "o_orderkey AS document_id",
        "array(map('Note', o_orderpriority)) AS extracted_data",
        "array(map('Note', 0.5D)) AS data_confidence",
        "if(o_custkey % 3 = 0, 'fix ' || o_custkey, NULL) AS reextract_feedback",
        "array('first') AS reextract_history",
    )
    fresh = t.orders.filter("o_orderstatus = 'F'").selectExpr(
        "o_orderkey AS document_id", "array(map('Note', 'new')) AS extracted_data", "array(map('Note', 0.9D)) AS data_confidence"
    )
    return extraction.merge_reextract(staged, fresh).select(
        "document_id",
        F.col("extracted_data")[0]["Note"].alias("note"),
        F.array_join("reextract_history", ",").alias("history"),
        "reextract_feedback",
    )


@query(
    "backfill_jobs",
    f"""WITH {fx.VERSIONS} SELECT o_orderkey AS document_id, o_custkey AS schema_id, max(version) AS schema_version_id,
    'backfill' AS kind, 'pending' AS status FROM orders JOIN versions ON schema_id = o_custkey GROUP BY 1, 2""",
)
def backfill_jobs(t):
    documents = t.orders.selectExpr("o_orderkey AS document_id", "o_custkey AS schema_id", "1 AS schema_version_id")
    return extraction.backfill_payload(documents, fx.part_versions(t))


@query(
    "failed_replies",
    """SELECT conv_id * 1000 + turn AS reply_id, true AS failed FROM conversations
    UNION ALL SELECT item_id, false FROM benchmark""",
)
def failed_replies(t):
    """Prose is no reply; an object around the same kind of text is one."""
    prose = t.conversations.selectExpr("conv_id * 1000 + turn AS reply_id", "text AS reply_json")
    sound = t.benchmark.selectExpr("item_id AS reply_id", "to_json(named_struct('values', map('text', text))) AS reply_json")
    parsed = extraction.parse_reply(prose.unionByName(sound), F.lit(False))
    return parsed.select("reply_id", F.col("error").isNotNull().alias("failed"))


@query(
    "inferred_schema",
    """SELECT * FROM (VALUES ('Order Total', 'string', true), ('Amount', 'number', true), ('Order Date', 'date', true),
    ('Customer', 'integer', true), ('Status', 'string', false), ('Open', 'boolean', true), ('Seen', 'datetime', false), ('Minute', 'datetime', true))
    q(name, type, required)""",
)
def inferred_schema(t):
    cells = t.orders.selectExpr(
        """inline(array(
             named_struct('field', 'Order Total', 'value', format_number(o_totalprice, 2)),
             named_struct('field', 'Amount', 'value', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)),
             named_struct('field', 'Order Date', 'value', CAST(CAST(o_orderdate AS DATE) AS STRING)),
             named_struct('field', 'Customer', 'value', CAST(o_custkey AS STRING)),
             named_struct('field', 'Status', 'value', CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END),
             named_struct('field', 'Open', 'value', CAST(o_orderstatus = 'O' AS STRING)),
             named_struct('field', 'Seen', 'value', if(o_orderstatus = 'P', NULL, date_format(o_orderdate, 'yyyy-MM-dd') || ' 10:20:30')),
             named_struct('field', 'Minute', 'value', date_format(o_orderdate, 'yyyy-MM-dd') || ' 10:20')))"""
    )
    return extraction.infer_schema(cells).drop("description")


# --- Matching -------------------------------------------------------------------

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


def _words(x: str) -> str:
    return _WORDS.replace("{x}", x).replace("{{", "{").replace("}}", "}")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _overlap(options: str) -> str:
    return f"""d AS (SELECT doc_id, unnest({_words('text')}) AS w FROM documents),
    o AS (SELECT option_id, unnest(words) AS w, len(words) AS n FROM ({options}) x WHERE len(words) > 0),
    c AS (SELECT doc_id, option_id, count(*) AS shared, any_value(n) AS n FROM d JOIN o USING (w) GROUP BY 1, 2),
    hits AS (SELECT *, shared / n AS score FROM c WHERE shared >= ceil(0.5 * n))"""


_BENCH = f"SELECT item_id AS option_id, {_words('text')} AS words FROM benchmark"
_PAGES = f"SELECT page_id AS option_id, {_words(_TITLE)} AS words FROM pages"


@query(
    "matched_schemas",
    f"""WITH {_overlap(_BENCH)}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, option_id) AS rn FROM hits)
    SELECT doc_id, CASE WHEN source = 'src0' THEN -1 ELSE option_id END AS schema_id,
    CASE WHEN source <> 'src0' THEN round(score, 9) END AS score
    FROM documents LEFT JOIN (SELECT * FROM top WHERE rn = 1) q USING (doc_id)""",
)
def matched_schemas(t):
    # Documents of one source had their schema chosen at upload.
    chosen = t.documents.selectExpr("doc_id", "text", "if(source = 'src0', -1L, NULL) AS chosen")
    docs = matching.word_sets(chosen, "doc_id", "text", "chosen")
    options = matching.word_sets(t.benchmark.withColumnRenamed("item_id", "option_id"), "option_id", "text")
    return matching.match_schema(docs, options).withColumn("score", F.round("score", 9))


@query(
    "suggested_topics",
    f"""WITH {_overlap(_PAGES)} SELECT doc_id, CASE WHEN source = 'src1' THEN CAST(doc_id AS VARCHAR)
      ELSE COALESCE((SELECT string_agg(CAST(option_id AS VARCHAR), ',' ORDER BY option_id) FROM hits h WHERE h.doc_id = documents.doc_id), '') END AS topic_ids
    FROM documents""",
)
def suggested_topics(t):
    hinted = t.documents.selectExpr("doc_id", "text", "if(source = 'src1', array(doc_id), CAST(array() AS ARRAY<BIGINT>)) AS hint_ids")
    docs = matching.word_sets(hinted, "doc_id", "text", "hint_ids")
    titles = t.pages.selectExpr("page_id AS option_id", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title")
    found = matching.suggest_topics(docs, matching.word_sets(titles, "option_id", "title"))
    return found.withColumn("topic_ids", F.array_join(F.col("topic_ids").cast("array<string>"), ","))


@query(
    "classified_documents",
    f"""WITH {_overlap(_BENCH)}, b AS (SELECT doc_id, string_agg(CAST(option_id AS VARCHAR), ',' ORDER BY option_id) AS s FROM hits GROUP BY 1),
    o2 AS (SELECT option_id, unnest(words) AS w, len(words) AS n FROM ({_PAGES}) x WHERE len(words) > 0),
    c2 AS (SELECT doc_id, option_id, count(*) AS shared, any_value(n) AS n FROM d JOIN o2 USING (w) GROUP BY 1, 2),
    p AS (SELECT doc_id, string_agg(CAST(option_id AS VARCHAR), ',' ORDER BY option_id) AS s FROM c2 WHERE shared >= ceil(0.5 * n) GROUP BY 1)
    SELECT doc_id, 'schema' AS task, COALESCE(s, '') AS selected FROM documents LEFT JOIN b USING (doc_id)
    UNION ALL SELECT doc_id, 'topics', COALESCE(s, '') FROM documents LEFT JOIN p USING (doc_id)""",
)
def classified_documents(t):
    titles = t.pages.selectExpr("page_id AS option_id", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title")
    tasks = (
        matching.word_sets(t.benchmark.withColumnRenamed("item_id", "option_id"), "option_id", "text")
        .withColumn("task", F.lit("schema"))
        .unionByName(matching.word_sets(titles, "option_id", "title").withColumn("task", F.lit("topics")))
    )
    found = matching.multi_task_classify(matching.word_sets(t.documents, "doc_id", "text"), tasks)
    return found.withColumn("selected", F.array_join(F.col("selected").cast("array<string>"), ","))
