"""From model replies to staged records: parse, coerce, merge, flatten.

Long-form cells (`document_id, row_index, field, value, confidence`) make
review and merging set-based; the wide form keeps one MAP per record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.coerce import coerce_value_sql
from paperfold.functions.ordering import HOT_ROWS, along, hot_keys, ordered_index, previous_within, running_within
from paperfold.operators.lineage import field_scope
from paperfold.session import as_table, let_go
from paperfold.sources.elements import per_document

MAX_EXTRACT_CHARS = 40_000
# Rows of one document handled together; a longer document spans slices.
ROW_SLICE = 10_000

# The headings and markers of a prompt.
ALL_FIELDS = "Fields:"
DOCUMENT_FIELDS = "Document-level fields:"
ROW_FIELDS = "Per-row fields:"
FEEDBACK_OPEN = "--- REVIEWER FEEDBACK ---"
FEEDBACK_CLOSE = "--- END REVIEWER FEEDBACK ---"

_PART = "struct<values:map<string,string>,confidence:map<string,string>>"
REPLY_SCHEMA = (
    f"struct<values:map<string,string>,confidence:map<string,string>,document:{_PART},rows:array<{_PART}>>"
)


def render_field_prompt(fields: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Per schema: one line per field, document and row groups apart, feedback last.

    `fields` holds one version per schema; `feedback` is (schema_id, feedback).
    """
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), F.coalesce("description", F.lit("")))

    def lines(scope: str) -> Column:
        gathered = F.array_sort(F.collect_list(F.when(field_scope() == scope, F.struct("pos", line.alias("line")))))
        return F.array_join(F.transform(gathered, lambda e: e["line"]), "\n")

    grouped = fields.groupBy("schema_id").agg(
        lines("document").alias("__document"), lines("row").alias("__rows")
    )
    body = F.when(F.col("__rows") == "", F.concat(F.lit(f"{ALL_FIELDS}\n"), "__document")).otherwise(
        F.concat(F.lit(f"{DOCUMENT_FIELDS}\n"), "__document", F.lit(f"\n\n{ROW_FIELDS}\n"), "__rows")
    )
    out = grouped.withColumn("prompt", body)
    if feedback is not None:
        block = F.concat(
            F.lit(f"\n\n{FEEDBACK_OPEN}\n"), "feedback", F.lit(f"\n{FEEDBACK_CLOSE}")
        )
        # One row per schema on both sides: neither goes to the driver whole.
        out = out.join(feedback.hint("merge"), "schema_id", "left").withColumn(
            "prompt", F.concat("prompt", F.coalesce(block, F.lit("")))
        )
    return out.select("schema_id", "prompt")


def model_map(df: DataFrame, make_client: Callable[[], Callable[[str], tuple[str, bool]]]) -> DataFrame:
    """Sends `prompt` of each row to a model; adds reply_json and error.

    `make_client` runs once per task and returns a function prompt -> (reply,
    complete). An incomplete reply is an error, never a short result, and a
    failing row does not fail its neighbours.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_client()
        for batch in batches:
            replies, errors = [], []
            for prompt in batch["prompt"]:
                reply, error = None, None
                try:
                    reply, complete = ask(prompt)
                    if not complete:
                        reply, error = None, "reply was cut off at the length limit"
                except Exception as exc:  # isolated to its row
                    error = str(exc)
                replies.append(reply)
                errors.append(error)
            yield batch.assign(reply_json=replies, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, reply_json string, error string")


def route_by_length(docs: DataFrame, text: str = "text", limit: int = MAX_EXTRACT_CHARS) -> DataFrame:
    """one_shot up to the limit, chunked beyond it."""
    return docs.withColumn("route", F.when(F.length(text) <= limit, "one_shot").otherwise("chunked"))


def parse_reply(replies: DataFrame, multirow: Column) -> DataFrame:
    """reply_json as columns values, confidence, rows; missing parts are empty.

    A flat schema answers {values, confidence}; one with row fields answers
    {document: {...}, rows: [{...}]}. Scores that are not numbers read as NULL.
    `error` is set where the reply is missing or no JSON object; such a reply
    must not be taken for one without values.
    """
    reply = replies.withColumn("__reply", F.from_json("reply_json", REPLY_SCHEMA))
    # Where a part was read, the reply is an object; only others are read again to see.
    read = reduce(Column.__or__, [F.col(f"__reply.{part}").isNotNull() for part in ("values", "confidence", "document", "rows")])
    object_ = (F.col("reply_json").rlike(r"^\s*\{") & read) | F.from_json("reply_json", "map<string,string>").isNotNull()
    nothing = F.create_map().cast("map<string,string>")

    def scores(column: Column) -> Column:
        return F.transform_values(F.coalesce(column, nothing), lambda _, v: v.try_cast("double"))

    rows = F.transform(
        F.coalesce(F.col("__reply.rows"), F.array().cast(f"array<{_PART}>")),
        lambda r: F.struct(
            F.coalesce(r["values"], nothing).alias("values"), scores(r["confidence"]).alias("confidence")
        ),
    )
    empty_rows = F.array().cast("array<struct<values:map<string,string>,confidence:map<string,double>>>")
    return reply.select(
        *[c for c in replies.columns if c != "reply_json"],
        F.coalesce(F.when(multirow, F.col("__reply.document.values")).otherwise(F.col("__reply.values")), nothing).alias("values"),
        scores(
            F.when(multirow, F.col("__reply.document.confidence")).otherwise(F.col("__reply.confidence"))
        ).alias("confidence"),
        F.when(multirow, rows).otherwise(empty_rows).alias("rows"),
        F.when(~F.coalesce(object_, F.lit(False)), "the reply is not a JSON object").alias("error"),
    )


def reply_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The repeating rows of parsed replies, long form: keys, pos, values, confidence."""
    return parsed.select(*keys, F.posexplode("rows").alias("pos", "row")).select(*keys, "pos", "row.*")


def coerce_record(records: DataFrame, fields: DataFrame, on: list[str], data: str = "data") -> DataFrame:
    """Normalises each map entry to its declared type; undeclared keys pass.

    The types of a version arrive as one map per version: one small join, then
    a map rewrite inside the row.
    """
    types = fields.groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("__types")
    )
    coerced = f"transform_values({data}, (k, v) -> {coerce_value_sql('v', 'try_element_at(__types, k)')})"
    return (
        records.join(types, on, "left")
        .withColumn("__types", F.coalesce("__types", F.create_map().cast("map<string,string>")))
        .withColumn(data, F.expr(coerced))
        .drop("__types")
    )


def coerce_cells(cells: DataFrame, fields: DataFrame, on: list[str]) -> DataFrame:
    """The same rule over long-form cells (field, value)."""
    types = fields.select(*on, F.col("name").alias("field"), F.col("type").alias("__type"))
    return (
        cells.join(types, [*on, "field"], "left")
        .withColumn("value", F.expr(coerce_value_sql("value", "coalesce(__type, 'string')")))
        .drop("__type")
    )


def merge_header_chunks(cells: DataFrame) -> DataFrame:
    """Document-level values seen by several chunks (document_id, chunk_no, field, value, confidence).

    The last non-null value wins. Its confidence is the chunk's own when the
    value is new or repeats the running one, and the lower of both when it
    disagrees with it. In closed form: a run starts at the first value and at
    every repeat of the value before; the result is the lowest score of the
    last run. No score counts as 0.
    """
    keys = ["document_id", "field"]
    seen = cells.filter("value IS NOT NULL").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    starts = F.col("__last").isNull() | (F.col("__last.value") == F.col("value"))

    def number_runs(rows: DataFrame, cut: Column | None) -> DataFrame:
        with_last = previous_within(rows, keys, ["chunk_no"], ["value"], "__last", cut)
        return running_within(with_last, keys, ["chunk_no"], sums={"__run": starts.cast("int")}, coarse=cut)

    runs = along(seen, keys, F.floor(F.col("chunk_no") / 1024), number_runs)
    per_run = runs.groupBy(*keys, "__run").agg(
        F.min("confidence").alias("confidence"), F.max_by("value", "chunk_no").alias("value")
    )
    return per_run.groupBy(*keys).agg(
        F.max_by("value", "__run").alias("value"), F.max_by("confidence", "__run").alias("confidence")
    )


def concat_chunk_rows(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Rows of all chunks in order (document_id, chunk_no, pos, values, ...).

    A row whose every value is NULL says "no line items here" and is dropped.
    `hot`: documents with very many rows, where the caller knows them (see `hot_keys`).
    """
    informative = F.exists(F.map_values("values"), lambda v: v.isNotNull())
    # One chunk of a hot document may itself be large, so slices follow the position too.
    coarse = F.struct("chunk_no", F.floor(F.col("pos") / ROW_SLICE).alias("part"))
    return ordered_index(
        rows.filter(informative), ["document_id"], ["chunk_no", "pos"], coarse, "row_index", hot
    ).drop("chunk_no", "pos")


def flatten(header: DataFrame, rows: DataFrame, hot: DataFrame | None = None, slice_rows: int = ROW_SLICE) -> DataFrame:
    """Header values on every row; a document without rows keeps one record.

    header: document_id, values, confidence (one per document)
    rows:   document_id, row_index, values, confidence
    A row value wins over a header value of the same name. For a document with
    very many rows (`hot`, see `hot_keys`) the header is repeated once per slice
    of its rows, so its rows spread over tasks.
    """
    key = ["document_id"]
    few = F.broadcast(hot if hot is not None else hot_keys(rows, key))
    lines = rows.select(
        "document_id",
        "row_index",
        F.col("values").alias("__values"),
        F.col("confidence").alias("__confidence"),
    )
    # Both sides are data-sized: join by shuffle, which per-document work after it reuses.
    cold_lines = lines.join(few, key, "left_anti").hint("merge")
    ordinary = header.join(few, key, "left_anti").join(cold_lines, key, "left")
    sliced = lines.join(few, key, "left_semi").withColumn("__slice", F.floor(F.col("row_index") / slice_rows))
    slices = sliced.select("document_id", "__slice").distinct()
    # Cut to hot documents before the shuffle: without any, no header is sent a second time.
    spread = header.join(few, key, "left_semi").join(slices, key).join(sliced, ["document_id", "__slice"]).drop("__slice")

    def over(base: str, top: str) -> Column:
        return F.when(F.col(top).isNull(), F.col(base)).otherwise(F.map_concat(base, top))

    extra = [c for c in header.columns if c not in ("document_id", "values", "confidence")]
    return ordinary.unionByName(spread).select(
        "document_id",
        *extra,
        F.coalesce("row_index", F.lit(0)).alias("row_index"),
        over("values", "__values").alias("data"),
        over("confidence", "__confidence").alias("data_confidence"),
    )


def split_long(docs: DataFrame, text: str = "text", limit: int = MAX_EXTRACT_CHARS) -> DataFrame:
    """(document_id, chunk_no, part): a text up to the limit whole, a longer one in
    parts cut at white space; only a word longer than the limit is cut itself."""

    def parts(whole: str | None) -> Iterator[tuple[int, str]]:
        rest, number = whole or "", 0
        at = 0
        while len(rest) - at > limit:
            end = max(rest.rfind(mark, at + 1, at + limit) for mark in (" ", "\n", "\t"))
            end = end if end > at else at + limit
            yield number, rest[at:end]
            at, number = end, number + 1
        yield number, rest[at:]

    return per_document(docs, text, parts, ["chunk_no", "part"], ["int", "string"])


def extract_documents(
    docs: DataFrame,
    make_client: Callable[[], Callable[[str], tuple[str, bool]]],
    text: str = "text",
    limit: int = MAX_EXTRACT_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(flattened records, errors) of documents of any length.

    A document goes to the model in parts; header values of its parts are
    merged, rows follow each other. A document of which any part failed is an
    error as a whole: it never becomes a record with something missing. Replies
    are stored as read, so no part is sent, and no reply read, twice. docs: document_id
    and the text.
    """
    asked = split_long(docs, text, limit).withColumnRenamed("part", "prompt")
    replies = model_map(asked, make_client).drop("prompt").withColumnRenamed("error", "call_error")
    parsed = as_table(parse_reply(replies, F.lit(True)), "replies")
    let_go(docs.sparkSession)
    problem = F.coalesce("call_error", "error")
    errors = parsed.filter(problem.isNotNull()).groupBy("document_id").agg(F.min_by(problem, "chunk_no").alias("error"))
    good = parsed.join(errors.select("document_id"), "document_id", "left_anti")
    cells = good.select(
        "document_id", "chunk_no", "confidence", F.explode_outer("values").alias("field", "value")
    ).withColumn("confidence", F.try_element_at("confidence", F.col("field")))
    merged = merge_header_chunks(cells.filter("field IS NOT NULL"))
    entries = F.collect_list(F.struct("field", "value", "confidence"))
    maps = merged.groupBy("document_id").agg(entries.alias("__cells")).select(
        "document_id",
        F.map_from_entries(F.transform("__cells", lambda c: F.struct(c["field"], c["value"]))).alias("__values"),
        F.map_from_entries(F.transform("__cells", lambda c: F.struct(c["field"], c["confidence"]))).alias("__scores"),
    )
    header = good.select("document_id").distinct().join(maps, "document_id", "left").select(
        "document_id",
        F.coalesce("__values", F.create_map().cast("map<string,string>")).alias("values"),
        F.coalesce("__scores", F.create_map().cast("map<string,double>")).alias("confidence"),
    )
    # Counted by replies, before rows are taken out of them.
    many = parsed.groupBy("document_id").agg(F.sum(F.size("rows")).alias("n"))
    hot = many.filter(F.col("n") > HOT_ROWS).select("document_id")
    rows = concat_chunk_rows(reply_rows(good, ["document_id", "chunk_no"]), hot)
    return flatten(header, rows, hot), errors


def staged_cells(records: DataFrame) -> DataFrame:
    """Long form of flattened records: document_id, row_index, field, value, confidence."""
    return records.select(
        "document_id", "row_index", "data_confidence", F.explode("data").alias("field", "value")
    ).select(
        "document_id",
        "row_index",
        "field",
        "value",
        F.try_element_at("data_confidence", F.col("field")).alias("confidence"),
    )


def merge_reextract(staged: DataFrame, fresh: DataFrame) -> DataFrame:
    """Puts a re-run's table into the staged payload and leaves the rest alone.

    Schema, topics, dedup match and chunks stay. Pending feedback moves to the
    history, so it applies exactly once. fresh: document_id, extracted_data,
    data_confidence.
    """
    new = fresh.select(
        "document_id",
        F.col("extracted_data").alias("__data"),
        F.col("data_confidence").alias("__confidence"),
        F.lit(True).alias("__fresh"),
    )
    renewed = F.coalesce(F.col("__fresh"), F.lit(False))
    pending = renewed & F.col("reextract_feedback").isNotNull()
    return (
        staged.join(new, "document_id", "left")
        .withColumns(
            {
                "extracted_data": F.when(renewed, F.col("__data")).otherwise(F.col("extracted_data")),
                "data_confidence": F.when(renewed, F.col("__confidence")).otherwise(F.col("data_confidence")),
                "reextract_history": F.when(
                    pending, F.array_append("reextract_history", F.col("reextract_feedback"))
                ).otherwise(F.col("reextract_history")),
                "reextract_feedback": F.when(~renewed, F.col("reextract_feedback")),
            }
        )
        .drop("__data", "__confidence", "__fresh")
    )


def backfill_payload(documents: DataFrame, schemas: DataFrame) -> DataFrame:
    """Backfill jobs: every document of the schemas to re-read, at their newest version.

    schemas: schema_id, version. Only the table is extracted again, so topics
    and chunks are not part of the payload.
    """
    newest = schemas.groupBy("schema_id").agg(F.max("version").alias("schema_version_id"))
    return documents.drop("schema_version_id").join(newest, "schema_id").select(
        "document_id",
        "schema_id",
        "schema_version_id",
        F.lit("backfill").alias("kind"),
        F.lit("pending").alias("status"),
    )


def infer_schema(cells: DataFrame) -> DataFrame:
    """Proposes fields from observed values: the narrowest type all of them take.

    (field, type, description, required). One pass, aggregated before the
    shuffle, so the field with most cells costs no more than the others.
    """
    from paperfold.functions.casts import plain_date_sql, safe_timestamp_sql

    value = "value"
    fits = {
        "integer": "value RLIKE '^[+-]?[0-9]+$' AND try_cast(value AS INT) IS NOT NULL",
        "number": "try_cast(value AS DECIMAL(38,10)) IS NOT NULL",
        "boolean": "try_cast(value AS BOOLEAN) IS NOT NULL",
        "date": plain_date_sql(value),
        "datetime": f"({safe_timestamp_sql(value)}) IS NOT NULL",
    }
    # NULL cells say nothing about the type, only about `required`.
    checks = [
        F.expr(f"coalesce(bool_and(CASE WHEN value IS NOT NULL THEN {test} END), false)").alias(f"__{kind}")
        for kind, test in fits.items()
    ]
    grouped = cells.groupBy("field").agg(
        *checks,
        F.every(F.col("value").isNotNull()).alias("required"),
        F.count(F.lit(1)).alias("cells"),
    )
    ladder = F.coalesce(*[F.when(F.col(f"__{kind}"), kind) for kind in fits], F.lit("string"))
    return grouped.select(
        F.col("field").alias("name"),
        ladder.alias("type"),
        F.concat(F.lit("seen in "), F.col("cells").cast("string"), F.lit(" cells")).alias("description"),
        "required",
    )
