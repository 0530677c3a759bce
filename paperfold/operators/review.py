"""The review step: scores, edits and choices on staged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperfold.functions.ordering import hot_keys, split_hot
from paperfold.operators.extraction import staged_cells

CLEAN_THRESHOLD = 0.75
CELL = ["document_id", "row_index", "field"]

# Edits of a document that may travel with each of its rows; beyond, cells meet edits one by one.
MANY_EDITS = 1_000


def surviving_confidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores after an edit: kept only where the same cell holds the same value.

    NULL equals NULL; an added row starts without scores.
    """
    before = old.select(*CELL, F.col("value").alias("__old"), F.col("confidence").alias("__score"))
    edited = new.drop("confidence").join(before, CELL, "left")
    same = F.col("value").eqNullSafe(F.col("__old"))
    return edited.withColumn("confidence", F.when(same, F.col("__score"))).drop("__old", "__score")


def surviving_row_confidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """`surviving_confidence` on flattened records: rows are matched once and their maps compared.

    old: document_id, row_index, data, data_confidence; new: document_id, row_index,
    data. Gives new with data_confidence, which holds the scores that survive.

    Old and new rows meet in a window over their union: rows that are dealt by
    document_id already, as `flatten` leaves them, are not shuffled again, which a join
    by document_id and row_index would do.
    """
    key = ["document_id", "row_index"]
    fresh = new.select(*key, *[c for c in new.columns if c not in (*key, "data_confidence")])
    # Rows without a key match nothing. A row that stands twice matches twice.
    before = old.dropna(subset=key).select(*key, F.struct("data", "data_confidence").alias("__before"))
    both = fresh.unionByName(before, allowMissingColumns=True)
    found = both.withColumn("__found", F.collect_list("__before").over(W.partitionBy(*key))).filter("__before IS NULL")
    met = found.select(*fresh.columns, F.explode_outer("__found").alias("__before")).select(
        *fresh.columns, F.col("__before.data").alias("__old"), F.col("__before.data_confidence").alias("__scores")
    )
    # Most rows of an edit stay as they were: compared as a whole first.
    untouched = (F.map_entries("data") == F.map_entries("__old")) & (
        F.size(F.array_except(F.map_keys("__scores"), F.map_keys("data"))) == 0
    )

    def kept_field(field: Column, _) -> Column:
        now, was = F.try_element_at("data", field), F.try_element_at("__old", field)
        both_null = now.isNull() & was.isNull() & F.map_contains_key("data", field) & F.map_contains_key("__old", field)
        return F.coalesce(now == was, both_null)

    same = F.map_filter("__scores", kept_field)
    none = F.create_map().cast("map<string,double>")
    kept = F.when(untouched, F.col("__scores")).otherwise(same)
    return met.withColumn("data_confidence", F.coalesce(kept, none)).drop("__old", "__scores")


def is_clean(cells: DataFrame, threshold: float = CLEAN_THRESHOLD) -> DataFrame:
    """(document_id, clean): every numeric score of every row reaches the threshold.

    A missing score does not count, and a document without scores is clean.
    """
    low = F.coalesce(F.col("confidence") < threshold, F.lit(False))
    return cells.groupBy("document_id").agg((~F.bool_or(low)).alias("clean"))


def is_clean_rows(rows: DataFrame, threshold: float = CLEAN_THRESHOLD) -> DataFrame:
    """`is_clean` on flattened records: scores are tested inside the row, not exploded."""
    low = F.exists(F.map_values("data_confidence"), lambda score: F.coalesce(score < threshold, F.lit(False)))
    return rows.groupBy("document_id").agg((~F.bool_or(F.coalesce(low, F.lit(False)))).alias("clean"))


def confirm_all_clean(jobs: DataFrame, clean: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(batch_id, document_id, outcome) for jobs awaiting review: confirmed or skipped.

    One row per job rather than id lists per batch: a batch can be very large.
    failures: document_id of confirms that were refused.
    """
    out = (
        jobs.filter("status = 'awaiting_review'")
        .join(clean, "document_id", "left")
        .withColumn("__ok", F.coalesce("clean", F.lit(True)))
    )
    if failures is not None:
        bad = failures.select("document_id", F.lit(True).alias("__bad")).distinct()
        out = out.join(bad, "document_id", "left").withColumn("__ok", F.col("__ok") & F.col("__bad").isNull())
    return out.select("batch_id", "document_id", F.when(F.col("__ok"), "confirmed").otherwise("skipped").alias("outcome"))


def low_confidence_cells(cells: DataFrame, threshold: float = CLEAN_THRESHOLD) -> DataFrame:
    """How many cells fall below the threshold, per document and field."""
    return (
        cells.filter(F.col("confidence") < threshold)
        .groupBy("document_id", "field")
        .agg(F.count(F.lit(1)).alias("low_cells"), F.min("confidence").alias("lowest"))
    )


def fill_down(cells: DataFrame, edits: DataFrame, scopes: DataFrame) -> DataFrame:
    """Applies cell edits; an edit in a document-scoped column goes to every row.

    edits: document_id, row_index, field, value (one per cell)
    scopes: field, scope. Row and unknown scopes stay local to the cell.
    """
    scoped = edits.join(scopes, "field", "left")
    whole = scoped.filter("scope = 'document'").groupBy("document_id", "field").agg(
        F.max_by("value", "row_index").alias("__whole"), F.lit(True).alias("__has_whole")
    )
    local = scoped.filter("coalesce(scope, 'row') <> 'document'").select(
        *CELL, F.col("value").alias("__cell"), F.lit(True).alias("__has_cell")
    )
    return (
        cells.join(whole, ["document_id", "field"], "left")
        .join(local, CELL, "left")
        .withColumn(
            "value",
            F.when(F.col("__has_cell"), F.col("__cell"))
            .when(F.col("__has_whole"), F.col("__whole"))
            .otherwise(F.col("value")),
        )
        .drop("__whole", "__has_whole", "__cell", "__has_cell")
    )


def fill_down_rows(
    rows: DataFrame, edits: DataFrame, scopes: DataFrame, hot: DataFrame | None = None, many_edits: int = MANY_EDITS
) -> DataFrame:
    """`fill_down` on flattened records; gives their cells, as `staged_cells` does.

    The edits of a document are gathered first and meet its rows by document_id, the
    key that `flatten` leaves rows dealt by, so cells are made after the join and
    never shuffled. Documents with very many edits, or very many rows (`hot`, see
    `hot_keys`), go cell by cell.
    """
    key = ["document_id"]
    apart = hot_keys(edits, key, many_edits)
    apart = apart if hot is None else apart.unionByName(hot.select(*key)).distinct()

    def by_row(some: DataFrame) -> DataFrame:
        own = edits.filter("document_id IS NOT NULL").join(F.broadcast(apart), key, "left_anti")
        own = own.join(scopes, "field", "left").repartition(*key)
        whole = (
            own.filter("scope = 'document'")
            .groupBy(*key, "field")
            .agg(F.max_by("value", "row_index").alias("value"))
            .groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__whole"))
        )
        # An edit that stands twice gives its cell twice, as a join does, so each cell keeps a list.
        local = (
            own.filter("coalesce(scope, 'row') <> 'document' AND row_index IS NOT NULL AND field IS NOT NULL")
            .groupBy(*CELL)
            .agg(F.collect_list(F.struct("value")).alias("values"))
            .groupBy(*key, "row_index")
            .agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("fields"))
            .groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("row_index", "fields"))).alias("__local"))
        )
        met = some.join(whole.hint("merge"), key, "left").join(local.hint("merge"), key, "left")
        each = met.select(
            "document_id",
            "row_index",
            "data_confidence",
            "__whole",
            F.try_element_at("__local", F.col("row_index")).alias("__cells"),
            F.explode("data").alias("field", "value"),
        )
        value = F.when(F.map_contains_key("__whole", F.col("field")), F.try_element_at("__whole", F.col("field"))).otherwise(F.col("value"))
        found = F.coalesce(F.try_element_at("__cells", F.col("field")), F.array(F.struct(value.alias("value"))))
        confidence = F.try_element_at("data_confidence", F.col("field")).alias("confidence")
        return each.select(*CELL, confidence, F.explode(found).alias("__found")).select(*CELL, "__found.value", "confidence")

    def by_cell(some: DataFrame) -> DataFrame:
        theirs = edits.join(F.broadcast(apart), key, "left_semi")
        return fill_down(staged_cells(some), theirs, scopes).select(*CELL, "value", "confidence")

    return split_hot(rows, key, apart, by_row, by_cell)


def review_columns(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """(document_id, field, position): declared fields in order, then undeclared
    keys in the order they first appear.

    declared: document_id, field, pos. Columns per document are few, so the
    numbering window works on the reduced list.
    """
    from pyspark.sql.window import Window as W

    # First seen by row, then by name: a map does not keep a key order.
    seen = cells.groupBy("document_id", "field").agg(F.min("row_index").alias("__row"))
    both = seen.join(declared, ["document_id", "field"], "full")
    order = W.partitionBy("document_id").orderBy(
        F.col("pos").asc_nulls_last(), F.col("__row").asc_nulls_last(), "field"
    )
    return both.withColumn("position", F.row_number().over(order) - 1).select(
        "document_id", "field", "position", F.col("pos").isNotNull().alias("declared")
    )


def patch_schema(staged: DataFrame, choices: DataFrame, versions: DataFrame) -> DataFrame:
    """Points staged documents at the newest version of the schema chosen for them.

    choices: document_id, chosen_schema_id. An unknown schema is an error and
    changes nothing.
    """
    newest = versions.groupBy(F.col("schema_id").alias("chosen_schema_id")).agg(F.max("version").alias("__version"))
    out = staged.join(choices, "document_id", "left").join(newest, "chosen_schema_id", "left")
    picked = F.col("__version").isNotNull()
    return out.select(
        "document_id",
        F.when(picked, F.col("chosen_schema_id")).otherwise(F.col("matched_schema_id")).alias("matched_schema_id"),
        F.when(picked, F.col("__version")).otherwise(F.col("schema_version_id")).alias("schema_version_id"),
        F.when(F.col("chosen_schema_id").isNotNull() & ~picked, "unknown schema_id").alias("error"),
    )


def drop_dead_topics(staged_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """Suggested (document_id, topic_id) whose topic still exists."""
    return staged_topics.join(topics.select("topic_id"), "topic_id", "left_semi")


def strip_embeddings(chunks: DataFrame) -> DataFrame:
    """What review shows of chunks: everything but the vectors."""
    return chunks.drop("embedding")
