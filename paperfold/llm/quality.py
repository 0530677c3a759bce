"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Two questions are asked of a document. Inside it: too few words, or too many
words in repeated five-word windows. Across documents: lines that more than
`line_limit` different documents of one host carry, and more than `line_percent`
of them, are furniture of that host and are removed; a document of which too
little remains is depleted.

Lines are compared lower-cased, trimmed, with single blanks and digits read as
0, by 64-bit hash. Copies of one text count as one document, and the document
with the smallest doc_id among the carriers of a line keeps it, so a text that
was only copied often never vanishes from the host altogether.

Defined results: a null text has no words and fails the base rules; rows without
a source belong to one host of their own; each row is judged by itself, also one of
several with one doc_id or none, and a row without a doc_id is never a line's first
carrier where another has one; of equal first carriers all keep the line; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm.rows import ROW, numbered, without
from paperfold.session import as_table

# Fixed values of the base rules.
_BREAK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[^#*$%&|<>]+"
_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Documents of a host that may carry a line. A template line stays on its share of the
# pages however many a host has, so a share separates it from a line many authors hit
# upon; below 1,000 documents one percent would be a handful that chance explains, so
# the floor holds there.
HOST_FLOOR = 10
HOST_PERCENT = 1
# A document is depleted when less than this share of its words remains.
MIN_LEFT_PERCENT = 30


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` and the base counts of each row, all computed inside the row.
    `keep`: further columns of docs.

    A five-word window is a match of one look-ahead pattern, so no word arrays
    are sliced. Only where windows repeat are they sorted with their places; a
    repeated window at place p covers p to p+4, and sorted places turn the union
    of these intervals into a sum of gaps.
    """
    squeezed = docs.select(
        "doc_id",
        *keep,
        F.trim(F.regexp_replace(_text(), _BREAK, " ")).alias("plain"),
        F.split(_text(), "\n").alias("lines"),
        F.length(F.regexp_replace(_text(), _SYMBOLS, "")).cast("bigint").alias("n_symbols"),
    )
    counted = squeezed.select(
        "doc_id",
        *keep,
        "n_symbols",
        F.filter("lines", lambda x: x.rlike(_WORD)).alias("lines"),
        F.length(F.replace("plain", F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        F.length("plain").alias("__n"),
        F.regexp_extract_all(
            "plain", F.lit(f"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{_WINDOW - 1}}}))"), F.lit(1)
        ).alias("windows"),
    ).withColumn(
        "n_words", F.when(F.col("__n") > 0, F.col("__n") - F.col("word_chars") + 1).otherwise(0).cast("bigint")
    )
    ranked = counted.withColumn(
        "ranked",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    )
    at = F.filter(
        F.transform(
            "ranked",
            lambda x, k: F.when(
                x["w"].eqNullSafe(F.get(F.col("ranked"), k - 1)["w"])
                | x["w"].eqNullSafe(F.get(F.col("ranked"), k + 1)["w"]),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.transform(
            "places",
            lambda p, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(_WINDOW))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    placed = ranked.withColumn("places", F.array_sort(at))
    return placed.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _BREAK, " "), "[0-9]", "0")))


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per row of docs and line with a word: host, content, line hash, its words there."""
    rows = (
        docs.select(
            "doc_id",
            _host().alias("host"),
            F.xxhash64(_text()).alias("content"),
            F.explode(F.split(_text(), "\n")).alias("line"),
        )
        .filter(F.col("line").rlike(_WORD))
        .withColumn("line", _normal(F.col("line")))
    )
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "host", "content", F.xxhash64("line").alias("line"), words.alias("words"))


def _host() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def host_sizes(docs: DataFrame) -> DataFrame:
    """Different documents with a word of each host."""
    worded = docs.filter(_text().rlike(_WORD))
    texts = worded.select(_host().alias("host"), F.xxhash64(_text()).alias("content"))
    return texts.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))


def frequent_lines(lines: DataFrame, sizes: DataFrame, line_limit: int, line_percent: float) -> DataFrame:
    """host, line and first carrier of lines in more than `line_limit` different
    documents of the host and more than `line_percent` of them.
    The steps combine before they shuffle."""
    carriers = lines.groupBy("host", "line", "content").agg(F.min("doc_id").alias("first_id"))
    frequent = (
        carriers.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("carriers"), F.min("first_id").alias("first_id"))
        .filter(F.col("carriers") > line_limit)
    )
    return frequent.join(sizes, "host").filter(100 * F.col("carriers") > line_percent * F.col("size")).drop("size")


def quality_rules(
    docs: DataFrame,
    line_limit: int = HOST_FLOOR,
    line_percent: float = HOST_PERCENT,
    min_left_percent: int = MIN_LEFT_PERCENT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, removed words and verdict of each row, with the columns `keep`.

    What is removed depends on doc_id, host and text alone, so equal rows are worked
    out once and every row finds its own. The frequent lines are stored first: Spark
    then knows their size and sends them to all tasks only when that is small;
    otherwise both sides shuffle and adaptive execution splits a line that many
    documents carry.
    """
    lines = document_lines(docs)
    frequent = as_table(frequent_lines(lines, host_sizes(docs), line_limit, line_percent), "frequent-lines")
    carried = lines.join(frequent, ["host", "line"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    removed = (
        # Rows of one doc_id, host and text count their lines together; `rows` parts them again.
        carried.groupBy("doc_id", "host", "content")
        .agg(F.sum("words").alias("all_words"), F.collect_set("line").alias("removed_lines"))
        .toDF("__doc_id", "__host", "__content", "all_words", "removed_lines")
    )
    # Stored, since a filter on these counts would otherwise be pushed below the steps
    # that compute them, where each would be worked out again for every window.
    counted = text_counts(docs.withColumns({"__h": _host(), "__c": F.xxhash64(_text())}), ("__h", "__c", *keep))
    counts = as_table(counted, "text-counts")
    rows = counts.groupBy("doc_id", "__h", "__c").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
    same = [F.col("doc_id").eqNullSafe(F.col("__doc_id")), F.col("__h") == F.col("__host"), F.col("__c") == F.col("__content")]
    repeats = rows.toDF("__r_id", "__r_h", "__r_c", "__rows")
    again = [F.col("doc_id").eqNullSafe(F.col("__r_id")), F.col("__h") == F.col("__r_h"), F.col("__c") == F.col("__r_c")]
    own = (F.coalesce("all_words", F.lit(0)) / F.coalesce("__rows", F.lit(1))).cast("bigint")
    left = F.col("n_words") - F.col("removed_words")
    return (
        counts.join(removed, same[0] & same[1] & same[2], "left")
        .join(repeats, again[0] & again[1] & again[2], "left")
        .withColumn("removed_words", own)
        .withColumn("base_failed", base_failed())
        .withColumn(
            "depleted",
            (F.col("removed_words") > 0)
            & ((left < MIN_WORDS) | (100 * left < min_left_percent * F.col("n_words"))),
        )
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("__h", "__c", "__doc_id", "__host", "__content", "all_words", "__r_id", "__r_h", "__r_c", "__rows")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that pass, unchanged, so that exact copies stay exact copies
    for the steps after this one; `without_furniture` takes the lines out."""
    rows = numbered(docs)
    return without(rows, quality_rules(rows, keep=(ROW,)).filter(~F.col("kept")))


def without_furniture(docs: DataFrame) -> DataFrame:
    """All rows without the removed lines of their host; `n_chars`, where there
    is one, counts what remains. It makes copies in different hosts, and copies of a
    line's first carrier, different: it belongs after deduplication."""
    rows = numbered(docs)
    gone = quality_rules(rows, keep=(ROW,)).filter("removed_words > 0").select(ROW, F.col("removed_lines").alias("__gone"))
    joined = rows.join(gone, ROW, "left")
    rest = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("__gone"), line_hash(x)))
    joined = joined.withColumn(
        "text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    )
    if "n_chars" in docs.columns:
        chars = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        joined = joined.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
