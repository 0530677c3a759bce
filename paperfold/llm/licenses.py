"""License scans by ordered signature rules, in DataFrame functions alone.

A text meets rules only if it passes a keyword filter, and then only the rules
whose own keyword it holds. Detections are intervals of words. One that lies
within another is dropped (of equal ones the rule of higher priority stays), and
of two that overlap in part the one of higher priority stays.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are scanned row by row; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperfold.llm import license_rules
from paperfold.session import as_table

# Fixed value: what lies between words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A text without any of these holds nothing that a rule could match.
_GATE = (
    r"(?i)licen[cs]|spdx|under[\x00-/:-@\[-`{-\x7F]|subject|govern|accordance"
    r"|cc[\x00-/:-@\[-`{-\x7F]+by|(?:see|read|accept|dedicated)[\x00-/:-@\[-`{-\x7F]"
)


def _words(column: Column) -> Column:
    """Number of words in words joined by single blanks, with or without blanks around."""
    plain = F.trim(column)
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def scanned(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_words of each row, and its words where a rule may match. Stored,
    so the row numbers stay what they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.trim(F.regexp_replace(text, _SEPARATORS, " "))
    keywords = "|".join(sorted({r.keyword.replace(" ", "[^0-9a-z]+") for r in license_rules.rules()}))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", words.alias("words"), text.alias("text")
    )
    lower = F.translate("words", string.ascii_uppercase, string.ascii_lowercase)
    gate = F.col("text").rlike(_GATE) & F.col("text").rlike(f"(?i){keywords}")
    return as_table(
        rows.select("uid", "doc_id", _words(F.col("words")).cast("bigint").alias("n_words"), F.when(gate, lower).alias("words")),
        "license-words",
    )


def detections(rows: DataFrame) -> DataFrame:
    """uid, start, end (words), and the rule, of every match.

    The rule table is fixed and small, so it is broadcast; texts never shuffle.
    """
    table = rows.sparkSession.createDataFrame(
        license_rules.rules(), "priority int, label string, keyword string, pattern string, weight int, base boolean"
    )
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in license_rules.rules()})])
    held = rows.filter("words IS NOT NULL").select("uid", "words")
    met = held.withColumn("keyword", F.explode(F.filter(keywords, lambda k: F.contains(F.col("words"), k))))
    met = met.join(F.broadcast(table), "keyword")
    found = met.filter(F.expr("words RLIKE pattern")).select(
        "uid",
        "priority",
        "label",
        "weight",
        "base",
        F.expr("regexp_extract_all(words, pattern, 0)").alias("hits"),
        F.expr("split(words, pattern)").alias("gaps"),
    )
    sized = F.transform(
        "hits",
        lambda hit, k: F.struct(_words(F.get("gaps", k)).alias("gap"), _words(hit).alias("size"), k.alias("at")),
    )
    each = found.select("uid", "priority", "label", "weight", "base", F.explode(sized).alias("hit"))
    before = Window.partitionBy("uid", "priority", "label").orderBy("hit.at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("hit.gap") + F.col("hit.size")).over(before) - F.col("hit.size")
    placed = each.withColumn("start", start.cast("bigint"))
    return placed.select(
        "uid", "start", (F.col("start") + F.col("hit.size")).alias("end"), "priority", "label", "weight", "base"
    )


def resolved(found: DataFrame) -> DataFrame:
    """Detections left after containment and priority."""
    order = [F.col("start"), F.col("end").desc(), F.col("priority"), F.col("label")]
    earlier = Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("reach", F.max("end").over(earlier)).filter("reach IS NULL OR end > reach").drop("reach")
    beside = Window.partitionBy("uid").orderBy(*order)
    near = outer.withColumns(
        {
            "before": F.lag(F.struct("end", "priority")).over(beside),
            "after": F.lead(F.struct("start", "priority")).over(beside),
        }
    )
    beaten = (F.col("before.end") > F.col("start")) & (F.col("before.priority") < F.col("priority"))
    beaten |= (F.col("after.start") < F.col("end")) & (F.col("after.priority") < F.col("priority"))
    return near.filter(~F.coalesce(beaten, F.lit(False))).drop("before", "after")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places and labels, all labels, score."""
    rows = scanned(docs)
    found = as_table(detections(rows), "license-hits")
    base = (
        found.filter("base")
        .groupBy("uid")
        .agg(
            F.count(F.lit(1)).alias("n_base"),
            F.min("start").alias("first_word"),
            F.max("start").alias("last_word"),
            F.collect_set("label").alias("base_set"),
        )
    )
    method = (
        resolved(found)
        .groupBy("uid")
        .agg(F.collect_set("label").alias("label_set"), (F.max("weight") / 100).alias("score"))
    )
    none = F.array().cast("array<string>")
    joined = rows.select("uid", "doc_id", "n_words").join(base, "uid", "left").join(method, "uid", "left")
    base_set, label_set = (F.coalesce(c, none) for c in ("base_set", "label_set"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, label_set)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
