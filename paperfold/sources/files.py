"""File inventory, media types, and delimited or plain text previews."""

from __future__ import annotations

import csv
import io
import mimetypes
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.sources import formats

OCTET_STREAM = "application/octet-stream"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path, length, modificationTime, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _stable_id(*parts: Column) -> Column:
    """An id that a retried task makes again, unlike a random one."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def document_inventory(
    files: DataFrame,
    batch_id: Column,
    schema_hint: Column | None = None,
    topic_hint: Column | None = None,
) -> DataFrame:
    """One document and one pending job per file (path, filename, content).

    Repeated content is accepted: the hash only reports "seen these bytes".
    """
    content = F.col("content")
    document_id = _stable_id(batch_id.cast("string"), F.col("path").cast("string"))
    return files.select(
        document_id.alias("document_id"),
        _stable_id(document_id, F.lit("extract")).alias("job_id"),
        batch_id.alias("batch_id"),
        F.when(F.coalesce("filename", F.lit("")) == "", "unnamed").otherwise(F.col("filename")).alias("filename"),
        F.octet_length(content).cast("bigint").alias("file_size"),
        F.sha2(content, 256).alias("file_hash"),
        (schema_hint if schema_hint is not None else F.lit(None).cast("string")).alias("default_schema_id"),
        (topic_hint if topic_hint is not None else F.array().cast("array<string>")).alias("default_topic_ids"),
        F.lit("pending").alias("job_status"),
        F.lit("extract").alias("job_kind"),
    )


def batch_table(inventory: DataFrame) -> DataFrame:
    """One row per upload batch: its hints and how many documents it has."""
    return inventory.groupBy("batch_id").agg(
        F.max("default_schema_id").alias("default_schema_id"),
        F.max("default_topic_ids").alias("default_topic_ids"),
        F.count(F.lit(1)).alias("documents"),
    )


def repeated_content(docs: DataFrame, doc_id: str = "document_id", file_hash: str = "file_hash") -> DataFrame:
    """Content seen more than once: copies and the first document holding it.

    Counted with map-side combine; the copies of one hash are never gathered.
    """
    return (
        docs.groupBy(file_hash)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(doc_id).alias("first_document_id"))
        .filter("copies > 1")
    )


def extension(filename: str = "filename") -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    name = F.regexp_extract(F.col(filename), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed table as a map literal: no join, whatever the data size."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def media_type(filename: str = "filename", stored: str = "mime_type") -> Column:
    """Own table by extension, then the general one, then the stored type."""
    general = mimetypes.MimeTypes()
    known = {ext: kind for ext, kind in general.types_map[True].items()}
    squeezed = "|".join(e[1:] for e in general.encodings_map)
    for short, long in general.suffix_map.items():
        inner = "." + long.split(".")[1]
        if inner in known:
            known.setdefault(short, known[inner])
    ext = extension(filename)
    inner_name = F.regexp_replace(F.lower(F.col(filename)), rf"\.({squeezed.lower()})$", "")
    inner = F.lower(F.regexp_extract(inner_name, r"[^.].*?(\.[^./]+)$", 1))
    usable = F.when((F.col(stored) != "") & (F.col(stored) != OCTET_STREAM), F.col(stored))
    return F.coalesce(
        _lookup(formats.MEDIA_TYPES, ext),
        _lookup(known, ext),
        _lookup(known, inner),
        usable,
        F.lit(OCTET_STREAM),
    )


def preview_kind(filename: str = "filename", mime: str = "mime_type") -> Column:
    """Which renderer a file needs: by extension first, else by media type."""
    bare = F.lower(F.trim(F.split_part(F.coalesce(F.col(mime), F.lit("")), F.lit(";"), F.lit(1))))
    by_mime = (
        F.when(bare == "application/pdf", "pdf")
        .when(bare.isin("text/html", "application/xhtml+xml"), "html")
        .when(bare.isin(*formats.BROWSER_IMAGES), "image")
        .when(bare.startswith("image/"), "elements")
        .when(bare.startswith("audio/"), "audio")
        .when(bare.startswith("video/"), "video")
        .when(bare.startswith("text/"), "text")
        .when(bare.isin("application/json", "application/xml", "application/x-ndjson"), "text")
        .otherwise("elements")
    )
    return F.coalesce(_lookup(formats.PREVIEW_KINDS, extension(filename)), by_mime)


def scan_delimited(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, line_breaks: bool = False
) -> DataFrame:
    """A whole delimited file or folder as a table; every column is text.

    With `line_breaks`, cells may hold them, but then a file is one task's work;
    without, large files are split.
    """
    return spark.read.csv(
        path, sep=sep, header=header, quote='"', escape='"', multiLine=line_breaks, encoding="UTF-8"
    )


def read_delimited(
    files: DataFrame, sep: str = ",", max_rows: int | None = None, max_columns: int | None = None
) -> DataFrame:
    """Rows of files (document_id, content text): document_id, row_no, cells, truncated, error.

    A quoted cell may hold the separator or a line break, so a file is parsed
    as one text. Blank rows go. Nothing is cut unless a limit is given, and
    `truncated` says whether it cut anything. A file that can't be parsed gives
    one row with its error and no cells; the others are not affected.
    """

    def rows_of(text: str):
        csv.field_size_limit(max(len(text), 1))  # a cell may be as long as its file
        rows, cut = [], False
        for row in csv.reader(io.StringIO(text), delimiter=sep):
            if not any(cell.strip() for cell in row):
                continue
            if max_rows is not None and len(rows) == max_rows:
                return rows, True
            cut = cut or (max_columns is not None and len(row) > max_columns)
            rows.append(row[:max_columns])
        return rows, cut

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["document_id"], batch["content"], strict=True):
                try:
                    rows, cut = rows_of((text or "").removeprefix("\ufeff"))
                except csv.Error as problem:
                    out.append((doc, None, None, False, str(problem)))
                else:
                    out += [(doc, i, cells, cut, None) for i, cells in enumerate(rows)]
            frame = pd.DataFrame(out, columns=["document_id", "row_no", "cells", "truncated", "error"])
            yield frame.astype({"row_no": "Int32"})

    kind = files.schema["document_id"].dataType.simpleString()
    schema = f"document_id {kind}, row_no int, cells array<string>, truncated boolean, error string"
    return files.select("document_id", "content").mapInPandas(parse, schema)


def clip_text(docs: DataFrame, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Display text of a document, and whether a given limit cut it. Bad bytes become U+FFFD."""
    if docs.schema[text].dataType.simpleString() == "binary":
        docs = docs.withColumn(text, F.expr(f"make_valid_utf8(CAST({text} AS STRING))"))
    if max_chars is None:
        return docs.withColumn("truncated", F.lit(False))
    return docs.withColumn("truncated", F.length(text) > max_chars).withColumn(
        text, F.substring(F.col(text), 1, max_chars)
    )
