"""Typed views: records flattened into columns that survive renames.

records: id, document_id, schema_id, schema_version_id, row_index,
         data MAP<STRING,STRING>, is_duplicate_of, created_at
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.functions.casts import safe_cast_sql
from paperfold.operators.lineage import BASE_COLUMNS, KEY_PATTERN, FieldSpec

RECORD_COLUMNS = BASE_COLUMNS[:-1]


def _literal(value) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def field_column(spec: FieldSpec) -> Column:
    """The typed expression of one field.

    A plain field reads its name. Any other reads the name its row's own version
    used; coalescing over names would surface another field's value wherever a
    later version reuses an old name and stores NULL. One cast wraps the choice.
    """
    if not re.fullmatch(KEY_PATTERN, spec.column):
        raise ValueError(f"not a column key: {spec.column!r}")
    if spec.plain:
        read = f"try_element_at(data, {_literal(spec.branches[0][0])})"
    else:
        arms = " ".join(
            f"WHEN schema_version_id IN ({', '.join(_literal(v) for v in versions)})"
            f" THEN try_element_at(data, {_literal(name)})"
            for name, versions in spec.branches
        )
        read = f"CASE {arms} END"
    return F.expr(safe_cast_sql(f"({read})", spec.type)).alias(spec.column)


def typed_view(records: DataFrame, specs: list[FieldSpec], topics: DataFrame | None = None) -> DataFrame:
    """Bookkeeping columns, then one typed column per field of the lineage."""
    base = with_topics(records, topics) if topics is not None else records
    kept = BASE_COLUMNS if topics is not None else RECORD_COLUMNS
    return base.select(*kept, *[field_column(s) for s in specs])


def with_topics(records: DataFrame, document_topics: DataFrame) -> DataFrame:
    """Adds sorted distinct topic_ids; a document without topics gets an empty array.

    Aggregated before the join: the right side is unique, so Spark drops the
    join from any query that does not read topic_ids.
    """
    per_document = document_topics.groupBy("document_id").agg(
        F.sort_array(F.collect_set("topic_id")).alias("topic_ids")
    )
    return records.join(per_document, "document_id", "left").withColumn(
        "topic_ids", F.coalesce("topic_ids", F.array().cast("array<string>"))
    )


def rebuild_views(
    spark: SparkSession,
    lineages: dict[str, tuple[DataFrame, list[FieldSpec]]],
    topics: DataFrame,
) -> dict[str, str]:
    """(Re)creates a temp view per lineage; one failing lineage does not stop the rest."""
    outcome = {}
    for name, (records, specs) in lineages.items():
        try:
            typed_view(records, specs, topics).createOrReplaceTempView(name)
            outcome[name] = "built"
        except Exception as exc:  # reported per lineage
            outcome[name] = f"failed: {exc}"
    return outcome


def header_view(view: DataFrame, columns: list[str]) -> DataFrame:
    """One row per document with its document-level columns (they repeat on its rows)."""
    return view.groupBy("document_id").agg(*[F.max(c).alias(c) for c in columns])


def content_stamp(records: DataFrame) -> str:
    """What a view says of its records: their number and a sum of their digests, in any order."""
    row = F.xxhash64("id", "schema_version_id", "document_id", "row_index", F.array_sort(F.map_entries("data")), F.col("created_at").cast("string"))
    told = records.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digests")).first()
    return f"{told.n}:{told.digests}"


def files_stamp(*tables: DataFrame) -> str:
    """The same for records that come straight from files: which files, and when they were written."""
    told = []
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for name in sorted(table.inputFiles()):
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            status = place.getFileSystem(conf).getFileStatus(place)
            told.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


class StoredViews:
    """Typed views kept as tables, so that browsing reads columns instead of maps.

    A view is stored under the digest of its field specs and of its records'
    stamp: `content_stamp`, or one the caller has at less cost. While both stay the
    same it is read as it is; a changed record gives another stamp and so a new
    view. Rows and document-level columns are apart, so a header total never
    reads rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._stamps: dict[str, str] = {}

    def _path(self, name: str, specs: list[FieldSpec], stamp: str) -> str:
        digest = hashlib.sha256(f"{stamp}|{specs!r}".encode()).hexdigest()[:32]
        return f"{self.folder}/{name}/{digest}"

    def _complete(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def refresh(self, name: str, records: DataFrame, specs: list[FieldSpec], header: list[str], stamp: str | None = None) -> str:
        """Stores a view unless it is there; "kept" or "built"."""
        stamp = content_stamp(records) if stamp is None else stamp
        path = self._path(name, specs, stamp)
        outcome = "kept"
        if not self._complete(f"{path}/header"):
            typed_view(records, specs).write.mode("overwrite").parquet(f"{path}/rows")
            rows = self.spark.read.parquet(f"{path}/rows")
            header_view(rows, header).write.mode("overwrite").parquet(f"{path}/header")
            outcome = "built"
        self._stamps[name] = stamp
        return outcome

    def refresh_all(self, lineages: dict[str, tuple[DataFrame, list[FieldSpec], list[str]]], stamp: str | None = None) -> dict[str, str]:
        """`refresh` for many lineages; one that fails is reported and stops no other."""
        outcome = {}
        for name, (records, specs, header) in lineages.items():
            try:
                outcome[name] = self.refresh(name, records, specs, header, stamp)
            except Exception as exc:  # reported per lineage
                outcome[name] = f"failed: {exc}"
        return outcome

    def _stored(self, name: str, specs: list[FieldSpec], stamp: str | None) -> str:
        """The folder of the view as last refreshed here, or as of a stamp."""
        if stamp is None and name not in self._stamps:
            raise ValueError(f"refresh {name} first, or give the stamp of its records")
        return self._path(name, specs, self._stamps[name] if stamp is None else stamp)

    def rows(self, name: str, specs: list[FieldSpec], stamp: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._stored(name, specs, stamp)}/rows")

    def header(self, name: str, specs: list[FieldSpec], stamp: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._stored(name, specs, stamp)}/header")


def typed_cells(records: DataFrame, fields: DataFrame) -> DataFrame:
    """The long form of the typed view over ALL lineages at once.

    One row per declared (record, column): value text under the row's own
    version, with NULL for a JSON null. Fields may be as many as records, and the
    size of either side says little about its maps and names: they meet by shuffle.
    """
    by_version = fields.select(
        "schema_id", F.col("version").alias("schema_version_id"), "column", "name", "type"
    ).hint("merge")
    return records.join(by_version, ["schema_id", "schema_version_id"]).select(
        *RECORD_COLUMNS, "schema_id", "column", "type", F.try_element_at("data", F.col("name")).alias("value")
    )
