"""Schema lineages: column keys, field specs, diffs and view names, in bulk.

`fields` is one row per declared field of one version:
  schema_id, version, pos, name, type, description, required, column, scope
`versions` is one row per version: schema_id, version.
A column key outlives renames; records are stored under field names.

Fields are often made of smaller rows (a list in a version), so file sizes say little
about them: joins with tables of fields or keys ask for a shuffle (`hint("merge")`), else
Spark may send all of them through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperfold.functions.ordering import along, running_within
from paperfold.functions.text import view_name_sql

KEY_PATTERN = "^f_[0-9a-f]{8}$"
BASE_COLUMNS = (
    "id", "document_id", "row_index", "schema_version_id", "is_duplicate_of", "created_at", "topic_ids",
)
# Minting attempts per name. A name for which all of them are taken ends the job;
# it never goes on without a key.
_MINT_SALTS = 8


def valid_key(column: str = "column") -> Column:
    return F.coalesce(F.col(column).rlike(KEY_PATTERN), F.lit(False))


def field_scope(column: str = "scope") -> Column:
    """Exactly "row" is row scope; anything else, missing included, is document."""
    return F.when(F.col(column) == "row", "row").otherwise("document")


def split_by_scope(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    scoped = fields.withColumn("scope", field_scope())
    return scoped.filter("scope = 'document'"), scoped.filter("scope = 'row'")


def lineage_name_map(fields: DataFrame) -> DataFrame:
    """(schema_id, name) -> newest key ever given to that name in the lineage."""
    return (
        fields.filter(valid_key())
        .groupBy("schema_id", "name")
        .agg(F.max_by("column", F.struct("version", "pos")).alias("column"))
    )


def mint_keys(names: DataFrame, taken: DataFrame) -> DataFrame:
    """A new key for each (schema_id, name), unlike any in `taken`.

    Keys are hashes, so a retried task mints the same ones. A hash already in
    the lineage, or claimed by another name, gives way to the next salt.
    """
    hashed = F.sha2(F.concat_ws("|", "schema_id", "name", "salt"), 256)
    tries = (
        names.select("schema_id", "name")
        .distinct()
        .withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(_MINT_SALTS)])))
        .withColumn("column", F.concat(F.lit("f_"), F.substring(hashed, 1, 8)))
        .join(taken.select("schema_id", "column").distinct().hint("merge"), ["schema_id", "column"], "left_anti")
    )
    owned = (
        tries.groupBy("schema_id", "column")
        .agg(F.min(F.struct("salt", "name")).alias("first"))
        .select("schema_id", "column", "first.salt", "first.name")
    )
    minted = owned.groupBy("schema_id", "name").agg(F.min_by("column", "salt").alias("minted"))
    none_free = F.raise_error(F.concat(F.lit("no free column key for "), "name"))
    return (
        names.select("schema_id", "name")
        .distinct()
        .join(minted.hint("merge"), ["schema_id", "name"], "left")
        .withColumn("minted", F.coalesce("minted", none_free))
    )


def backfill_keys(fields: DataFrame) -> DataFrame:
    """Gives every field of every version a key; running it again changes nothing.

    A field keeps a valid key, else takes the last key its name carried anywhere
    earlier in the lineage, else one minted for the name.
    """
    own = F.when(valid_key(), F.struct("version", "pos", "column"))
    keys = ["schema_id", "name"]

    def carry(rows: DataFrame, cut: Column | None) -> DataFrame:
        return running_within(rows, keys, ["version", "pos"], maxima={"__carried": own}, coarse=cut)

    carried = along(fields, keys, F.floor(F.col("version") / 256), carry)
    minted = mint_keys(
        carried.filter("__carried IS NULL"), fields.filter(valid_key())
    )
    return (
        carried.join(minted.hint("merge"), ["schema_id", "name"], "left")
        .withColumn("column", F.coalesce(F.col("__carried.column"), F.col("minted")))
        .drop("__carried", "minted")
    )


def assign_column_keys(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """Keys for the field lists of schema edits (request_id, schema_id, pos, name, column).

    A supplied key is honoured even when the name changed: it is the rename
    signal. Without one, a name reclaims its key unless this request already
    uses it (first by position wins), else a key is minted. One bad field fails
    its request: every row of it carries the error of its first bad field. A
    request is one edit form, so windows over it stay small.
    """
    known = fields.filter(valid_key()).select("schema_id", "column").distinct()
    lineages = fields.select("schema_id").distinct().withColumn("__lineage", F.lit(True))
    by_name = W.partitionBy("request_id", "__name")
    by_key = W.partitionBy("request_id", "__supplied")
    whole = W.partitionBy("request_id")
    asked = (
        requests.withColumn("__name", F.trim(F.coalesce("name", F.lit(""))))
        .join(lineages.hint("merge"), "schema_id", "left")
        # A new lineage has nothing to preserve, so supplied keys are ignored.
        .withColumn("__supplied", F.when(F.col("__lineage"), F.col("column")))
        .join(
            known.select("schema_id", F.col("column").alias("__supplied"), F.lit(True).alias("__known")).hint("merge"),
            ["schema_id", "__supplied"],
            "left",
        )
    )
    supplied = F.col("__supplied").isNotNull()
    problem = (
        F.when(F.col("__name") == "", "empty name")
        .when(F.min("pos").over(by_name) < F.col("pos"), "duplicate name")
        .when(supplied & ~valid_key("__supplied"), "malformed key")
        .when(supplied & (F.min("pos").over(by_key) < F.col("pos")), "key used twice")
        .when(supplied & F.col("__known").isNull(), "unknown key")
    )
    checked = asked.withColumn("__problem", problem).withColumn(
        "error", F.min_by("__problem", F.when(F.col("__problem").isNotNull(), F.col("pos"))).over(whole)
    )
    used = (
        checked.filter(supplied)
        .select("request_id", F.col("__supplied").alias("__candidate"), F.lit(True).alias("__used"))
        .distinct()
    )
    names = lineage_name_map(fields).select(
        "schema_id", F.col("name").alias("__name"), F.col("column").alias("__candidate")
    )
    rivals = W.partitionBy("request_id", "__candidate", supplied).orderBy("pos")
    reclaimed = (
        checked.join(names.hint("merge"), ["schema_id", "__name"], "left")
        .join(used.hint("merge"), ["request_id", "__candidate"], "left")
        .withColumn("__turn", F.row_number().over(rivals))
        .withColumn(
            "__key",
            F.when(supplied, F.col("__supplied")).when(
                F.col("__used").isNull() & (F.col("__turn") == 1), F.col("__candidate")
            ),
        )
    )
    minted = mint_keys(
        reclaimed.filter(F.col("__key").isNull() & F.col("error").isNull()).select(
            "schema_id", F.col("__name").alias("name")
        ),
        known,
    ).withColumnRenamed("name", "__name")
    return reclaimed.join(minted.hint("merge"), ["schema_id", "__name"], "left").select(
        "request_id",
        "schema_id",
        "pos",
        F.col("__name").alias("name"),
        F.when(F.col("error").isNull(), F.coalesce("__key", "minted")).alias("column"),
        "error",
    )


def identity_keys(versions: DataFrame, fields: DataFrame, strict: bool = True) -> DataFrame:
    """`versions.identity_names` as keys, order kept.

    strict (create or edit): an unknown or row-scoped name refuses the list and
    says why. Otherwise (backfill) unknown names drop out and are reported.
    """
    declared = fields.select("schema_id", "version", "name", "column", field_scope().alias("scope"))
    entries = versions.select("schema_id", "version", F.posexplode("identity_names").alias("pos", "name"))
    is_key = valid_key("name") if not strict else F.lit(False)
    looked_up = (
        entries.join(declared.hint("merge"), ["schema_id", "version", "name"], "left")
        .withColumn("key", F.when(is_key, F.col("name")).otherwise(F.col("column")))
        .withColumn(
            "reason",
            F.when(F.col("key").isNull(), F.concat(F.lit("unknown field "), "name")).when(
                F.lit(strict) & (F.col("scope") == "row"), F.concat(F.lit("row-scoped field "), "name")
            ),
        )
    )
    # A list lives in one version row, so gathering it again is bounded.
    ordered = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("pos", "key"))))
    grouped = looked_up.groupBy("schema_id", "version").agg(
        F.transform(ordered, lambda e: e["key"]).alias("identity_keys"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("reason"),
    )
    if strict:
        grouped = grouped.withColumn(
            "identity_keys", F.when(F.col("reason").isNull(), F.col("identity_keys"))
        )
    return grouped


def identity_names(versions: DataFrame, fields: DataFrame) -> DataFrame:
    """`versions.identity_keys` as names for display; an unknown key shows itself."""
    declared = fields.select("schema_id", "version", F.col("column").alias("key"), "name")
    entries = versions.select("schema_id", "version", F.posexplode("identity_keys").alias("pos", "key"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "key").alias("label"))))
    return (
        entries.join(declared.hint("merge"), ["schema_id", "version", "key"], "left")
        .groupBy("schema_id", "version")
        .agg(F.transform(ordered, lambda e: e["label"]).alias("identity_names"))
    )


def field_names(fields: DataFrame) -> DataFrame:
    """Every (schema_id, column, name) with the versions using it, long form."""
    return (
        fields.filter(valid_key())
        .groupBy("schema_id", "column", "name")
        .agg(
            F.array_sort(F.collect_set("version")).alias("versions"),
            F.max("version").alias("newest"),
        )
    )


def plain_is_safe(fields: DataFrame, versions: DataFrame) -> DataFrame:
    """(schema_id, column, plain): may the value be read without a version test?

    Only when the key ever had one name, that name had one key, and every
    version declares it. Dropping any clause leaks one field into another.
    """
    return field_specs(fields, versions).select("schema_id", "column", "plain")


def malformed_keys(fields: DataFrame) -> DataFrame:
    """Lineages that cannot be projected, with the first field to blame."""
    message = F.concat(
        F.lit("field '"), "name", F.lit("' carries no usable column key; run backfill_keys on its lineage")
    )
    return (
        fields.filter(~valid_key())
        .groupBy("schema_id")
        .agg(F.min_by(message, F.struct("version", "pos")).alias("error"))
    )


def field_specs(fields: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per column of a lineage, for lineages without malformed keys.

    first_at: first declaration, the column order; name, type, description and
    scope of the newest declaration; branches: (name, versions), newest name
    first; plain: see `plain_is_safe`. `fields` is read once: it shrinks to one
    row per (column, name), and the rest works on those.
    """
    at = F.struct("version", "pos")
    newest = F.struct(
        "name",
        F.coalesce("type", F.lit("string")).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"),
        field_scope().alias("scope"),
    )
    spellings = fields.groupBy("schema_id", "column", "name").agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.max_by(newest, at).alias("spec"),
        F.array_sort(F.collect_set("version")).alias("versions"),
    )
    marked = spellings.withColumns(
        {
            "__owners": F.count(F.lit(1)).over(W.partitionBy("schema_id", "name")),
            "__broken": F.max((~valid_key()).cast("int")).over(W.partitionBy("schema_id")),
        }
    )
    branch = F.struct((-F.col("last_at.version")).alias("rank"), "name", "versions")
    columns = marked.filter("__broken = 0").groupBy("schema_id", "column").agg(
        F.min("first_at").alias("first_at"),
        F.max_by("spec", "last_at").alias("spec"),
        F.array_sort(F.collect_list(branch)).alias("__branches"),
        F.max("__owners").alias("__owners"),
    )
    total = versions.groupBy("schema_id").agg(F.countDistinct("version").alias("__total"))
    # With one name per key and one key per name, the branch holds every
    # version that declares the name.
    plain = (
        (F.size("__branches") == 1)
        & (F.col("__owners") == 1)
        & (F.size(F.col("__branches")[0]["versions"]) == F.col("__total"))
    )
    return columns.join(total.hint("merge"), "schema_id").select(
        "schema_id",
        "column",
        "first_at",
        "spec.*",
        F.transform("__branches", lambda b: F.struct(b["name"].alias("name"), b["versions"].alias("versions"))).alias("branches"),
        plain.alias("plain"),
    )


def name_at(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """The JSON key of (schema_id, column) at a version; NULL where undeclared."""
    declared = fields.filter(valid_key()).select("schema_id", "column", "version", "name")
    return wanted.join(declared.hint("merge"), ["schema_id", "column", "version"], "left")


def schema_diff(fields: DataFrame, versions: DataFrame) -> DataFrame:
    """What each version changes against the one before it.

    Breaking: a key gone, retyped or rescoped. A rename or an addition is not.
    lost_rename: keys dropped while new ones appear, likely a rename that did
    not send its key along.
    """
    later = versions.filter("version > 1").select("schema_id", "version")
    side = ["name", "type", field_scope().alias("scope")]
    valid = fields.filter(valid_key())
    new = valid.select("schema_id", "version", "column", F.struct(*side).alias("new"))
    old = valid.select(
        "schema_id", (F.col("version") + 1).alias("version"), "column", F.struct(*side).alias("old")
    )
    pairs = new.join(old, ["schema_id", "version", "column"], "full").withColumns(
        {
            "added": F.col("old").isNull(),
            "removed": F.col("new").isNull(),
            "retyped": F.col("old.type") != F.col("new.type"),
            "rescoped": F.col("old.scope") != F.col("new.scope"),
            "renamed": F.col("old.name") != F.col("new.name"),
        }
    )
    kinds = ("added", "removed", "retyped", "rescoped", "renamed")
    counts = pairs.groupBy("schema_id", "version").agg(*[F.count_if(k).alias(k) for k in kinds])
    return (
        later.join(counts, ["schema_id", "version"], "left")
        .fillna(0, list(kinds))
        .withColumn("is_breaking", (F.col("removed") + F.col("retyped") + F.col("rescoped")) > 0)
        .withColumn("lost_rename", (F.col("removed") > 0) & (F.col("added") > 0))
    )


def view_name(name: str = "name") -> Column:
    return F.expr(view_name_sql(name))


def view_name_collisions(schemas: DataFrame) -> DataFrame:
    """View names claimed by several schemas; the earliest (by id) keeps it."""
    return (
        schemas.withColumn("view_name", view_name())
        .groupBy("view_name")
        .agg(
            F.count(F.lit(1)).alias("claims"),
            F.min_by("name", "schema_id").alias("kept_name"),
            F.min("schema_id").alias("kept_schema_id"),
        )
        .filter("claims > 1")
    )


def spec_fingerprint(specs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Digest of everything a generated view depends on, per lineage.

    Covers branches, so a rename that keeps the column set is noticed too.
    """
    ordered = F.array_sort(F.collect_list(F.struct("first_at", "column", "type", "plain", "branches")))
    body = specs.groupBy("schema_id").agg(ordered.alias("columns"))
    digest = F.sha2(
        F.to_json(
            F.struct(
                "view_name",
                "schema_id",
                F.array(*[F.lit(c) for c in BASE_COLUMNS]).alias("base"),
                "columns",
            )
        ),
        256,
    )
    return (
        schemas.withColumn("view_name", view_name())
        .join(body, "schema_id")
        .select("schema_id", "view_name", digest.alias("fingerprint"))
    )


def stale_views(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lineages whose stored view is missing or was built from another spec."""
    return wanted.join(stored.select("view_name", "fingerprint"), ["view_name", "fingerprint"], "left_anti")


def schema_listing(schemas: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Schemas with their current version and how many documents use them."""
    current = versions.groupBy("schema_id").agg(F.max("version").alias("current_version"))
    used = documents.groupBy("schema_id").agg(F.count(F.lit(1)).alias("document_count"))
    return (
        schemas.join(current, "schema_id", "left")
        .join(used, "schema_id", "left")
        .fillna(0, ["document_count"])
        .orderBy("name", "schema_id")
    )


@dataclass(frozen=True)
class FieldSpec:
    """One column of one lineage, as the driver needs it to build a view."""

    column: str
    name: str
    type: str
    plain: bool
    scope: str = "document"
    description: str = ""
    branches: tuple = field(default_factory=tuple)

    def name_at(self, version) -> str | None:
        return next((name for name, versions in self.branches if version in versions), None)


def lineage_specs(fields: DataFrame, versions: DataFrame, schema_id) -> list[FieldSpec]:
    """The specs of ONE lineage on the driver: as many rows as it has columns."""
    own = F.col("schema_id") == F.lit(schema_id)
    broken = malformed_keys(fields.filter(own)).first()
    if broken:
        raise ValueError(broken["error"])
    rows = field_specs(fields.filter(own), versions.filter(own)).orderBy("first_at").collect()
    return [
        FieldSpec(
            column=r["column"],
            name=r["name"],
            type=r["type"],
            plain=r["plain"],
            scope=r["scope"],
            description=r["description"],
            branches=tuple((b["name"], tuple(b["versions"])) for b in r["branches"]),
        )
        for r in rows
    ]
