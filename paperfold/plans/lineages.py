"""Schema-lineage operators over one lineage per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.functions.text import normalize_type_sql
from paperfold.operators import lineage
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import query

_SCOPE = "CASE WHEN scope = 'row' THEN 'row' ELSE 'document' END"
_JOIN = "array_join({c}, ',')"


@query(
    "fields_by_scope",
    f"""WITH {fx.FIELDS} SELECT schema_id, version, {_SCOPE} AS scope, count(*) AS fields,
    string_agg(name, ',' ORDER BY pos) AS names FROM fields GROUP BY 1, 2, 3""",
)
def fields_by_scope(t):
    document, row = lineage.split_by_scope(fx.part_fields(t))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return document.unionByName(row).groupBy("schema_id", "version", "scope").agg(
        F.count(F.lit(1)).alias("fields"),
        F.array_join(F.transform(ordered, lambda e: e["name"]), ",").alias("names"),
    )


@query(
    "lineage_name_map",
    f"""WITH {fx.FIELDS} SELECT schema_id, name, arg_max("column", version * 100 + pos) AS "column"
    FROM fields GROUP BY 1, 2""",
)
def lineage_name_map(t):
    return lineage.lineage_name_map(fx.part_fields(t))


# Before the key migration: some fields have no key, some a malformed one.
_UNKEYED = """SELECT schema_id, version, pos, name, type, description, scope,
  CASE WHEN (schema_id + version + pos) % 3 = 0 THEN NULL WHEN (schema_id + pos) % 5 = 0 THEN 'bad key'
       ELSE "column" END AS "column" FROM fields"""
_MINTED = "'f_' || substr(sha256(CAST(schema_id AS VARCHAR) || '|' || name || '|0'), 1, 8)"


@query(
    "backfilled_keys",
    f"""WITH {fx.FIELDS}, u AS ({_UNKEYED}), v AS (
      SELECT *, CASE WHEN regexp_matches("column", '^f_[0-9a-f]{{8}}$') THEN "column" END AS own FROM u)
    SELECT schema_id, version, name, COALESCE(
      (SELECT arg_max(w.own, w.version * 100 + w.pos) FROM v w WHERE w.schema_id = v.schema_id AND w.name = v.name
        AND w.own IS NOT NULL AND w.version * 100 + w.pos <= v.version * 100 + v.pos), {_MINTED}) AS "column" FROM v""",
)
def backfilled_keys(t):
    unkeyed = t.sql(_UNKEYED.replace('"column"', "column").replace("FROM fields", "FROM {fields}"), fields=fx.part_fields(t))
    return lineage.backfill_keys(unkeyed).select("schema_id", "version", "name", "column")


# Edits of every lineage: the newest version's fields, some renamed with their
# key, some losing it, plus new fields and faulty requests.
_REQUESTS = """
SELECT p_partkey AS request_id, p_partkey AS schema_id, 0 AS pos,
  CASE p_size % 5 WHEN 0 THEN 'Amount' WHEN 1 THEN '' ELSE 'Net' END AS name,
  CASE p_size % 7 WHEN 0 THEN 'nonsense' WHEN 1 THEN NULL WHEN 2 THEN 'f_ffffffff'
    ELSE lower(printf('%s%08x', 'f_', p_partkey * 8 + 1)) END AS key FROM {part}
UNION ALL SELECT p_partkey, p_partkey, 1, CASE WHEN p_size % 6 = 0 THEN 'Net' ELSE 'Vendor' END, NULL FROM {part}
UNION ALL SELECT p_partkey, p_partkey, 2, 'Total', CASE WHEN p_size % 11 = 0 THEN
    lower(printf('%s%08x', 'f_', p_partkey * 8 + 1)) END FROM {part}
UNION ALL SELECT p_partkey, p_partkey, 3, 'Brand new', NULL FROM {part}"""


@query(
    "assigned_keys",
    f"""WITH RECURSIVE {fx.FIELDS}, req AS ({fx.plain(_REQUESTS)}),
    newest AS (SELECT schema_id, name, arg_max("column", version * 100 + pos) AS k FROM fields GROUP BY 1, 2),
    known AS (SELECT DISTINCT schema_id, "column" AS k FROM fields),
    flagged AS (SELECT r.*, CASE WHEN trim(name) = '' THEN 'empty name'
        WHEN EXISTS (SELECT 1 FROM req e WHERE e.request_id = r.request_id AND e.name = r.name AND e.pos < r.pos) THEN 'duplicate name'
        WHEN key IS NOT NULL AND NOT regexp_matches(key, '^f_[0-9a-f]{{8}}$') THEN 'malformed key'
        WHEN EXISTS (SELECT 1 FROM req e WHERE e.request_id = r.request_id AND e.key = r.key AND e.pos < r.pos) THEN 'key used twice'
        WHEN key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.schema_id = r.schema_id AND k.k = r.key) THEN 'unknown key'
      END AS problem FROM req r),
    err AS (SELECT request_id, arg_min(problem, pos) FILTER (WHERE problem IS NOT NULL) AS error FROM flagged GROUP BY 1),
    cand AS (SELECT f.request_id, f.schema_id, f.pos, f.name, f.key, n.k FROM flagged f LEFT JOIN newest n
        ON n.schema_id = f.schema_id AND n.name = f.name),
    done AS (SELECT c.*, CASE WHEN key IS NOT NULL THEN key
        WHEN k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cand e WHERE e.request_id = c.request_id AND e.key = c.k)
         AND NOT EXISTS (SELECT 1 FROM cand e WHERE e.request_id = c.request_id AND e.key IS NULL AND e.k = c.k AND e.pos < c.pos)
        THEN k ELSE {_MINTED} END AS resolved FROM cand c)
    SELECT d.request_id, d.pos, d.name, CASE WHEN error IS NULL THEN resolved END AS "column", error
    FROM done d JOIN err USING (request_id)""",
)
def assigned_keys(t):
    requests = fx.run(t, _REQUESTS).withColumnRenamed("key", "column")
    return lineage.assign_column_keys(requests, fx.part_fields(t)).drop("schema_id")


_IDENTITY = """SELECT schema_id, version, CASE schema_id % 4 WHEN 0 THEN 'Vendor' WHEN 1 THEN 'Net'
  WHEN 2 THEN 'Line Amount' ELSE 'Total' END AS a, 'Vendor' AS b FROM {versions}"""


@query(
    "identity_keys",
    f"""WITH {fx.FIELDS}, {fx.VERSIONS}, i AS ({fx.plain(_IDENTITY)}),
    x AS (SELECT i.*, fa."column" AS ka, fb."column" AS kb,
      CASE WHEN fa."column" IS NULL THEN 'unknown field ' || a WHEN fa.scope = 'row' THEN 'row-scoped field ' || a
           WHEN fb."column" IS NULL THEN 'unknown field ' || b END AS reason
      FROM i LEFT JOIN fields fa ON fa.schema_id = i.schema_id AND fa.version = i.version AND fa.name = i.a
             LEFT JOIN fields fb ON fb.schema_id = i.schema_id AND fb.version = i.version AND fb.name = i.b)
    SELECT schema_id, version, CASE WHEN reason IS NULL THEN ka || ',' || kb END AS identity_keys, reason FROM x""",
)
def identity_keys(t):
    named = t.sql(_IDENTITY, versions=fx.part_versions(t)).withColumn("identity_names", F.array("a", "b"))
    return lineage.identity_keys(named, fx.part_fields(t)).withColumn("identity_keys", F.array_join("identity_keys", ","))


@query(
    "identity_names",
    f"""WITH {fx.FIELDS}, {fx.VERSIONS} SELECT v.schema_id, v.version,
    COALESCE(a.name, printf('f_%08x', v.schema_id * 8 + 4)) || ',' || COALESCE(b.name, printf('f_%08x', v.schema_id * 8 + 1)) AS identity_names
    FROM versions v
    LEFT JOIN fields a ON a.schema_id = v.schema_id AND a.version = v.version AND a."column" = printf('f_%08x', v.schema_id * 8 + 4)
    LEFT JOIN fields b ON b.schema_id = v.schema_id AND b.version = v.version AND b."column" = printf('f_%08x', v.schema_id * 8 + 1)""",
)
def identity_names(t):
    keyed = fx.part_versions(t).withColumn(
        "identity_keys", F.expr("array(printf('f_%08x', schema_id * 8 + 4), printf('f_%08x', schema_id * 8 + 1))")
    )
    named = lineage.identity_names(keyed, fx.part_fields(t))
    return named.withColumn("identity_names", F.array_join("identity_names", ","))


@query(
    "field_specs",
    f"""WITH {fx.FIELDS}, {fx.VERSIONS}, n AS (SELECT schema_id, count(*) AS total FROM versions GROUP BY 1),
    k AS (SELECT schema_id, "column" AS c, min(version * 100 + pos) AS first_at, count(DISTINCT name) AS names,
        arg_max(name, version * 100 + pos) AS name, arg_max(type, version * 100 + pos) AS type,
        arg_max({_SCOPE}, version * 100 + pos) AS scope FROM fields GROUP BY 1, 2),
    b AS (SELECT schema_id, "column" AS c, name, string_agg(CAST(version AS VARCHAR), '+' ORDER BY version) AS vs,
        max(version) AS newest FROM fields GROUP BY 1, 2, 3),
    br AS (SELECT schema_id, c, string_agg(name || ':' || vs, ';' ORDER BY newest DESC) AS branches FROM b GROUP BY 1, 2),
    o AS (SELECT schema_id, name, count(DISTINCT "column") AS owners, count(DISTINCT version) AS declared FROM fields GROUP BY 1, 2)
    SELECT k.schema_id, k.c AS "column", CAST(row_number() OVER (PARTITION BY k.schema_id ORDER BY first_at) AS INT) AS position,
      k.name, k.type, k.scope, branches, (names = 1 AND owners = 1 AND declared = total) AS plain
    FROM k JOIN br USING (schema_id, c) JOIN o ON o.schema_id = k.schema_id AND o.name = k.name JOIN n ON n.schema_id = k.schema_id""",
)
def field_specs(t):
    from pyspark.sql.window import Window as W

    specs = lineage.field_specs(fx.part_fields(t), fx.part_versions(t))
    branches = F.transform("branches", lambda b: F.concat(b["name"], F.lit(":"), F.array_join(b["versions"].cast("array<string>"), "+")))
    return specs.select(
        "schema_id",
        "column",
        F.row_number().over(W.partitionBy("schema_id").orderBy("first_at")).alias("position"),
        "name",
        "type",
        "scope",
        F.array_join(branches, ";").alias("branches"),
        "plain",
    )


@query(
    "plain_fields",
    f"""WITH {fx.FIELDS}, {fx.VERSIONS}
    SELECT f.schema_id, f."column" AS "column", (count(DISTINCT f.name) = 1
      AND (SELECT count(DISTINCT g."column") FROM fields g WHERE g.schema_id = f.schema_id AND g.name = max(f.name)) = 1
      AND (SELECT count(DISTINCT g.version) FROM fields g WHERE g.schema_id = f.schema_id AND g.name = max(f.name))
        = (SELECT count(*) FROM versions v WHERE v.schema_id = f.schema_id)) AS plain
    FROM fields f GROUP BY 1, 2""",
)
def plain_fields(t):
    return lineage.plain_is_safe(fx.part_fields(t), fx.part_versions(t))


@query(
    "names_at_version",
    f"""WITH {fx.FIELDS}, {fx.VERSIONS} SELECT v.schema_id, v.version, k."column" AS "column", f.name
    FROM versions v JOIN (SELECT DISTINCT schema_id, "column" FROM fields) k ON k.schema_id = v.schema_id
    LEFT JOIN fields f ON f.schema_id = v.schema_id AND f.version = v.version AND f."column" = k."column\"""",
)
def names_at_version(t):
    fields = fx.part_fields(t)
    wanted = fx.part_versions(t).join(fields.select("schema_id", "column").distinct().hint("merge"), "schema_id")
    return lineage.name_at(fields, wanted).select("schema_id", "version", "column", "name")


_DIFF = f"""WITH {fx.FIELDS}, {fx.VERSIONS},
    later AS (SELECT * FROM versions WHERE version > 1),
    p AS (SELECT l.schema_id, l.version, f."column" AS c, f.name, f.type, {_SCOPE} AS scope FROM later l
          JOIN fields f ON f.schema_id = l.schema_id AND f.version = l.version - 1),
    n AS (SELECT l.schema_id, l.version, f."column" AS c, f.name, f.type, {_SCOPE} AS scope FROM later l
          JOIN fields f ON f.schema_id = l.schema_id AND f.version = l.version),
    d AS (SELECT COALESCE(p.schema_id, n.schema_id) AS schema_id, COALESCE(p.version, n.version) AS version,
      p.c IS NULL AS a, n.c IS NULL AS r, p.type <> n.type AS t, p.scope <> n.scope AS s, p.name <> n.name AS m
      FROM p FULL JOIN n ON p.schema_id = n.schema_id AND p.version = n.version AND p.c = n.c),
    q AS (SELECT schema_id, version, count(*) FILTER (WHERE a) AS added, count(*) FILTER (WHERE r) AS removed,
      count(*) FILTER (WHERE t) AS retyped, count(*) FILTER (WHERE s) AS rescoped, count(*) FILTER (WHERE m) AS renamed
      FROM d GROUP BY 1, 2)"""


@query(
    "schema_changes",
    f"{_DIFF} SELECT *, removed + retyped + rescoped > 0 AS is_breaking FROM q",
)
def schema_changes(t):
    return lineage.schema_diff(fx.part_fields(t), fx.part_versions(t)).drop("lost_rename")


@query(
    "lost_rename_warnings",
    f"{_DIFF} SELECT schema_id, version FROM q WHERE removed > 0 AND added > 0",
)
def lost_rename_warnings(t):
    return lineage.schema_diff(fx.part_fields(t), fx.part_versions(t)).filter("lost_rename").select("schema_id", "version")


_VIEW = """'view_' || CASE WHEN regexp_matches({n}, '^[0-9]') OR {n} = '' THEN 'f_' ELSE '' END
  || lower(regexp_replace({n}, '[^a-zA-Z0-9_]', '_', 'g'))"""


@query("view_names", f"SELECT o_orderkey, {_VIEW.replace('{n}', 'o_orderpriority')} AS view_name FROM orders")
def view_names(t):
    return t.orders.select("o_orderkey", lineage.view_name("o_orderpriority").alias("view_name"))


@query(
    "view_name_collisions",
    f"""SELECT {_VIEW.replace('{n}', 'p_name')} AS view_name, count(*) AS claims, arg_min(p_name, p_partkey) AS kept_name,
    min(p_partkey) AS kept_schema_id FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def view_name_collisions(t):
    return lineage.view_name_collisions(fx.part_schemas(t))


@query(
    "stale_views",
    # A view is stale where the fields of its newest version changed after it was built.
    f"""WITH {fx.VERSIONS} SELECT p_partkey AS schema_id FROM part WHERE p_partkey % 3 >= 1""",
)
def stale_views(t):
    fields, versions, schemas = fx.part_fields(t), fx.part_versions(t), fx.part_schemas(t)
    first = F.col("version") == 1
    built = lineage.spec_fingerprint(lineage.field_specs(fields.filter(first), versions.filter(first)), schemas)
    wanted = lineage.spec_fingerprint(lineage.field_specs(fields, versions), schemas)
    return lineage.stale_views(built, wanted).select("schema_id")


@query(
    "schema_listing",
    f"""WITH {fx.VERSIONS} SELECT p_partkey AS schema_id, p_name AS name, max(version) AS current_version,
    (SELECT count(*) FROM orders WHERE o_custkey = p_partkey) AS document_count
    FROM part JOIN versions ON schema_id = p_partkey GROUP BY 1, 2""",
)
def schema_listing(t):
    documents = t.orders.selectExpr("o_orderkey AS document_id", "o_custkey AS schema_id")
    return lineage.schema_listing(fx.part_schemas(t), fx.part_versions(t), documents)


@query(
    "normalized_types",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 8 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'integer'
    WHEN 3 THEN 'boolean' WHEN 4 THEN 'date' WHEN 5 THEN 'number' ELSE 'string' END AS type FROM lineitem""",
)
def normalized_types(t):
    raw = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "element_at(array(' VarChar', 'double', 'INT ', 'bool', 'Date', 'Decimal', 'list', ''), CAST(l_partkey % 8 + 1 AS INT)) AS raw",
    )
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", F.expr(normalize_type_sql("raw")).alias("type"))
