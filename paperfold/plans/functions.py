"""The functions SQL users get, used from plain SQL."""

from __future__ import annotations

from paperfold.functions.sql_functions import register_sql_functions
from paperfold.plans.registry import query


@query(
    "sql_safe_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS number,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS INT) END AS whole, l_returnflag = 'A' AS flag,
    CAST(l_shipdate AS DATE) AS day, date_trunc('day', l_shipdate) AS at FROM lineitem""",
)
def sql_safe_functions(t):
    register_sql_functions(t.spark)
    return t.sql(
        """SELECT l_orderkey, l_linenumber, l_partkey,
             CAST(safe_number(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) AS DOUBLE) AS number,
             safe_integer(if(l_linenumber % 2 = 0, CAST(CAST(l_quantity AS INT) AS STRING), 'x')) AS whole,
             safe_boolean(if(l_returnflag = 'A', 'yes', 'no')) AS flag,
             safe_date(date_format(l_shipdate, 'd MMM yyyy')) AS day,
             CAST(safe_timestamp(date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')) AS TIMESTAMP_NTZ) AS at
           FROM {lineitem}""",
        lineitem=t.lineitem,
    )


@query(
    "sql_coerce_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS number,
    CAST(CAST(l_quantity AS INT) AS VARCHAR) AS whole,
    CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'R' THEN 'false' ELSE 'N' || l_linenumber END AS flag FROM lineitem""",
)
def sql_coerce_functions(t):
    register_sql_functions(t.spark)
    return t.sql(
        """SELECT l_orderkey, l_linenumber, l_partkey, coerce_number('USD ' || format_number(l_extendedprice, 2)) AS number,
             coerce_integer(format_number(l_quantity, 2)) AS whole,
             coerce_boolean(CASE l_returnflag WHEN 'A' THEN ' Paid' WHEN 'R' THEN 'off' ELSE 'N' || l_linenumber END) AS flag
           FROM {lineitem}""",
        lineitem=t.lineitem,
    )


@query(
    "sql_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def sql_cosine(t):
    register_sql_functions(t.spark)
    return t.sql(
        """SELECT a.vec_id, round(cosine(a.embedding, b.embedding), 6) AS score
           FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""",
        embeddings=t.embeddings,
    )


@query(
    "sql_embed",
    "SELECT doc_id, 384 AS size, 1.0::DOUBLE AS norm FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')",
)
def sql_embed(t):
    register_sql_functions(t.spark)
    return t.sql(
        """SELECT doc_id, size(v) AS size, round(sqrt(aggregate(v, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)), 5) AS norm
           FROM (SELECT doc_id, embed(text) AS v FROM {documents}) WHERE size(v) > 0""",
        documents=t.documents,
    )
