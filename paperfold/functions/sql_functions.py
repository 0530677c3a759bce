"""The functions offered to SQL users; register them in every child session.

They are SQL-defined, so Spark inlines them and still optimises across them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperfold.functions import casts, coerce, vectors


def _definitions() -> dict[str, tuple[str, str, str]]:
    text = "x STRING"
    pair = "a ARRAY<FLOAT>, b ARRAY<FLOAT>"
    return {
        "safe_number": (text, "DECIMAL(38,10)", casts.safe_number_sql("x")),
        "safe_integer": (text, "INT", casts.safe_integer_sql("x")),
        "safe_boolean": (text, "BOOLEAN", casts.safe_boolean_sql("x")),
        "safe_date": (text, "DATE", casts.safe_date_sql("x")),
        "safe_timestamp": (text, "TIMESTAMP", casts.safe_timestamp_sql("x")),
        "coerce_number": (text, "STRING", coerce.coerce_number_sql("x")),
        "coerce_integer": (text, "STRING", coerce.coerce_integer_sql("x")),
        "coerce_boolean": (text, "STRING", coerce.coerce_boolean_sql("x")),
        "cosine": (pair, "DOUBLE", vectors.cosine_sql("a", "b")),
        "embed": (text, "ARRAY<FLOAT>", vectors.embed_sql("x")),
    }


def register_sql_functions(spark: SparkSession) -> None:
    from paperfold.sources.elements import HtmlElements, HtmlTableRows

    for name, (parameters, result, body) in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("html_elements", HtmlElements)
    spark.udtf.register("html_table_rows", HtmlTableRows)
