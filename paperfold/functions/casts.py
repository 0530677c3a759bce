"""Casts that turn a bad cell into NULL for that cell only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six declared field types and the Spark type of each.
FIELD_TYPES = {
    "string": "STRING",
    "number": "DECIMAL(38,10)",
    "integer": "INT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "datetime": "TIMESTAMP",
}

# Layout guarded by a pattern: without the guard '2026' would read as a date.
# Slash dates are absent on purpose; their day/month order is unknowable.
_DATE_LAYOUTS = (
    (r"^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"),
    (r"^\\d{8}$", "yyyyMMdd"),
    (r"^\\d{1,2} [A-Za-z]{3} \\d{4}$", "d MMM yyyy"),
    (r"^\\d{1,2} [A-Za-z]{4,9} \\d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \\d{1,2}, \\d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \\d{1,2}, \\d{4}$", "MMMM d, yyyy"),
)
_ISO_INSTANT = r"^\\d{4}-\\d{2}-\\d{2}([ T]\\d{2}:\\d{2}(:\\d{2}([.]\\d{1,6})?)?(Z|[+-]\\d{2}(:?\\d{2})?)?)?$"


def safe_number_sql(x: str) -> str:
    return f"try_cast({x} AS DECIMAL(38,10))"


def safe_integer_sql(x: str) -> str:
    # try_cast('1250.00' AS INT) is NULL under ANSI, as a strict parse should be.
    return f"try_cast({x} AS INT)"


def safe_boolean_sql(x: str) -> str:
    return (
        f"CASE WHEN lower(trim({x})) = 'on' THEN true WHEN lower(trim({x})) = 'off' THEN false"
        f" ELSE try_cast({x} AS BOOLEAN) END"
    )


def _titled(x: str) -> str:
    """Month names with one capital, the only spelling the parser takes."""
    return f"initcap(trim({x}))"


def safe_date_sql(x: str) -> str:
    arms = " ".join(
        f"WHEN trim({x}) RLIKE '{guard}' THEN to_date(try_to_timestamp({_titled(x)}, '{layout}'))"
        for guard, layout in _DATE_LAYOUTS
    )
    return f"CASE {arms} WHEN trim({x}) RLIKE '{_ISO_INSTANT}' THEN try_cast(substr(trim({x}), 1, 10) AS DATE) END"


def plain_date_sql(x: str) -> str:
    """Whether a value is a date in one of the layouts, with no time of day."""
    layouts = " OR ".join(f"trim({x}) RLIKE '{guard}'" for guard, _ in _DATE_LAYOUTS)
    return f"(({layouts}) AND ({safe_date_sql(x)}) IS NOT NULL)"


def safe_timestamp_sql(x: str) -> str:
    return (
        f"CASE WHEN trim({x}) RLIKE '{_ISO_INSTANT}' THEN try_cast({x} AS TIMESTAMP)"
        f" ELSE try_cast(({safe_date_sql(x)}) AS TIMESTAMP) END"
    )


_CASTS = {
    "number": safe_number_sql,
    "integer": safe_integer_sql,
    "boolean": safe_boolean_sql,
    "date": safe_date_sql,
    "datetime": safe_timestamp_sql,
}


def safe_cast_sql(x: str, field_type: str) -> str:
    cast = _CASTS.get(field_type)
    return cast(x) if cast else x


def safe_cast(x: str, field_type: str) -> Column:
    return F.expr(safe_cast_sql(x, field_type))
