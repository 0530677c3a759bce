"""Value normalisation: text as a document writes it -> text a cast accepts.

Every rule is SQL text over a fragment `x`, so the same rule serves DataFrame
code (`coerce_number("value")`) and the SQL functions registered for users.
A value that cannot be read with confidence is kept as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperfold.functions.text import let_sql

# The words read as true and as false.
TRUE_WORDS = ("true", "t", "yes", "y", "1", "paid", "on")
FALSE_WORDS = ("false", "f", "no", "n", "0", "unpaid", "off")

# Whitespace including the no-break and other Unicode spaces.
_SPACE = r"[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '')"


def _separators_sql(k: str, strict: bool) -> str:
    """Comma and dot resolved: both present means the comma groups thousands;
    a comma alone groups only in the unambiguous 1,234,567 layout."""
    sign = "[-+]?" if strict else ""
    return (
        f"regexp_replace(CASE WHEN contains({k}, ',') AND (contains({k}, '.')"
        f" OR {k} RLIKE '^{sign}\\\\d{{1,3}}(,\\\\d{{3}})+$') THEN replace({k}, ',', '')"
        f" ELSE replace({k}, ',', '.') END, '^[+]+', '')"
    )


def number_text_sql(x: str, mode: str = "default") -> str:
    """Normal decimal text, or NULL when `x` is not clearly a number.

    mode="strict" also refuses readings the default accepts although they are
    doubtful: letters between or before the digits ("1e5", "Rs. 500") and a
    European "1.234,56"; and it reads "-1,234" as a grouped integer.
    """
    strict = mode == "strict"
    kept = f"regexp_replace({x}, '[^0-9.,\\\\-+]', '')"
    canon = (
        "regexp_replace(regexp_replace(regexp_replace(t,"
        r" '^(-?)0+(\\d)', '$1$2'), '^(-?)\\.', '$10.'), '\\.$', '')"
    )
    negated = (
        f"{x} RLIKE '(?s)^{_SPACE}*\\\\(.*\\\\){_SPACE}*$'"
        f" AND t RLIKE '[1-9]' AND NOT startswith(t, '-')"
    )
    valid = "t RLIKE '^-?(\\\\d+\\\\.?\\\\d*|\\\\.\\\\d+)$'"
    if strict:
        valid += (
            f" AND NOT {x} RLIKE '[0-9][A-Za-z]+[0-9]|[A-Za-z]\\\\.|[.][0-9]*,'"
        )
    body = f"CASE WHEN {valid} THEN concat(if({negated}, '-', ''), {canon}) END"
    return let_sql("t", let_sql("k", kept, _separators_sql("k", strict)), body)


def integer_text_sql(x: str, mode: str = "default") -> str:
    whole = (
        r"CASE WHEN n RLIKE '^-?\\d+([.]0*)?$'"
        " THEN regexp_replace(regexp_replace(n, '[.]0*$', ''), '^-0$', '0') END"
    )
    return let_sql("n", number_text_sql(x, mode), whole)


def boolean_text_sql(x: str) -> str:
    word = f"lower({strip_sql(x)})"
    true = ", ".join(f"'{w}'" for w in TRUE_WORDS)
    false = ", ".join(f"'{w}'" for w in FALSE_WORDS)
    return f"CASE WHEN {word} IN ({true}) THEN 'true' WHEN {word} IN ({false}) THEN 'false' END"


# Text the number rule would return unchanged; most cells are of this kind.
_PLAIN_NUMBER = "^-?(0|[1-9][0-9]*)([.][0-9]+)?$"
# Thousands set off by commas, with decimals: only the commas go.
_GROUPED_NUMBER = "^-?[1-9][0-9]{0,2}(,[0-9]{3})+[.][0-9]+$"
_PLAIN_INTEGER = "^(0|-?[1-9][0-9]*)$"


def _guarded(x: str, coerced: str, plain: str | None = None, grouped: str | None = None) -> str:
    """Blank reads as NULL; a failed coercion keeps the raw text."""
    shortcut = f"WHEN {x} RLIKE '{plain}' THEN {x} " if plain else ""
    if grouped:
        shortcut += f"WHEN {x} RLIKE '{grouped}' THEN replace({x}, ',', '') "
    return f"CASE {shortcut}WHEN {x} RLIKE '[^{_SPACE[1:]}' THEN coalesce({coerced}, {x}) END"


def coerce_number_sql(x: str, mode: str = "default") -> str:
    return _guarded(x, number_text_sql(x, mode), _PLAIN_NUMBER, _GROUPED_NUMBER)


def coerce_integer_sql(x: str, mode: str = "default") -> str:
    return _guarded(x, integer_text_sql(x, mode), _PLAIN_INTEGER)


def coerce_boolean_sql(x: str) -> str:
    return _guarded(x, boolean_text_sql(x))


def coerce_value_sql(x: str, field_type: str, mode: str = "default") -> str:
    """`x` normalised for the type named by the SQL fragment `field_type`.

    string, date and datetime pass through on purpose: guessing at
    "03/04/2026" would invent data.
    """
    return (
        f"CASE {field_type} WHEN 'number' THEN {coerce_number_sql(x, mode)}"
        f" WHEN 'integer' THEN {coerce_integer_sql(x, mode)}"
        f" WHEN 'boolean' THEN {coerce_boolean_sql(x)} ELSE {x} END"
    )


def coerce_number(x: str, mode: str = "default") -> Column:
    return F.expr(coerce_number_sql(x, mode))


def coerce_integer(x: str, mode: str = "default") -> Column:
    return F.expr(coerce_integer_sql(x, mode))


def coerce_boolean(x: str) -> Column:
    return F.expr(coerce_boolean_sql(x))


def coerce_value(x: str, field_type: str, mode: str = "default") -> Column:
    return F.expr(coerce_value_sql(x, field_type, mode))
