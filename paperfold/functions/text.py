"""Small text rules shared by several operators, as SQL text over a fragment."""

from __future__ import annotations

# How much of a text a list shows, unless the caller says otherwise.
TITLE_CHARS = 80
PREVIEW_CHARS = 120
SNIPPET_CHARS = 280


def let_sql(name: str, value: str, body: str) -> str:
    """Evaluates `value` once per row and names it inside `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def collapse_sql(x: str) -> str:
    """All runs of whitespace become one blank, ends trimmed."""
    return rf"trim(regexp_replace({x}, '[\\s\\x1c-\\x1f\\x85\\xa0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u3000]+', ' '))"


def title_sql(x: str, chars: int = TITLE_CHARS) -> str:
    flat = collapse_sql(x)
    return (
        f"CASE WHEN coalesce({flat}, '') = '' THEN 'New chat'"
        f" WHEN length({flat}) <= {chars} THEN {flat}"
        f" ELSE concat(rtrim(substring({flat}, 1, {chars - 1})), '…') END"
    )


def view_name_sql(x: str) -> str:
    """`view_` + an identifier made from a schema name."""
    ident = f"lower(regexp_replace({x}, '[^a-zA-Z0-9_]', '_'))"
    return f"concat('view_', if({ident} = '' OR {ident} RLIKE '^[0-9]', 'f_', ''), {ident})"


# Spellings of a type in an imported schema file.
TYPE_SPELLINGS = {
    "string": ("string", "text", "str", "varchar"),
    "number": ("number", "float", "double", "decimal"),
    "integer": ("integer", "int"),
    "boolean": ("boolean", "bool"),
    "date": ("date",),
    "datetime": ("datetime",),
}


def normalize_type_sql(x: str) -> str:
    word = f"lower(trim({x}))"
    arms = " ".join(
        f"WHEN {word} IN ({', '.join(repr(s) for s in spellings)}) THEN '{kind}'"
        for kind, spellings in TYPE_SPELLINGS.items()
    )
    return f"CASE {arms} ELSE 'string' END"


def tokens_sql(x: str, without: tuple[str, ...] = ()) -> str:
    """Lower-case words of letters and digits, in order, repeats kept, but for those in `without`."""
    gone = ", ".join(f"'{w}'" for w in ("", *without))
    return rf"filter(split(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), w -> w NOT IN ({gone}))"
