import random

import pytest
from pyspark.sql import functions as F

from paperfold.functions import coerce
from paperfold.functions.casts import safe_cast
from paperfold.functions.ordering import HOT_ROWS, along, hot_keys, index_within, previous_within, running_within

# raw text -> (number, integer); None in the pair means "kept as it stands".
NUMBERS = {
    "83,880.00": ("83880.00", "83880"),
    "9%": ("9", "9"),
    "₹1,250.50": ("1250.50", None),
    "(1,200.00)": ("-1200.00", "-1200"),
    "1,234": ("1234", "1234"),
    "1,5": ("1.5", None),
    "-1,234": ("-1.234", None),
    "1.234,56": ("1.23456", None),
    "1,00,000": (None, None),
    "1,00,000.00": ("100000.00", "100000"),
    "Rs. 500": ("0.500", None),
    "1e5": ("15", "15"),
    "10-20": (None, None),
    "1200-": (None, None),
    "n/a": (None, None),
    "007.50": ("7.50", None),
    ".5": ("0.5", None),
    "5.": ("5", "5"),
    "+12": ("12", "12"),
    "(0)": ("0", "0"),
    "  42  ": ("42", "42"),
    "-0.00": ("-0.00", "0"),
}


def _values(spark, texts, column):
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", column.alias("y")).collect()
    return {r["x"]: r["y"] for r in rows}


def test_numbers_and_integers(spark):
    numbers = _values(spark, NUMBERS, coerce.coerce_number("x"))
    whole = _values(spark, NUMBERS, coerce.coerce_integer("x"))
    for raw, (number, integer) in NUMBERS.items():
        assert numbers[raw] == (raw if number is None else number), raw
        assert whole[raw] == (raw if integer is None else integer), raw
    assert _values(spark, ["", "   "], coerce.coerce_number("x")) == {"": None, "   ": None}


def test_strict_numbers_keep_doubtful_text(spark):
    texts = ["-1,234", "1e5", "Rs. 500", "1.234,56", "83,880.00"]
    assert _values(spark, texts, coerce.coerce_number("x", "strict")) == {
        "-1,234": "-1234", "1e5": "1e5", "Rs. 500": "Rs. 500", "1.234,56": "1.234,56", "83,880.00": "83880.00",
    }


def test_booleans_and_passthrough(spark):
    got = _values(spark, ["Yes", "T", "1", " paid", "on", "No", "F", "0", "unpaid", "off", "maybe", " "], coerce.coerce_boolean("x"))
    assert [got[k] for k in ("Yes", "T", "1", " paid", "on")] == ["true"] * 5
    assert [got[k] for k in ("No", "F", "0", "unpaid", "off")] == ["false"] * 5
    assert got["maybe"] == "maybe" and got[" "] is None
    assert _values(spark, ["03/04/2026"], coerce.coerce_value("x", "'date'")) == {"03/04/2026": "03/04/2026"}


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("date", "24 Sep 2026", "2026-09-24"),
        ("date", "2026-09-24", "2026-09-24"),
        ("date", "September 24, 2026", "2026-09-24"),
        ("date", "03/04/2026", None),
        ("date", "2026", None),
        ("date", "31 Feb 2026", None),
        ("integer", "1250.00", None),
        ("integer", "12", "12"),
        ("number", "12.5x", None),
        ("boolean", "on", "true"),
        ("boolean", "perhaps", None),
        ("datetime", "2026-09-24T10:20:30Z", "2026-09-24 10:20:30"),
        ("datetime", "soon", None),
    ],
)
def test_bad_cells_read_null(spark, kind, text, want):
    assert _values(spark, [text], safe_cast("x", kind).cast("string")) == {text: want}


def test_hot_keys_give_the_same_results_as_plain_windows(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    cut, keys, order = F.floor(F.col("at") / 17), ["k"], ["at"]

    def work(part, coarse):
        part = index_within(part, keys, order, "n", coarse)
        part = running_within(part, keys, order, {"s": F.col("v")}, {"m": F.col("v")}, coarse)
        return previous_within(part, keys, order, ["at", "v"], "p", coarse)

    plain = sorted(work(df, None).collect())
    assert sorted(along(df, keys, cut, work, hot_keys(df, keys, 0)).collect()) == plain
    assert sorted(along(df, keys, cut, work, hot_keys(df, keys, 120)).collect()) == plain
    assert hot_keys(df, keys, HOT_ROWS).isEmpty()


def test_grouped_numbers_take_the_short_way_to_the_same_text(spark):
    from pyspark.sql import functions as F

    from paperfold.functions.coerce import coerce_number_sql, number_text_sql

    values = ["1,234.50", "-1,234.50", "12,345,678.9", "1,23.4", "0,123.4", "(1,234.50)", "1,234", "1.234,56"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for mode in ("default", "strict"):
        whole = f"coalesce({number_text_sql('v', mode)}, v)"
        assert rows.filter(~F.expr(f"{coerce_number_sql('v', mode)} <=> {whole}")).count() == 0
    assert "replace(v, ',', '') " in coerce_number_sql("v")
