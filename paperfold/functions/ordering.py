"""Running computations that stay parallel when one key holds most rows.

A plain window puts a whole key into one task, which is right for ordinary keys
and fatal for a hot one. Keys are counted first (combined before the shuffle).
Ordinary keys take the plain window. A hot key is cut into slices along its
order (`coarse`: a column that never decreases along `order_by`), worked inside
each slice, and corrected by what its earlier slices contribute, one row per
(key, slice). Without hot keys, adaptive execution drops that branch unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# A key with more rows than this is hot.
HOT_ROWS = 1_000_000

_SLICE = "__slice"


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than `rows` rows: at most (all rows / `rows`) of them."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counted.filter(F.col("__n") > rows).select(*keys)


def split_hot(
    df: DataFrame,
    keys: list[str],
    hot: DataFrame,
    ordinary: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """`ordinary` on the rows of ordinary keys, `spread` on those of hot keys."""
    # Safe to broadcast: `hot_keys` bounds it at one key per HOT_ROWS rows.
    few = F.broadcast(hot)
    return ordinary(df.join(few, keys, "left_anti")).unionByName(spread(df.join(few, keys, "left_semi")))


def index_within(
    df: DataFrame, keys: list[str], order_by: list, name: str, coarse: Column | None = None
) -> DataFrame:
    """0-based position within the key; over slices when `coarse` is given."""
    if coarse is None:
        position = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)) - 1
        return df.withColumn(name, position.cast("bigint"))
    part = [*keys, _SLICE]
    sliced = df.withColumn(_SLICE, coarse)
    local = F.row_number().over(W.partitionBy(*part).orderBy(*order_by)) - 1
    before = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return (
        sliced.withColumn(name, local)
        .join(offsets, part)
        .withColumn(name, (F.col(name) + F.col("__before")).cast("bigint"))
        .drop(_SLICE, "__before")
    )


def running_within(
    df: DataFrame,
    keys: list[str],
    order_by: list,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    coarse: Column | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima along the key; over slices with `coarse`."""
    sums, maxima = sums or {}, maxima or {}
    values = {**sums, **maxima}
    fold = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(maxima, F.max)}
    if coarse is None:
        so_far = W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: fold[n](c).over(so_far) for n, c in values.items()})
    part = [*keys, _SLICE]
    sliced = df.withColumns({_SLICE: coarse, **{f"__in_{n}": c for n, c in values.items()}})
    so_far = W.partitionBy(*part).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.withColumns({n: fold[n](f"__in_{n}").over(so_far) for n in values})
    before = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    totals = sliced.groupBy(*part).agg(*[fold[n](f"__in_{n}").alias(f"__in_{n}") for n in values])
    carried = totals.select(*part, *[fold[n](f"__in_{n}").over(before).alias(f"__pre_{n}") for n in values])
    merged = {
        n: F.coalesce(F.col(n) + F.col(f"__pre_{n}"), F.col(n), F.col(f"__pre_{n}"))
        if n in sums
        else F.greatest(F.col(n), F.col(f"__pre_{n}"))
        for n in values
    }
    scratch = [_SLICE, *[f"__in_{n}" for n in values], *[f"__pre_{n}" for n in values]]
    return local.join(carried, part).withColumns(merged).drop(*scratch)


def previous_within(
    df: DataFrame, keys: list[str], order_by: list[str], columns: list[str], name: str, coarse: Column | None = None
) -> DataFrame:
    """Struct `name` with `columns` of the row just before, NULL on the first."""
    row = F.struct(*columns)
    if coarse is None:
        return df.withColumn(name, F.lag(row).over(W.partitionBy(*keys).orderBy(*order_by)))
    part = [*keys, _SLICE]
    sliced = df.withColumn(_SLICE, coarse)
    last = sliced.groupBy(*part).agg(F.max_by(row, F.struct(*order_by)).alias("__last"))
    at = W.partitionBy(*keys).orderBy(_SLICE)
    carried = last.select(*part, F.lag("__last").over(at).alias("__carry"))
    return (
        sliced.withColumn(name, F.lag(row).over(W.partitionBy(*part).orderBy(*order_by)))
        .join(carried, part)
        .withColumn(name, F.coalesce(F.col(name), F.col("__carry")))
        .drop(_SLICE, "__carry")
    )


def along(
    df: DataFrame,
    keys: list[str],
    coarse: Column,
    work: Callable[[DataFrame, Column | None], DataFrame],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Runs `work(rows, None)` on ordinary keys and `work(rows, coarse)` on hot ones."""
    found = hot if hot is not None else hot_keys(df, keys)
    return split_hot(df, keys, found, lambda rows: work(rows, None), lambda rows: work(rows, coarse))


def ordered_index(
    df: DataFrame,
    keys: list[str],
    order_by: list,
    coarse: Column,
    name: str = "row_index",
    hot: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row within its key."""
    return along(df, keys, coarse, lambda rows, cut: index_within(rows, keys, order_by, name, cut), hot)
