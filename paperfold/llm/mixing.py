"""Mixing sources to target weights, by budgets down a tree; DataFrame functions alone.

Leaves (domain, language, source) hold tokens. The whole budget is dealt from
the root: siblings share their parent's budget by weight, but none gets more
than all leaves below it can give in `max_epochs` passes; what one cannot take
goes to its siblings first, and only what none of them can take is missing at
their parent, whose siblings then take it. With capacities summed from the
leaves up, one pass from the root down does exactly this, and each level is one
window over a table with a row per node.

A leaf is read in seeded epochs: whole passes as far as its budget goes, then
the prefix of one more pass, in the order of a hash. The document at the cut is
taken in part. Prefix sums are taken in slices of the hash order, so that a leaf
with a third of all rows is many tasks' work.

Defined results: a null or empty text has no tokens and is taken where the prefix
passes it; null labels are the label ''; nodes without a weight count as weight
1, weight 0 excludes a node and all below; repeated rows are separate documents;
further columns are ignored; an empty table gives an empty result. Tokens here
are words (runs without ASCII white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperfold.llm.rows import ROW, numbered
from paperfold.session import as_table

LEVELS = ("domain", "lang", "source")
SEED = 17
MAX_EPOCHS = 4
# Slices of a leaf's order: the first hexadecimal digits of the hash.
_SLICE_DIGITS = 3

_BREAK = r"[\x20\x09-\x0D]+"
_BIG = "decimal(20,0)"


def n_words(text: str = "text") -> Column:
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _BREAK, " "))
    words = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    return F.when(F.length(plain) > 0, words).otherwise(0).cast("bigint")


def measured(docs: DataFrame, levels: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, labels, tokens and `keep` of each row; stored, since several steps read it."""
    labels = [F.coalesce(c.cast("string"), F.lit("")).alias(name) for name, c in levels.items()]
    return as_table(docs.select("doc_id", *labels, n_words().alias("tokens"), *keep), "measured")


def leaf_capacities(rows: DataFrame, levels: tuple[str, ...], weights: dict[str, DataFrame], max_epochs: int) -> DataFrame:
    """Leaves with their tokens, capacity and the weight of every node above them.

    `weights[level]` has columns `level` and `weight`, and may also have columns
    of higher levels to weigh a node by its place.
    """
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    for level in levels:
        weight = f"w_{level}"
        if level in weights:
            table = weights[level].withColumnRenamed("weight", weight)
            leaves = leaves.join(table, [c for c in table.columns if c != weight], "left")
            leaves = leaves.withColumn(weight, F.coalesce(weight, F.lit(1)).cast("bigint"))
        else:
            leaves = leaves.withColumn(weight, F.lit(1).cast("bigint"))
        leaves = leaves.filter(F.col(weight) > 0)
    return leaves.withColumn("capacity", F.col("tokens") * max_epochs)


def shared(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`target` of each node: its share of `budget`, at most its `capacity`.

    Nodes are taken by rising capacity per weight. As long as a node's capacity
    is within its share of what is left, it is filled; the others share the rest
    by weight. All figures are whole numbers.
    """
    big = [F.col(c).cast(_BIG) for c in ("capacity", "weight", "budget")]
    capacity, weight, budget = big
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = capacity * onward.cast(_BIG) <= (budget - before.cast(_BIG)) * weight
    marked = nodes.withColumn("fits", fits)
    marked = marked.withColumn("full", F.min("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    family = Window.partitionBy(*parent)
    marked = marked.withColumns(
        {
            "given": F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0)),
            "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(family),
        }
    )
    share = F.expr(f"(CAST(budget - given AS {_BIG}) * CAST(weight AS {_BIG})) div CAST(open AS {_BIG})")
    target = F.when(F.col("full"), F.col("capacity")).otherwise(F.least(share, "capacity"))
    return marked.withColumn("target", target.cast("bigint"))


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...], total: int | None, percent: int = 100) -> DataFrame:
    """Leaves with `target`. Without a total, the budget is a percentage of all tokens there are."""
    whole = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    asked = F.expr(f"(tokens * {percent}) div 100") if total is None else F.lit(total).cast("bigint")
    above = whole.select(F.lit(0).alias("root"), F.least(asked, "capacity").alias("budget"))
    rooted = leaves.withColumn("root", F.lit(0))
    for depth, level in enumerate(levels):
        parent = ["root", *levels[:depth]]
        path = [*parent, level]
        nodes = rooted.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first(f"w_{level}").alias("weight"))
        dealt = shared(nodes.join(above, parent), parent, level)
        above = dealt.select(*path, F.col("target").alias("budget"))
    return leaves.select(*levels, F.col("tokens").alias("available")).join(
        above.select(*levels, F.col("budget").alias("target")), list(levels)
    )


def selected(
    rows: DataFrame, budgets: DataFrame, levels: tuple[str, ...], seed: int = SEED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of whole epochs, and the prefix of the epoch after them."""
    leaf = list(levels)
    plan = budgets.select(
        *leaf,
        F.expr("target div available").cast("int").alias("whole"),
        (F.col("target") % F.col("available")).alias("rest"),
    )
    joined = rows.join(plan, leaf)
    columns = ["doc_id", *leaf, "tokens", "epoch", "tokens_taken", *keep]
    passes = joined.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    passes = passes.withColumn("tokens_taken", F.col("tokens")).select(*columns)

    key = F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = [*leaf, "slice"]
    last = joined.filter("rest > 0").withColumn("at", F.md5(key)).withColumn("slice", F.substring("at", 1, _SLICE_DIGITS))
    earlier = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = last.groupBy(*part).agg(F.sum("tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*part).orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = last.join(slices.select(*part, "ahead"), part).filter("ahead < rest")
    last = last.withColumn("start", F.col("ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    prefix = last.filter("start < rest").withColumns(
        {"epoch": F.col("whole"), "tokens_taken": F.least("tokens", F.col("rest") - F.col("start"))}
    )
    return passes.unionByName(prefix.select(*columns))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, DataFrame],
    total: int | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    percent: int = 100,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, labels, tokens, epoch, tokens_taken of everything that is read, and `keep`."""
    names = tuple(levels)
    rows = measured(docs, levels, keep)
    leaves = leaf_capacities(rows, names, weights, max_epochs)
    budgets = as_table(leaf_budgets(leaves, names, total, percent), "budgets")
    return selected(rows, budgets, names, seed, keep)


# The tree over `documents`: which sources make up a domain, and what each weighs.
DOMAINS = {"web": 5, "forum": 3, "books": 2}
LANGUAGES = {"en": 6, "de": 2, "fr": 2, "es": 1}


def document_levels() -> dict[str, Column]:
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return {"domain": F.get(names, F.pmod(number, F.lit(len(DOMAINS))).cast("int")), "lang": F.col("lang"), "source": F.col("source")}


def document_weights(spark) -> dict[str, DataFrame]:
    return {
        "domain": spark.createDataFrame(list(DOMAINS.items()), "domain string, weight bigint"),
        "lang": spark.createDataFrame(list(LANGUAGES.items()), "lang string, weight bigint"),
    }


def mixed_documents(
    docs: DataFrame, total: int | None = None, max_epochs: int = MAX_EPOCHS, percent: int = 100, keep: tuple[str, ...] = ()
) -> DataFrame:
    weights = document_weights(docs.sparkSession)
    return mix(docs, document_levels(), weights, total, max_epochs, percent=percent, keep=keep)


def kept_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of the mix, with all their columns, once for every epoch that reads
    them. As many tokens go out as come in: sources that fall short of their weight are
    read again, up to `max_epochs` times, and those above it lose documents; where
    the shares fit already, every document stays, once. The document at a leaf's cut
    is kept whole."""
    rows = numbered(docs)
    return rows.join(mixed_documents(rows, max_epochs=max_epochs, keep=(ROW,)).select(ROW), ROW).drop(ROW)
