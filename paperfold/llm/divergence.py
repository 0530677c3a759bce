"""How far the sources of a language differ in their words: an audit over a prefix tree.

Every kept term of a language is a row of counts, one per source, mostly zeros.
The distance of two sources is the sum of f(p, q) over all kept terms, where p
and q come from the terms' counts. Taking every count as zero gives a sum that
needs no term at all. What is wrong with it is corrected in two ways: per source,
from a histogram of its counts, for terms the other source lacks; and per pair of
sources, for terms both have. The second is where the tree comes in. Each row's
nonzero counts, ordered by source (small sources first, whose counts repeat most),
are a path; equal rows go in once, with their number. Rows with a common beginning
share nodes, so a correction is made once for each node and each of its ancestors,
times the rows that pass through, and never once per term.

Rows are dealt out by their first items, so those that share a beginning meet in
one task, where equal ones are counted first. A tree that grows past `NODES` is summed up and begun
anew: sums of corrections do not care how rows are divided. A path is as long as
the language has sources; the result has a row for each two sources anyway.

All arithmetic is on integers. p = 1 + floor(1e9 (count + 2) / (N + 2V)), N the
group's count of kept terms and V their number; f = floor((p - q)^2 / (p + q)).
With p at most 1e9 + 1, squares stay below 2^63.

Defined results: null text, lang and source count as empty strings; each row is a
document, also repeated ones and those without a doc_id; further columns are
ignored; an empty table gives an empty result; a language without kept terms gives
pairs with the value 0.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperfold.session import as_table

LEAST_DOCS = 10
TOP_TERMS = 10
# Nodes of a tree before it is summed up; about 200 bytes each.
NODES = 200_000
# Items of a path that decide which task it goes to.
FIRST_ITEMS = 2
# Fixed value: what stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

_PATH = "array<struct<rank:bigint,count:bigint,p:bigint,p0:bigint>>"


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term, in billionths and one more; exact at any size."""
    whole = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + F.lit(2)).cast("decimal(20,0)")
    return F.call_function("div", whole, (n + F.lit(2) * v).cast("decimal(20,0)")) + F.lit(1)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (documents of the group that hold the term)."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select("lang", "source", F.split(lower, BETWEEN).alias("words"))
    # A row's words, then its different words: the first count places, the second documents.
    each = F.posexplode(F.concat("words", F.array_distinct("words"))).alias("at", "term")
    return (
        words.select("lang", "source", F.size("words").alias("n"), each)
        .filter("term <> ''")
        .groupBy("lang", "source", "term")
        .agg(F.count_if(F.col("at") < F.col("n")).alias("count"), F.count_if(F.col("at") >= F.col("n")).alias("docs"))
    )


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total, entries (source, count): the term rows, nonzero counts only."""
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("count").alias("total"),
            F.collect_list(F.struct("source", "count")).alias("entries"),
        )
        .filter(F.col("docs") >= least_docs)
        .select("lang", "term", "total", "entries")
    )


class Tree:
    """A prefix tree of term rows, its nodes numbered as they come."""

    def __init__(self):
        self.numbers, self.columns, self.rows = {}, ([], [], [], []), []

    def insert(self, path, times: int) -> None:
        """path: (source's rank, count, p, p0) ascending by rank."""
        node = -1
        for rank, count, p, p0 in path:
            key = (node, rank, count)
            found = self.numbers.setdefault(key, len(self.numbers))
            if found == len(self.rows):
                for column, value in zip(self.columns, (node, rank, p, p0), strict=True):
                    column.append(value)
                self.rows.append(0)
            self.rows[found] += times
            node = found

    def corrections(self):
        """(source's rank, later source's rank, value) arrays: what the rows of two
        nonzero counts add to a sum that knows one of them at a time."""
        import numpy as np

        parent, rank, p, p0 = (np.array(c, np.int64) for c in self.columns)
        rows = np.array(self.rows, np.int64)
        total, node, above = {}, np.arange(len(rows)), parent
        while len(node):
            live = above >= 0
            node, above = node[live], above[live]
            a, b, a0, b0 = p[above], p[node], p0[above], p0[node]
            value = rows[node] * (_distance(a, b) - _distance(a, b0) - _distance(a0, b) + _distance(a0, b0))
            keys, at = np.unique(np.stack([rank[above], rank[node]], 1), axis=0, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at.reshape(-1), value)
            for key, amount in zip(map(tuple, keys.tolist()), sums.tolist(), strict=True):
                total[key] = total.get(key, 0) + amount
            above = parent[above]
        return [(a, b, value) for (a, b), value in sorted(total.items())]


def _distance(p, q):
    return (p - q) * (p - q) // (p + q)


def pair_corrections(paths: DataFrame) -> DataFrame:
    """lang, low, high (sources' ranks), both (the sum of corrections) from the paths (lang, path) of all terms."""

    def grow(batches):
        import pyarrow as pa

        def sent(lang, tree):
            found = tree.corrections()
            columns = [[lang] * len(found), *([x[k] for x in found] for k in range(3))]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "low", "high", "both"]
            )

        trees = {}
        for batch in batches:
            items = batch.column(1)
            fields = [f.to_pylist() for f in items.flatten().flatten()]
            ends = [0, *_running(items.value_lengths().to_pylist())]
            for k, (lang, times) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                tree = trees.setdefault(lang, Tree())
                tree.insert(zip(*(f[ends[k] : ends[k + 1]] for f in fields), strict=True), times)
                if sum(len(t.rows) for t in trees.values()) >= NODES:
                    yield from (sent(*pair) for pair in trees.items())
                    trees = {}
        yield from (sent(*pair) for pair in trees.items())

    # By hash: sorting by range would send samples of whole paths to the driver.
    dealt = paths.withColumn("first", F.slice("path", 1, FIRST_ITEMS)).repartition("lang", "first")
    counted = dealt.groupBy("lang", "first", "path").agg(F.count(F.lit(1)).alias("times"))
    parts = counted.select("lang", "path", "times").mapInArrow(grow, "lang string, low bigint, high bigint, both bigint")
    return parts.groupBy("lang", "low", "high").agg(F.sum("both").alias("both"))


def _running(lengths):
    total = 0
    for n in lengths:
        total += n
        yield total


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: the other sources of the language by distance. Part `term`: the
    terms a source has more of than its language, the first `top_terms` of them.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = as_table(kept_terms(term_counts(plain), least_docs), "kept-terms")
    entries = kept.select("lang", "term", "total", F.inline("entries"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = (
        plain.select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["n", "v", "all_n"])
        .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("n", "source")).cast("bigint"))
    )
    groups = as_table(groups, "groups")
    shares = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    shares = as_table(shares, "shares")
    return _pairs(shares, groups).unionByName(_terms(shares, top_terms))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    path = F.sort_array(F.collect_list(F.struct("rank", "count", "p", "p0"))).cast(_PATH).alias("path")
    both = pair_corrections(shares.groupBy("lang", "term").agg(path))

    one = groups.select("lang", "source", "rank", "p0", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("rank").alias("item_rank"), F.col("p0").alias("item_p0"))
    pairs = as_table(one.join(other, "lang").filter("rank <> item_rank"), "pairs")
    # Terms a source has, as if the other had none of them.
    histogram = shares.groupBy("lang", "rank", "p").agg(F.count(F.lit(1)).alias("times"))
    single = (
        pairs.join(histogram, ["lang", "rank"])
        .groupBy("lang", "rank", "item_rank")
        .agg(F.sum(F.col("times") * (distance(F.col("p"), F.col("item_p0")) - distance(F.col("p0"), F.col("item_p0")))).alias("own"))
    )
    turned = single.select("lang", F.col("item_rank").alias("rank"), F.col("rank").alias("item_rank"), F.col("own").alias("its"))
    keys = ["lang", "rank", "item_rank"]
    none = F.col("v") * distance(F.col("p0"), F.col("item_p0"))
    value = sum((F.coalesce(c, F.lit(0)) for c in ("own", "its", "both")), F.coalesce(none, F.lit(0)))
    summed = (
        pairs.join(single, keys, "left")
        .join(turned, keys, "left")
        .withColumn("low", F.least("rank", "item_rank"))
        .withColumn("high", F.greatest("rank", "item_rank"))
        .join(both, ["lang", "low", "high"], "left")
    )
    return _ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    q = share(F.col("total"), F.col("all_n"), F.col("v"))
    more = shares.withColumn("q", q).filter("p > q")
    rows = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
