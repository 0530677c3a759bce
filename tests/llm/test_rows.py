"""Rows keep their names, whatever they come from."""

from pyspark.sql import functions as F

from paperfold.llm import rows
from paperfold.session import shared_folder


def names(df):
    return sorted((tuple(r[rows.ROW]), r.x) for r in rows.numbered(df).select(rows.ROW, "x").collect())


def test_rows_of_files_are_named_in_place(spark):
    folder = shared_folder(spark, "rows")
    spark.range(500).select((F.col("id") % 7).alias("x"), F.col("id").alias("y")).repartition(3).write.parquet(folder)
    docs = spark.read.parquet(folder)
    got = names(docs)
    assert len({n for n, _ in got}) == 500 and len({n[0] for n, _ in got}) == 3 and names(docs) == got
    # The same names through another plan.
    assert names(docs.filter("x = 3").select("x")) == [(n, x) for n, x in got if x == 3]


def test_other_rows_are_stored(spark):
    docs = spark.range(50).select((F.col("id") % 5).alias("x"))
    joined = docs.join(docs.withColumnRenamed("x", "z"), F.col("x") == F.col("z"))
    folder = shared_folder(spark, "rows")
    docs.write.parquet(folder)
    twice = spark.read.parquet(folder).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, n in ((docs, 50), (joined, 500), (twice, 100)):
        got = rows.numbered(df).collect()
        assert len({r[rows.ROW] for r in got}) == len(got) == n


def test_dropped_rows_go(spark):
    docs = rows.numbered(spark.range(10).select(F.col("id").alias("x")))
    assert sorted(r.x for r in rows.without(docs, docs.filter("x % 2 = 0")).collect()) == [1, 3, 5, 7, 9]
