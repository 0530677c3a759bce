"""Counts of the further kinds, against what their spans say, over whole tables."""

import re

from paperfold.llm import pii


def test_counts_are_those_of_the_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [kinds.count(k) for k in pii.KINDS] == [r[f"n_{k}"] for k in pii.KINDS]
        assert r.private == bool(kinds)


def test_planted_data_is_found_and_other_rows_left_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    planted = re.compile(r"""token = "[0-9a-f]{32,}"|\+1 \([0-9]{3}\) 555-[0-9]{4}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])|@mail[0-9]+\.example|(?<![0-9])[0-9]{16}(?![0-9])""")
    want = {r.doc_id for r in docs if planted.search(r.text or "")}
    got = {r.doc_id for r in pii.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("private").collect()}
    assert want and len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.01 * len(docs)
