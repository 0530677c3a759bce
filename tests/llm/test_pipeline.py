"""The pipeline, each stage against plain Python or SQL on its own input."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from paperfold.llm import encoding, mixing, queries
from paperfold.session import as_table
from tests.llm.test_operators import assert_gapless, groups_by_trying

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Input of each stage by name, and the last result."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = as_table(stage(spark, docs, sf_dir), "test-stage")
    return {**out, "result": docs}


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.orderBy("doc_id").collect()]


def after(steps, name):
    names = [*STAGES, "result"]
    return steps[names[names.index(name) + 1]]


def test_columns_stay_until_the_last_stage(steps):
    for name in STAGES:
        assert steps[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(steps):
    def passes(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)

    # No document of the smallest tables is depleted by the cross-document rule.
    assert rows(after(steps, "quality_rules")) == [(d, t) for d, t in rows(steps["quality_rules"]) if passes(t)]


def test_exact_stage(steps):
    first = {}
    for doc_id, text in rows(steps["exact_duplicates"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), (doc_id, text))
    assert rows(after(steps, "exact_duplicates")) == sorted(first.values())


def test_near_stage(steps):
    given = rows(steps["near_duplicates"])
    smallest, _ = groups_by_trying(given, 5)
    assert rows(after(steps, "near_duplicates")) == [(d, t) for d, t in given if smallest[d] == d]


def test_mixing_stage(steps):
    con = duckdb.connect()
    con.register("documents", steps["mixed"].toArrow())
    want = sorted(r[0] for r in con.execute(queries.mixing_sql()).fetchall())
    got = rows(after(steps, "mixed"))
    assert sorted(d for d, _ in got) == want and set(got) <= set(rows(steps["mixed"]))


def test_mixing_drops_nothing_where_shares_fit(spark):
    shares = [(f"src{k}", lang, w * v) for k, w in enumerate(mixing.DOMAINS.values()) for lang, v in mixing.LANGUAGES.items()]
    fit = [(n * 1000 + k, "one two three four five", lang, source) for n, (source, lang, size) in enumerate(shares) for k in range(size)]
    docs = spark.createDataFrame(fit, "doc_id bigint, text string, lang string, source string")
    assert sorted(map(tuple, mixing.kept_documents(docs).collect())) == sorted(fit)


def test_packing_stage(steps):
    tokenizer = encoding.byte_tokenizer()
    packed = steps["result"].collect()
    assert_gapless(packed)
    sizes = Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    want = Counter()  # a document is packed once for every epoch
    for d, t in rows(steps["packed"]):
        want[d] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert sizes == want


def test_run_is_its_stages(spark, sf_dir, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf_dir).select(*columns).collect()
    assert sorted(got) == sorted(steps["result"].select(*columns).collect())


SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{k}" for k in range(30))
NEAR = LONG.replace("word29", "other")


@pytest.mark.parametrize(
    "stage,given,kept",
    [
        ("quality_rules", [(None, "short"), (None, LONG), (1, LONG), (1, "short")], [(None, LONG), (1, LONG)]),
        ("exact_duplicates", [(None, "a  b"), (None, "a b"), (5, "a b"), (5, "a b"), (5, "c"), (None, "d"), (None, "d")], [(5, "a b"), (5, "c"), (None, "d")]),
        ("near_duplicates", [(None, LONG), (4, LONG), (4, LONG), (7, NEAR), (7, "quite another text"), (8, ""), (8, None), (9, "quite another text"), (None, "no id a b c"), (None, "No ID a b c")], [(4, LONG), (8, ""), (8, None), (None, "no id a b c")]),
    ],
)
def test_stages_choose_rows(spark, stage, given, kept):
    docs = spark.createDataFrame([(d, t, "en", "src0", 1) for d, t in given], SHAPE)
    got = sorted(((r.doc_id, r.text) for r in STAGES[stage](spark, docs, "").collect()), key=str)
    assert got == sorted(kept, key=str)
