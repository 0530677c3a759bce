"""Plans and steps that must stay right on tables far larger than these."""

from __future__ import annotations

import pytest


@pytest.mark.parametrize(
    "name", ["assigned_keys", "field_prompts", "identity_keys", "identity_names", "names_at_version", "field_specs"]
)
def test_no_table_of_fields_goes_through_the_driver(spark, sf_dir, name):
    from __spark_entry__ import queries

    planned = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in planned


def test_texts_that_fit_most_options_are_sent_on_block_by_block(spark, monkeypatch):
    """No batch holds the hits of more texts than one block counts."""
    from paperfold.operators import matching

    monkeypatch.setattr(matching, "COUNTS", 40)
    options = spark.range(20).selectExpr("id AS option_id", "array('all', 'word' || id) AS words")
    docs = spark.range(0, 50, 1, 1).selectExpr("id AS doc_id", "array('all', 'word3') AS words")
    found = matching.with_hits(docs, options, 0.5)

    assert [tuple(r) for r in found.selectExpr("sum(size(hits))", "min(size(hits))").collect()] == [(1000, 20)]
    batches = docs.select("words", "doc_id").toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    sent = list(matching.with_hits(docs, options, 0.5)(iter(batches)))
    assert (sum(b.num_rows for b in sent), max(b.num_rows for b in sent)) == (50, 2)


def test_a_file_stream_reads_a_folder_of_files(spark, tmp_path):
    from __spark_entry__ import queries

    rows = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "c", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars int")
    rows.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries()["ingest_stream"](spark, str(tmp_path)).collect()] == [("s", 2, 4, 2)]


def test_a_stream_asks_the_state_once_for_many_rows_of_a_key():
    """Not once a row: a key's rows of a trigger go in together, with one timer."""
    from types import SimpleNamespace

    from paperfold.streaming.jobs import TrailingRate

    class Recorded:
        def __init__(self):
            self.rows, self.calls = [], 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

        def appendList(self, rows):
            self.rows, self.calls = self.rows + list(rows), self.calls + 1

        put = appendList

    states, timers = {}, []
    handle = SimpleNamespace(getListState=lambda name, _: states.setdefault(name, Recorded()), registerTimer=timers.append)
    rate = TrailingRate(10_000_000)
    rate.init(handle)
    rows = [SimpleNamespace(at=n * 1_000_000, number=n) for n in range(1000)]
    list(rate.handleInputRows((1,), iter(rows), None))
    assert (states["waiting"].calls, timers) == (1, [1])
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 500_000)
    out = list(rate.handleExpiredTimer((1,), passed, None))
    assert [r.in_window for r in out] == [min(n + 1, 10) for n in range(500)]
    assert len(states["waiting"].rows) == 500 and timers == [1, 500_001]


def test_parts_of_texts_go_on_a_few_thousand_at_a_time(spark):
    from types import SimpleNamespace

    import pandas as pd

    from paperfold.sources.elements import per_document

    docs = spark.range(0, 20, 1, 1).selectExpr("id AS document_id", "'x' AS text")
    split = lambda _: ((n,) for n in range(5_000))
    assert per_document(docs, "text", split, ["n"], ["int"]).count() == 100_000
    # What a task does with one batch of texts.
    held = SimpleNamespace(mapInPandas=lambda run, _: run)
    run = per_document(SimpleNamespace(schema=docs.schema, select=lambda *_: held), "text", split, ["n"], ["int"])
    sizes = [len(part) for part in run(iter([pd.DataFrame({"document_id": range(20), "text": "x"})]))]
    assert (sum(sizes), max(sizes)) == (100_000, 5_000)


def test_embedding_counts_words_in_one_pass(spark):
    """Every word at its own place; the count does not go through all words for each place."""
    import math

    from paperfold.functions.vectors import embed, embed_sql

    df = spark.createDataFrame([("b a b c b a",), ("",), (None,)], "text string")
    vector, *empty = [r.embedding for r in embed(df, "text").collect()]
    counts = sorted(round(x * math.sqrt(14)) for x in vector if x)
    assert (len(vector), counts, empty) == (384, [1, 2, 3], [[], []])
    assert "array_remove" not in embed_sql("text")


def test_records_that_point_nowhere_are_shared_out(spark):
    from pyspark.sql import functions as F

    from paperfold.operators import confirm

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    records = spark.range(2_000).selectExpr(
        "CAST(id AS STRING) AS id", "id AS document_id", "0 AS row_index", "if(id % 100 = 7, CAST(id % 200 AS STRING), NULL) AS is_duplicate_of"
    )
    doomed = spark.createDataFrame([("7",)], "id string")
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = confirm.detach_duplicates(records, doomed)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        pointing = out.filter("is_duplicate_of IS NOT NULL")
        assert (out.count(), pointing.count(), pointing.select("is_duplicate_of").distinct().count()) == (2_000, 10, 1)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(sizes) < 1_000


def test_edits_fill_down_by_row_as_by_cell(spark):
    """Cells are made after edits have met their rows, so no cell is shuffled."""
    import random

    from paperfold.operators import extraction, review

    rng = random.Random(5)
    data = lambda: {f: rng.choice(["a", "b", None]) for f in "wxyz" if rng.random() < 0.9}
    rows = [(d, r, data(), {"x": 0.5}) for d in (1, 2, 3, 4, None) for r in range(6)]
    rows += [rows[0], (1, None, {"x": "a", "z": "b"}, {})]
    # Document-wide w and x; y and z (unknown scope) by the cell. One cell is edited twice.
    edits = [(1, 0, "w", "W"), (1, 3, "w", "V"), (2, 1, "x", None), (2, 1, "y", None), (3, 2, "z", "Z"), (3, 2, "z", "Q")]
    edits += [(None, 0, "w", "n"), (None, 1, "y", "n"), (4, None, "y", "n"), (4, 0, None, "n"), (1, 5, "y", "Y"), (9, 0, "w", "n")]
    rows = spark.createDataFrame(rows, "document_id int, row_index int, data map<string,string>, data_confidence map<string,double>")
    edits = spark.createDataFrame(edits, "document_id int, row_index int, field string, value string")
    scopes = spark.createDataFrame([("w", "document"), ("x", "document"), ("y", "row")], "field string, scope string")
    hot = spark.createDataFrame([(2,)], "document_id int")

    def plain(df):
        columns = ["document_id", "row_index", "field", "value", "confidence"]
        return sorted(map(repr, map(tuple, df.select(*columns).collect())))

    want = plain(review.fill_down(extraction.staged_cells(rows), edits, scopes))
    for apart, many in ((None, 1_000), (None, 1), (hot, 1_000), (hot, 3)):
        assert plain(review.fill_down_rows(rows, edits, scopes, apart, many)) == want


@pytest.mark.parametrize("name", ["filled_down", "surviving_confidence"])
def test_rows_dealt_by_document_stay_where_they_are(spark, sf_dir, name):
    """Staged rows meet their edits, or their old state, without another shuffle of rows or cells."""
    import re

    from __spark_entry__ import queries

    key = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = queries()[name](spark, sf_dir)
        df.collect()
        ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, kept)
    dealt = re.findall(r"Exchange hashpartitioning\((document_id#[^)]*), \d+\)", ran)
    assert dealt and not [keys for keys in dealt if "," in keys]


def test_scores_survive_for_rows_that_stand_twice_or_have_no_key(spark):
    from paperfold.operators import review

    shape = "document_id int, row_index int, data map<string,string>"
    old = [(1, 0, {"x": "a", "y": None}, {"x": 0.1, "y": 0.2}), (1, 0, {"x": "b", "y": None}, {"x": 0.3}), (None, 0, {"x": "a"}, {"x": 0.4}), (2, 0, None, {"x": 0.5}), (3, 0, {"x": "a"}, None)]
    new = [(1, 0, {"x": "a", "y": None}), (None, 0, {"x": "a"}), (2, 0, {"x": "a"}), (3, 0, {"x": "a"}), (4, 0, {"x": "a"}), (1, 0, {"x": "b"})]
    before, after = spark.createDataFrame(old, shape + ", data_confidence map<string,double>"), spark.createDataFrame(new, shape)
    kept = review.surviving_row_confidence(before, after)
    got = sorted((r["document_id"] or 0, sorted(r["data"]), sorted(r["data_confidence"].items())) for r in kept.collect())
    assert got == [
        (0, ["x"], []), (1, ["x"], []), (1, ["x"], [("x", 0.3)]),
        (1, ["x", "y"], []), (1, ["x", "y"], [("x", 0.1), ("y", 0.2)]), (2, ["x"], []), (3, ["x"], []), (4, ["x"], []),
    ]


def test_fitting_options_equal_counting_each_pair(spark, monkeypatch):
    """Ids come sorted, each once, however texts, options and batches are cut."""
    import random

    from pyspark.sql import functions as F

    from paperfold.operators import matching

    monkeypatch.setattr(matching, "LANES", 1, raising=False)
    monkeypatch.setattr(matching, "STRIP_OPTIONS", 7, raising=False)
    monkeypatch.setattr(matching, "COUNTS", 30)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    options = [(rng.choice([*range(40), None]), rng.sample([*words, "absent"], rng.randint(0, 14))) for _ in range(61)]
    texts = [(d % 140, None if d % 17 == 0 else rng.sample([*words, "other"], rng.randint(0, 20))) for d in range(150)]
    docs = spark.createDataFrame(texts, "doc_id int, words array<string>").coalesce(1)
    given = spark.createDataFrame(options, "option_id int, words array<string>")

    def want(text, those, threshold):
        fit = {o for o, ws in those if ws and len(set(ws) & set(text or [])) >= max(1, -(-threshold * len(ws) // 1))}
        return sorted(fit - {None}) + [None] * (None in fit)

    for threshold in (0.0, 0.3, 0.5, 1.0, 1.5):
        got = matching.with_hits(docs, given, threshold, only_ids=True).collect()
        assert [(r.doc_id, r.hits) for r in got] == [(d, want(t, options, threshold)) for d, t in texts]
    hinted = docs.withColumn("hint_ids", F.expr("CASE doc_id % 3 WHEN 0 THEN array(5, 3, 5) WHEN 1 THEN CAST(array() AS ARRAY<INT>) END"))
    got = {(r.doc_id, tuple(r.topic_ids or ["none"])) for r in matching.suggest_topics(hinted, given).collect()}
    assert got == {(d, ((3, 5), tuple(want(t, options, 0.5)) or ("none",), ("none",))[d % 3]) for d, t in texts}
    tasks = [(rng.choice(["b", "a", "é", None]), *o) for o in options] + [("unasked", 1, [])]
    found = matching.multi_task_classify(docs, spark.createDataFrame(tasks, "task string, option_id int, words array<string>"))
    names = ["a", "b", "unasked", "é"]
    assert [tuple(r) for r in found.collect()] == [(d, n, want(t, [o[1:] for o in tasks if o[0] == n], 0.5)) for d, t in texts for n in names]


def test_repeated_words_of_options_take_little_room(spark, monkeypatch):
    """More options than words still go by a dictionary: texts are not shuffled."""
    from paperfold.operators import matching

    monkeypatch.setattr(matching, "DICTIONARY_WORDS", 20)
    options = spark.range(50).selectExpr("id AS option_id", "array('a', 'b') AS words")
    docs = spark.createDataFrame([(1, ["a"]), (2, ["c"])], "doc_id int, words array<string>")
    found = matching.with_hits(docs, options, 0.5, only_ids=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.hits for r in found.collect()} == {1: list(range(50)), 2: []}


def test_fields_of_all_lineages_meet_their_records_by_shuffle(spark, sf_dir):
    """A small file may hold many records, and more fields: neither goes through the driver."""
    from __spark_entry__ import queries

    planned = queries()["typed_cells_all_lineages"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in planned and "Broadcast" not in planned


def test_replies_are_read_once(spark):
    """Rows and header values come from stored replies as read, however often they are used."""
    import json

    from paperfold.operators import extraction

    ask = lambda: lambda prompt: (json.dumps({"document": {"values": {"a": "x"}}, "rows": [{"values": {"w": w}} for w in prompt.split()]}), "!" not in prompt)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f ! g"), (3, "")], "document_id int, text string")
    records, errors = extraction.extract_documents(docs, ask, limit=4)
    for df in (records, errors):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.document_id, r.row_index, r.data.get("w")) for r in records.collect()) == [(1, i, w) for i, w in enumerate("abcde")] + [(3, 0, None)]
    assert [r.document_id for r in errors.collect()] == [2]


def test_only_an_object_is_a_reply(spark):
    from pyspark.sql import functions as F

    from paperfold.operators import extraction

    texts = [
        '{"values":{"a":"1"}}', ' \n{"rows":[]}', "{}", '{"other":1}', '[{"values":{"a":"1"}}]', "[]", "1", '"x"', "", "x", None, "null",
        '{"values":{"a":"1"}', '{"values":{"a":"1"}} x', '{"values":3}', '{"values":{"a":{"b":1}},"rows":"no"}', '{"document":{"values":{}},"rows":[1]}', "{'values':{}}",
    ]
    replies = spark.createDataFrame(list(enumerate(texts)), "id int, reply_json string")
    failed = {r.id: r.error is not None for r in extraction.parse_reply(replies, F.lit(True)).collect()}
    objects = replies.select("id", F.from_json("reply_json", "map<string,string>").isNotNull().alias("sound")).collect()
    assert failed == {r.id: not r.sound for r in objects}
