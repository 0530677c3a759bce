import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperfold.functions.ordering import hot_keys
from paperfold.operators import browse, confirm, extraction, lineage, matching, retrieval, scope, topics, views
from paperfold.sources import elements, sinks
from paperfold.sources.files import extension, preview_kind, read_delimited


def _fold(cells):
    """The header merge, one chunk after the other."""
    value, confidence = None, None
    for _, new, score in sorted(cells):
        if new is None:
            continue
        if value is not None and new != value:
            score = min(score, confidence)
        value, confidence = new, score
    return value, confidence


def test_header_merge_equals_the_fold(spark):
    rng = random.Random(3)
    docs = {
        d: [(c, rng.choice([None, "x", "y", "z"]), rng.randint(0, 9) / 10) for c in range(rng.randint(1, 7))]
        for d in range(60)
    }
    docs[100] = [(0, "x", 0.9), (1, "y", 0.8), (2, "y", 0.95)]
    docs[101] = [(0, "x", 0.5), (1, "y", 0.9), (2, "z", 0.8)]
    rows = [(d, c, "f", v, s) for d, cells in docs.items() for c, v, s in cells]
    cells = spark.createDataFrame(rows, "document_id int, chunk_no int, field string, value string, confidence double")
    got = {r["document_id"]: (r["value"], r["confidence"]) for r in extraction.merge_header_chunks(cells).collect()}
    want = {d: _fold(c) for d, c in docs.items()}
    assert got == {d: w for d, w in want.items() if w[0] is not None}
    assert got[100] == ("y", 0.95) and got[101] == ("z", 0.5)


def test_flatten_keeps_bare_documents_and_spreads_hot_ones(spark):
    header = spark.createDataFrame(
        [(1, {"a": "h", "b": "h"}, {"a": 0.5}), (2, {"a": "h2"}, {})],
        "document_id int, values map<string,string>, confidence map<string,double>",
    )
    rows = spark.createDataFrame(
        [(1, i, {"b": str(i)}, {"b": 0.1}) for i in range(25)],
        "document_id int, row_index int, values map<string,string>, confidence map<string,double>",
    )
    plain = sorted(map(str, extraction.flatten(header, rows).collect()))
    hot = extraction.flatten(header, rows, hot_keys(rows, ["document_id"], 5), slice_rows=4)
    assert sorted(map(str, hot.collect())) == plain and len(plain) == 26
    bare = extraction.flatten(header, rows).filter("document_id = 2").first()
    assert (bare["row_index"], bare["data"]) == (0, {"a": "h2"})
    assert extraction.flatten(header, rows).filter("row_index = 3").first()["data"] == {"a": "h", "b": "3"}


FIELDS = "schema_id int, version int, pos int, name string, type string, description string, required boolean, column string, scope string"


def _fields(spark, rows):
    return spark.createDataFrame([(1, v, p, n, t, "", False, c, s) for v, p, n, t, c, s in rows], FIELDS)


def test_rename_then_reuse_of_a_name(spark):
    fields = _fields(
        spark,
        [(1, 0, "Total", "number", "f_0000000a", None), (2, 0, "Net", "number", "f_0000000a", None),
         (3, 0, "Net", "number", "f_0000000a", None), (3, 1, "Total", "integer", "f_0000000b", None)],
    )
    specs = lineage.lineage_specs(fields, fields.select("schema_id", "version").distinct(), 1)
    assert [(s.column, s.name, s.plain) for s in specs] == [("f_0000000a", "Net", False), ("f_0000000b", "Total", False)]
    assert specs[0].branches == (("Net", (2, 3)), ("Total", (1,)))
    assert (specs[0].name_at(1), specs[1].name_at(1)) == ("Total", None)
    records = spark.createDataFrame(
        [("1", {"Total": "100"}), ("2", {"Net": "200"}), ("3", {"Net": None, "Total": "300"})],
        "id string, data map<string,string>",
    ).selectExpr(
        "id", "id AS document_id", "1 AS schema_id", "CAST(id AS INT) AS schema_version_id", "0 AS row_index", "data",
        "CAST(NULL AS STRING) AS is_duplicate_of", "current_timestamp() AS created_at",
    )
    got = {r["id"]: (r["f_0000000a"], r["f_0000000b"]) for r in views.typed_view(records, specs).collect()}
    assert {k: (None if a is None else int(a), b) for k, (a, b) in got.items()} == {"1": (100, None), "2": (200, None), "3": (None, 300)}


def test_malformed_key_stops_one_lineage(spark):
    fields = _fields(spark, [(1, 0, "A", "string", "oops", None)])
    with pytest.raises(ValueError, match="backfill_keys"):
        lineage.lineage_specs(fields, fields.select("schema_id", "version"), 1)


def test_key_assignment(spark):
    fields = _fields(spark, [(1, 0, "A", "string", "f_0000000a", None), (2, 0, "B", "string", "f_0000000a", None)])
    requests = spark.createDataFrame(
        [(1, 1, 0, "C", "f_0000000a"), (1, 1, 1, "A", None), (2, 1, 0, "A", None), (2, 1, 1, "B", None), (3, 1, 0, "X", "f_99999999"),
         (3, 1, 1, "Y", None), (4, 9, 0, "A", "f_0000000a")],
        "request_id int, schema_id int, pos int, name string, column string",
    )
    got = {(r["request_id"], r["name"]): (r["column"], r["error"]) for r in lineage.assign_column_keys(requests, fields).collect()}
    assert got[1, "C"] == ("f_0000000a", None)
    assert got[1, "A"][0] not in (None, "f_0000000a")  # the key already went to C
    assert got[2, "A"][0] == "f_0000000a" and got[2, "B"][0] != "f_0000000a"  # first by position wins
    assert got[3, "X"] == (None, "unknown key") and got[3, "Y"] == (None, "unknown key")
    assert got[4, "A"][1] is None and got[4, "A"][0] != "f_0000000a"  # a new lineage trusts no key


def test_backfill_is_idempotent(spark):
    fields = _fields(spark, [(1, 0, "A", "string", None, None), (2, 0, "A", "string", "f_0000000a", None), (3, 0, "A", "string", "x", None)])
    once = lineage.backfill_keys(fields)
    keys = [r["column"] for r in once.orderBy("version").collect()]
    assert keys[1:] == ["f_0000000a", "f_0000000a"] and keys[0] != "f_0000000a"
    assert [r["column"] for r in lineage.backfill_keys(once).orderBy("version").collect()] == keys


def _labels(names):
    seen, out = set(), []
    for name in names:
        label, n = name, 2
        while label in seen:
            label, n = f"{name} ({n})", n + 1
        seen.add(label)
        out.append(label)
    return out


def test_labels_equal_the_walk_in_catalog_order(spark):
    rng = random.Random(11)
    names = [rng.choice(["A", "A (2)", "A (2) (2)", "A (3)", "B", "C (x)"]) for _ in range(80)]
    catalog = spark.createDataFrame([(f"c{i}", n, i, 1, 0) for i, n in enumerate(names)], "column string, label string, schema_id int, first_version int, first_pos int")
    got = {r["column"]: r["label"] for r in scope.column_labels(catalog, F.floor(F.col("schema_id") / 10)).collect()}
    assert [got[f"c{i}"] for i in range(80)] == _labels(names)


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    docs = {d: rng.sample(words, rng.randint(0, 12)) for d in range(40)}
    options = {o: rng.sample([*words, "absent1", "absent2"], rng.randint(1, 6)) for o in range(30)}
    for threshold in (0.3, 0.5, 1.0):
        got = matching.overlap_candidates(
            spark.createDataFrame(list(docs.items()), "doc_id int, words array<string>"),
            spark.createDataFrame(list(options.items()), "option_id int, words array<string>"),
            threshold,
        ).collect()
        want = {
            (d, o): len(set(dw) & set(ow))
            for (d, dw), (o, ow) in itertools.product(docs.items(), options.items())
            if len(set(dw) & set(ow)) >= int(np.ceil(threshold * len(ow)))
        }
        assert {(r["doc_id"], r["option_id"]): r["shared"] for r in got} == want


@pytest.mark.parametrize("counts", [7, 4_000_000])
@pytest.mark.parametrize("share", [1, 16, 1000])
def test_dictionary_counts_shared_words(monkeypatch, counts, share):
    monkeypatch.setattr(matching, "COUNTS", counts)
    monkeypatch.setattr(matching, "COMMON_SHARE", share)
    rng = random.Random(share)
    words = [f"w{i}" for i in range(20)] + ["é", ""]
    options = [rng.sample(words, rng.randint(1, 9)) for _ in range(23)]
    texts = [None if rng.random() < 0.1 else rng.sample([*words, "other"], rng.randint(0, 15)) for _ in range(31)]
    table = pa.table({"option_id": pa.array(range(23), pa.int64()), "words": pa.array(options)})
    got = np.concatenate([c for _, c in matching.Dictionary(table, 0.5).shared(pa.array(texts, pa.list_(pa.string())))])
    assert got.tolist() == [[len(set(t or []) & set(o)) for o in options] for t in texts]


def test_options_too_many_for_a_dictionary(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["c"], "y"), (3, None, "z")], "doc_id int, words array<string>, kept string")
    options = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["c"]), (9, [])], "option_id int, words array<string>")
    rows = {}
    for limit in (2_000_000, 1):
        monkeypatch.setattr(matching, "DICTIONARY_WORDS", limit)
        found = matching.with_hits(docs, options, 0.5).collect()
        rows[limit] = {(r["doc_id"], r["kept"]): sorted((h["option_id"], h["shared"], round(h["score"], 9)) for h in r["hits"]) for r in found}
    assert rows[1] == rows[2_000_000] == {(1, "x"): [(7, 2, 0.666666667)], (2, "y"): [(8, 1, 1.0)], (3, "z"): []}
    none = matching.with_hits(docs, options.filter("option_id = 9"), 0.5).collect()
    assert [r["hits"] for r in none] == [[], [], []]


def test_texts_are_not_shuffled_to_their_options(spark):
    docs = spark.createDataFrame([(1, ["a"], None)], "doc_id int, words array<string>, chosen int")
    options = spark.createDataFrame([(7, ["a"])], "option_id int, words array<string>")
    assert "Exchange" not in matching.match_schema(docs, options)._jdf.queryExecution().executedPlan().toString()


def test_search_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 2)  # several blocks
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 4)).round(3)
    chunks = [(i, 0, ["t"] if i % 3 else ["t", "u"], base[i % 5].tolist(), ["en"] if i % 2 else []) for i in range(60)]
    asked = [(q, ["t", "u"] if q % 2 else [], rng.normal(size=4).tolist(), ["en"] if q == 1 else None) for q in range(5)]
    frame = spark.createDataFrame(chunks, "document_id int, chunk_index int, terms array<string>, embedding array<double>, topic_ids array<string>")
    got = retrieval.hybrid_search_many(frame, spark.createDataFrame(asked, "question_id int, terms array<string>, embedding array<double>, topic_ids array<string>"), 7).collect()
    n, length = 60, float(np.mean([len(c[2]) for c in chunks]))

    def bm25(terms, wanted):
        if not wanted or not set(wanted) <= set(terms):
            return 0.0
        total = 0.0
        for w in wanted:
            df = sum(w in c[2] for c in chunks)
            total += np.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(terms) / length))
        return total / (1 + total)

    for q, wanted, vector, only in asked:
        scored = []
        for doc, _, terms, point, tags in chunks:
            if only and not set(only) & set(tags):
                continue
            cos = np.dot(point, vector) / np.linalg.norm(point) / np.linalg.norm(vector)
            scored.append((-round(0.6 * cos + 0.4 * bm25(terms, wanted), 9), doc))
        want = [d for _, d in sorted(scored)[:7]]
        assert [r["document_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["question_id"] == q] == want


def test_chunks_respect_size_sections_and_text(spark):
    text = "Heading One\n" + "\n".join(f"Sentence number {i} ends here." for i in range(30)) + "\nHeading Two\n" + "x" * 250 + "."
    docs = spark.createDataFrame([(1, text)], "document_id int, text string")
    rows = retrieval.chunk_by_title(docs, max_chars=100).orderBy("chunk_index").collect()
    assert max(len(r["content"]) for r in rows) <= 100
    assert [r["section"] for r in rows] == sorted(r["section"] for r in rows) and rows[-1]["section"] == 2
    assert "".join(r["content"] for r in rows).replace("\n", "") == text.replace("\n", "")


def test_html_rows_and_blocks():
    html = "<table><tr><td> a </td><th>b</th></tr><tr></tr><td>loose</td></tr><tr><td>open</td>"
    assert elements._html_rows(html) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "loose"), (0, 2, 0, "open")]
    blocks = elements.html_blocks("<h1>T</h1><script>no()</script><p>one<br>two</p><ul><li>x</li></ul><table><tr><td>1</td></tr></table>")
    assert [(k, t) for k, t, _ in blocks] == [("Title", "T"), ("NarrativeText", "one two"), ("ListItem", "x"), ("Table", "1")]
    assert blocks[-1][2].markup() == "<table><tr><td>1</td></tr></table>"


def test_html_chunks_carry_pages(spark):
    html = "<h1>One</h1><p>" + "a" * 30 + "</p><hr><p>" + "b" * 250 + "</p><h2>Two</h2><table><tr><td>c<td>d</table>"
    docs = spark.createDataFrame([(1, html), (2, None)], "document_id int, html string")
    rows = sorted(retrieval.chunk_html(docs, max_chars=100).collect(), key=lambda r: r["chunk_index"])
    assert [(r["section"], r["page_number"], len(r["content"])) for r in rows] == [(1, 1, 35), (1, 2, 100), (1, 2, 100), (1, 2, 50), (2, 2, 8)]
    assert rows[0]["element_types"] == ["NarrativeText", "Title"] and rows[-1]["content"] == "Two\n\nc d"


def test_html_tables_inside_tables():
    html = "<table>cap<tr><td colspan=2>a &lt;b<td colspan=x>c<tr><td>d<table><tr><th>e</table>f<td><p>g</p>h</table>tail"
    assert elements._html_rows(html) == [
        (0, 0, 0, "a <b"), (0, 0, 2, "c"), (0, 1, 0, "d f"), (0, 1, 1, "g h"), (1, 0, 0, "e")
    ]
    (table, text), (_, tail) = [(b[2], b[1]) for b in elements.html_blocks(html)]
    assert (text, tail) == ("cap a <b c d e f g h", "tail")
    assert table.markup().startswith('<table><tr><td colspan="2">a &lt;b</td>')
    assert elements._html_rows("<table><caption>no rows</caption></table><td>loose") == []
    assert elements._html_rows(None) == []


def test_preview_limits_are_told(spark):
    rows = [["a", "b", "c"], ["d"], ["e"]]
    blocks = [(1, 0, "Table", "abcdef", None, None, rows), (1, 1, "Table", "none", None, None, []), (1, 2, "Title", "T", None, None, None)]
    frame = spark.createDataFrame(
        blocks, "document_id int, seq int, type string, text string, page_number int, html string, rows array<array<string>>"
    )
    whole = {r["seq"]: r for r in elements.preview_elements(frame).collect()}
    assert [whole[k]["kind"] for k in range(3)] == ["table", "text", "heading"]
    assert whole[0]["rows"] == rows and not any(r["truncated"] for r in whole.values())
    cut = {r["seq"]: r for r in elements.preview_elements(frame, 2, 3, 2, 2).collect()}
    assert set(cut) == {0, 1} and cut[0]["rows"] == [["a", "b"], ["d"]] and cut[0]["text"] == "abc"
    assert cut[0]["truncated"] and cut[1]["truncated"]


def test_delimited_files_fail_alone(spark):
    long = "x" * 300_000
    files = spark.createDataFrame([(1, f"a,{long}\n\nb,c,d"), (2, None)], "document_id int, content string")
    got = sorted(read_delimited(files).collect(), key=lambda r: r["row_no"])
    assert [r["cells"] for r in got] == [["a", long], ["b", "c", "d"]]
    cut = read_delimited(files, max_rows=1, max_columns=2).collect()
    assert [(r["cells"], r["truncated"], r["error"]) for r in cut] == [(["a", long], True, None)]


def test_replaced_table_keeps_the_old_one_until_the_swap(spark, tmp_path):
    path = str(tmp_path / "table")
    for state in ([1, 2], [3], []):
        sinks.replace_table(spark, spark.createDataFrame([(x,) for x in state], "x int"), path)
        assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == state
    (tmp_path / "table").rename(tmp_path / "table.old")  # a run that ended inside its swap
    sinks.replace_table(spark, spark.createDataFrame([(9,)], "x int"), path)
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [9]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_more_than_a_hundred_tasks(spark):
    tasks = spark.createDataFrame([(f"t{k}", 1, ["a"]) for k in range(150)], "task string, option_id int, words array<string>")
    docs = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "doc_id int, words array<string>")
    rows = matching.multi_task_classify(docs, tasks).collect()
    assert len(rows) == 300 and all(r["selected"] == ([1] if r["doc_id"] == 1 else []) for r in rows)


def test_empty_vectors_are_judged_by_text(spark):
    chunk = "document_id int, chunk_index int, content string, terms array<string>, embedding array<float>, topic_ids array<string>"
    chunks = spark.createDataFrame([(1, 0, "a", ["a"], [1.0, 0.0], []), (2, 0, "b", ["b"], [], []), (3, 0, "", [], None, [])], chunk)
    asked = spark.createDataFrame(
        [(1, ["b"], [1.0, 0.0], None), (2, ["b"], [], None)],
        "question_id int, terms array<string>, embedding array<float>, topic_ids array<string>",
    )
    many = {(r["question_id"], r["document_id"]): r["score"] for r in retrieval.hybrid_search_many(chunks, asked).collect()}
    assert many[1, 1] == 0.6 and many[1, 2] > 0 and many[1, 3] == 0 and many[2, 1] == 0 and many[2, 2] == many[1, 2]
    names = spark.createDataFrame([(k, f"f{k}") for k in (1, 2, 3)], "document_id int, filename string")
    one = {r["document_id"]: r["score"] for r in retrieval.hybrid_search(chunks, names, ["b"], [1.0, 0.0]).collect()}
    assert one == {d: many[1, d] for d in (1, 2, 3)}


def test_minutes_make_a_datetime(spark):
    cells = spark.createDataFrame([("a", "2024-01-01 10:20"), ("b", "2024-01-01"), ("c", "24 September 2026")], "field string, value string")
    assert {r["name"]: r["type"] for r in extraction.infer_schema(cells).collect()} == {"a": "datetime", "b": "date", "c": "date"}


def test_no_decision_leaves_a_dangling_pointer(spark):
    live = spark.createDataFrame([("r0", 1, "s", 1, 0, {}, None), ("r1", 1, "s", 1, 1, {}, None)], RECORD)
    staged = spark.createDataFrame([(f"{n}0", d, "s", 1, 0, {}, None) for n, d in (("a", 2), ("b", 3), ("c", 4))], RECORD)
    decisions = spark.createDataFrame(
        [(2, "r0", "replace"), (3, "r1", "keep_both"), (4, "gone", None)],
        "document_id int, matched_record_id string, decision string",
    )
    state, errors = confirm.dedup_apply(live, staged, decisions)
    rows = {r["id"]: r["is_duplicate_of"] for r in state.collect()}
    assert rows == {"r0": None, "b0": None}
    assert [r["document_id"] for r in errors.collect()] == [4]


def test_extensions_and_kinds(spark):
    names = {"a.PDF": "pdf", "b.tar.gz": "unsupported", ".bashrc": "elements", "c.": "elements", "d.csv": "elements", "dir.x/e": "elements", "f.JPeG": "image"}
    df = spark.createDataFrame([(n, None) for n in names], "filename string, mime_type string")
    assert {r[0]: r[1] for r in df.select("filename", preview_kind()).collect()} == names
    assert {r[0]: r[1] for r in df.select("filename", extension()).collect()}["b.tar.gz"] == ".gz"


RECORD = "id string, document_id int, schema_id string, schema_version_id int, row_index int, data map<string,string>, is_duplicate_of string"


def test_replace_keeps_the_matched_id(spark):
    live = spark.createDataFrame(
        [("r0", 1, "s", 1, 0, {"a": "old"}, None), ("r1", 1, "s", 1, 1, {}, None), ("z", 3, "s", 1, 0, {}, "r1"), ("o", 1, "other", 1, 0, {}, None)],
        RECORD,
    )
    staged = spark.createDataFrame([("n0", 2, "s", 2, 0, {"a": "new"}, None), ("n1", 2, "s", 2, 1, {}, None)], RECORD)
    decisions = spark.createDataFrame([(2, "r0", "replace")], "document_id int, matched_record_id string, decision string")
    state, errors = confirm.dedup_apply(live, staged, decisions)
    rows = {r["id"]: r for r in state.collect()}
    assert set(rows) == {"r0", "n1", "z", "o"} and errors.isEmpty()
    assert (rows["r0"]["document_id"], rows["r0"]["data"]) == (2, {"a": "new"})
    assert rows["z"]["is_duplicate_of"] is None  # it pointed at a stranded row


def test_scope_cannot_be_left(spark, tmp_path):
    path, other = str(tmp_path / "v"), str(tmp_path / "scope")
    spark.createDataFrame([(1, 10), (2, 20)], "document_id int, amount int").write.parquet(path)
    spark.createDataFrame([(1,)], "document_id int").write.parquet(other)
    child = scope.ScopedSession(spark, {"view_a": path}, other)
    assert child.sql("WITH c AS (SELECT * FROM view_a) SELECT sum(amount) FROM c").first()[0] == 10
    with pytest.raises(Exception):
        child.sql(f"SELECT * FROM parquet.`{path}`").collect()
    spark.sql(f"CREATE TABLE kept_elsewhere USING parquet LOCATION '{path}'")
    try:
        for statement in (
            "SET spark.sql.runSQLOnFiles=true",
            f"CREATE TEMPORARY VIEW raw USING parquet OPTIONS (path '{path}')",
            "SELECT sum(amount) FROM kept_elsewhere",
            "SELECT (SELECT sum(amount) FROM default.kept_elsewhere)",
            "WITH c AS (SELECT * FROM kept_elsewhere) SELECT * FROM c",
            "SELECT 1 WHERE EXISTS (SELECT * FROM kept_elsewhere)",
            "SELECT * FROM IDENTIFIER('kept_' || 'elsewhere')",
            "INSERT INTO kept_elsewhere SELECT * FROM view_a",
            "WITH c AS (SELECT * FROM view_a) INSERT INTO kept_elsewhere SELECT * FROM c",
            "EXECUTE IMMEDIATE 'SELECT * FROM kept_elsewhere'",
            "BEGIN SELECT * FROM kept_elsewhere; END",
            "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b')",
            "DROP VIEW view_a",
            "SHOW TABLES",
        ):
            with pytest.raises(PermissionError):
                child.sql(statement)
    finally:
        spark.sql("DROP TABLE kept_elsewhere")
    for statement in (
        "SELECT sum(amount) FROM VIEW_A v WHERE v.amount > (SELECT avg(amount) - 1 FROM view_a)",
        "WITH a AS (SELECT * FROM view_a), b AS (SELECT * FROM a) SELECT sum(b.amount) FROM b JOIN view_a USING (document_id)",
        "SELECT max(s) FROM (SELECT sum(amount) OVER (ORDER BY document_id) AS s FROM view_a) ORDER BY 1 LIMIT 3",
    ):
        assert child.sql(statement).first()[0] == 10
    assert not spark.catalog.tableExists("view_a")


def test_fallback_topic_cannot_be_deleted(spark):
    known = spark.createDataFrame([("u", "Uncategorized")], "topic_id string, name string")
    with pytest.raises(ValueError):
        topics.delete_topic("u", known, known, known, known, known, "u")
    with pytest.raises(LookupError):
        topics.delete_topic("missing", known, known, known, known, known, "u")


def test_incomplete_reply_is_an_error(spark):
    def client():
        return lambda prompt: ("{}", prompt != "cut")

    df = spark.createDataFrame([("ok",), ("cut",)], "prompt string")
    got = {r["prompt"]: (r["reply_json"], r["error"]) for r in extraction.model_map(df, client).collect()}
    assert got["ok"] == ("{}", None) and got["cut"][0] is None and "length" in got["cut"][1]


def test_stored_views_are_rebuilt_only_where_stale(spark, tmp_path):
    record = "id string, document_id int, schema_id string, schema_version_id int, row_index int, is_duplicate_of string, created_at timestamp, data map<string,string>"
    rows = [("a", 1, "s", 1, 0, None, None, {"Total": "5", "Line": "1"}), ("b", 1, "s", 1, 1, None, None, {"Total": "5", "Line": "2"})]
    records = spark.createDataFrame(rows, record)
    total = lineage.FieldSpec("f_00000001", "Total", "number", True, branches=(("Total", (1,)),))
    line = lineage.FieldSpec("f_00000002", "Line", "integer", True, "row", branches=(("Line", (1,)),))
    bad = lineage.FieldSpec("no key", "Line", "integer", True, branches=(("Line", (1,)),))
    store = views.StoredViews(spark, str(tmp_path))
    first = store.refresh_all({"one": (records, [total], ["f_00000001"]), "bad": (records, [bad], []), "two": (records, [total, line], ["f_00000001"])})
    assert first["one"] == first["two"] == "built" and first["bad"].startswith("failed")
    again = store.refresh_all({"one": (records, [total], ["f_00000001"]), "two": (records, [line, total], ["f_00000001"])})
    assert again == {"one": "kept", "two": "built"}
    assert [r["f_00000001"] for r in store.header("one", [total]).collect()] == [5]
    assert sorted(r["f_00000002"] for r in store.rows("two", [total, line]).collect()) == [1, 2]
    assert store.refresh("one", records, [total], ["f_00000001"], stamp="day 2") == "built"


def test_a_page_after_a_row_is_the_next_page(spark):
    rows = [(d, r, f"2024-01-0{1 + d % 3}") for d in range(9) for r in range(4)]
    view = spark.createDataFrame(rows, "document_id int, row_index int, day string").selectExpr(
        "document_id", "row_index", "CAST(day AS TIMESTAMP) AS created_at"
    )
    whole = browse.page_records(view, 100).collect()
    last = whole[9]
    after = browse.page_after(view, (last["created_at"], last["document_id"], last["row_index"]), 10).collect()
    assert after == whole[10:20]


def test_one_chunk_spread_over_slices(spark, monkeypatch):
    from paperfold.functions import ordering

    monkeypatch.setattr(extraction, "ROW_SLICE", 7)
    rows = [(1, c, p, {"v": None if p % 5 == 0 else "x"}) for c in (0, 1) for p in range(60)]
    frame = spark.createDataFrame(rows, "document_id int, chunk_no int, pos int, values map<string,string>")
    for hot in (10, 95, 96, 97):  # 96 rows hold a value
        monkeypatch.setattr(ordering.hot_keys, "__defaults__", (hot,))
        got = sorted(r["row_index"] for r in extraction.concat_chunk_rows(frame).collect())
        assert got == list(range(96))
