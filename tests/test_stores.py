"""Stores that outlive a run: identities, commits, typed views."""

import datetime as dt
import random

import pytest

from paperfold.operators import dedup, lineage, review, views
from paperfold.operators.identity_index import IdentityIndex
from paperfold.session import shared_folder
from paperfold.sources.commits import TableStore

LIVE = "id string, schema_id string, identity array<string>, created_at timestamp"
STAGED = "document_id int, schema_id string, identity array<string>"


def index(spark):
    folder = shared_folder(spark, "test-identities")
    return IdentityIndex(spark, "t_" + folder.rsplit("-", 1)[-1], folder, buckets=4)


def live_rows(seed, n):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    return [(f"r{k}", rng.choice(["s", "t"]), [rng.choice("abc"), rng.choice(["1", "12"])], day + dt.timedelta(hours=rng.randint(0, 30))) for k in range(n)]


def test_index_matches_like_the_live_table(spark):
    rows = live_rows(1, 60)
    staged = [(d, s, [a, b]) for d, (s, a, b) in enumerate((s, a, b) for s in "stu" for a in "abcd" for b in ("1", "12", "2"))]
    held = index(spark)
    for part in (rows[40:], rows[:20], rows[20:40], rows[:20]):  # out of order, and one twice
        held.append(spark.createDataFrame(part, LIVE))
    asked = spark.createDataFrame(staged, STAGED)
    want = dedup.dedup_match(asked, spark.createDataFrame(rows, LIVE)).collect()
    assert {r["document_id"]: r["matched_record_id"] for r in held.match(asked).collect()} == {r["document_id"]: r["matched_record_id"] for r in want}
    assert want


def test_values_do_not_run_together(spark):
    held = index(spark)
    held.append(spark.createDataFrame([("r", "s", ["a1", "b"], dt.datetime(2024, 1, 1))], LIVE))
    assert held.match(spark.createDataFrame([(1, "s", ["a", "1b"]), (2, "s", ["a1b", ""])], STAGED)).collect() == []


def test_a_delivery_shuffles_itself_alone(spark):
    held = index(spark)
    held.append(spark.createDataFrame(live_rows(2, 30), LIVE))
    plan = held.match(spark.createDataFrame([(1, "s", ["a", "1"])], STAGED))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_empty_deliveries(spark):
    held = index(spark)
    held.append(spark.createDataFrame([], LIVE))
    assert held.match(spark.createDataFrame([(1, "s", ["a", "1"])], STAGED)).collect() == []


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def read(store):
    return {name: sorted(r["x"] for r in rows.collect()) for name, rows in store.tables().items()}


def test_a_commit_that_fails_between_two_tables_changes_nothing(spark):
    store = TableStore(spark, shared_folder(spark, "test-store"))
    assert store.current() == (0, {}) and store.tables() == {}
    assert store.commit("first", {"records": numbers(spark, 1, 2), "links": numbers(spark, 7)}) == 1
    broken = numbers(spark, 5).selectExpr("CAST(raise_error('lost') AS INT) AS x")
    with pytest.raises(Exception, match="lost"):
        store.commit("second", {"records": numbers(spark, 3), "links": broken})
    assert read(store) == {"records": [1, 2], "links": [7]}
    # Tried again, it succeeds; tried once more, nothing happens.
    assert store.commit("second", {"records": numbers(spark, 3), "links": numbers(spark, 8)}) == 2
    assert store.commit("second", {"records": numbers(spark, 99)}) == 2
    assert read(store) == {"records": [3], "links": [8]}


def test_tables_not_changed_stay_and_readers_keep_their_version(spark):
    store = TableStore(spark, shared_folder(spark, "test-store"))
    store.commit("a", {"records": numbers(spark, 1), "links": numbers(spark, 7)})
    old = store.tables()
    store.commit("b", {"records": old["records"].selectExpr("x + 10 AS x")})
    assert [r["x"] for r in old["records"].collect()] == [1]
    assert read(store) == {"records": [11], "links": [7]}
    store.commit("c", {"links": numbers(spark)})
    store.clean(kept=1)
    assert read(store) == {"records": [11], "links": []} and store.versions() == [3]


def test_of_two_writers_the_later_fails(spark, monkeypatch):
    folder = shared_folder(spark, "test-store")
    one, two = TableStore(spark, folder), TableStore(spark, folder)
    one.commit("a", {"records": numbers(spark, 1)})
    seen = two.current()
    monkeypatch.setattr(two, "current", lambda: seen)
    one.commit("b", {"records": numbers(spark, 2)})
    with pytest.raises(OSError, match="another writer"):
        two.commit("c", {"records": numbers(spark, 3)})
    assert read(one) == {"records": [2]}


RECORD = "id string, document_id int, schema_id string, schema_version_id int, row_index int, data map<string,string>, is_duplicate_of string, created_at timestamp"


def test_a_changed_record_is_never_served_stale(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("r0", 1, "s", 1, 0, {"Total": "5"}, None, at), ("r1", 2, "s", 1, 0, {"Total": "6"}, None, at)]
    fields = spark.createDataFrame([("s", 1, 0, "Total", "number", "", False, "f_00000001", "document")], "schema_id string, version int, pos int, name string, type string, description string, required boolean, column string, scope string")
    specs = lineage.lineage_specs(fields, fields.select("schema_id", "version").distinct(), "s")
    store = views.StoredViews(spark, shared_folder(spark, "test-views"))
    with pytest.raises(ValueError):
        store.rows("v", specs)

    def totals(records):
        outcome = store.refresh("v", spark.createDataFrame(records, RECORD), specs, ["f_00000001"])
        return outcome, sorted(float(r["f_00000001"]) for r in store.rows("v", specs).collect())

    assert totals(rows) == ("built", [5.0, 6.0])
    assert totals(rows[::-1]) == ("kept", [5.0, 6.0])
    changed = [rows[0], (*rows[1][:5], {"Total": "60"}, None, at)]
    assert totals(changed) == ("built", [5.0, 60.0])
    assert totals(changed[:1]) == ("built", [5.0])


def test_scores_survive_by_row_as_by_cell(spark):
    rng = random.Random(3)
    old = [(d, r, {f: rng.choice(["a", "b", None]) for f in "xyz"}, {f: rng.random() for f in "xy"}) for d in range(5) for r in range(4)]
    new = [(d, r, {f: rng.choice([v, "b"]) for f, v in data.items() if rng.random() < 0.9} | ({"w": "n"} if r == 1 else {})) for d, r, data, _ in old]
    new += [(1, 99, {"x": "a"})]
    shape = "document_id int, row_index int, data map<string,string>"
    before, after = spark.createDataFrame(old, shape + ", data_confidence map<string,double>"), spark.createDataFrame(new, shape)
    got = {(r["document_id"], r["row_index"], f): r["data_confidence"].get(f) for r in review.surviving_row_confidence(before, after).collect() for f in r["data"]}
    cells = before.selectExpr("document_id", "row_index", "explode(data) AS (field, value)", "data_confidence").selectExpr(
        "document_id", "row_index", "field", "value", "try_element_at(data_confidence, field) AS confidence"
    )
    edited = after.selectExpr("document_id", "row_index", "explode(data) AS (field, value)", "CAST(NULL AS DOUBLE) AS confidence")
    want = {(r["document_id"], r["row_index"], r["field"]): r["confidence"] for r in review.surviving_confidence(cells, edited).collect()}
    assert got == want and any(v is not None for v in want.values()) and None in want.values()
