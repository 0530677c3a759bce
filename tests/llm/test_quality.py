"""Cross-document line frequency on rows where lines are removed."""

import re
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from paperfold.llm import queries, quality, sql

LINE = "Home News Contact us imprint and privacy 2024 all pages"
OWN = "text {0} says {0}a {0}b {0}c {0}d {0}e {0}f {0}g {0}h {0}i {0}j {0}k"


def word(k):
    """A word of its own for each number, without digits, which lines read as 0."""
    return "".join(chr(97 + int(c)) for c in str(k)) + "q"


def documents(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, s, t in rows], schema)


def hosts():
    """(doc_id, source, text): a line in 15 of 40, in 15 of 1,600 and in 9 of 20 documents."""
    out = []
    for base, source, size, carriers in ((0, "mid", 40, 15), (10_000, "big", 1_600, 15), (20_000, "few", 20, 9)):
        for k in range(size):
            own = OWN.format(source + word(k))
            out.append((base + k, source, f"{LINE}\n{own}" if k < carriers else own))
    # Little but the line, and copies of one text, which count once.
    out += [(30_000 + k, "mid", f"{LINE}\nonly {word(k)} words here") for k in range(2)]
    out += [(31_000 + k, "big", OWN.format("copied")) for k in range(30)]
    return out


def by_hand(rows):
    """removed words of each doc_id, by the definition."""

    def lines(text):
        return [re.sub("[0-9]", "0", " ".join(line.split())).lower() for line in (text or "").split("\n") if line.strip()]

    texts, carriers, first = defaultdict(set), defaultdict(set), {}
    for doc_id, source, text in rows:
        texts[source].add(text)
        for line in lines(text):
            carriers[source, line].add(text)
            first[source, line] = min(doc_id, first.get((source, line), doc_id))
    removed = Counter()
    for doc_id, source, text in rows:
        for line in lines(text):
            n = len(carriers[source, line])
            if n > 10 and 100 * n > len(texts[source]) and doc_id != first[source, line]:
                removed[doc_id] += len(line.split())
    return removed


def test_limit_follows_the_size_of_the_host(spark):
    rows = hosts()
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    want = by_hand(rows)
    assert {d: r.removed_words for d, r in got.items()} == {d: want[d] for d, _, _ in rows}
    assert got[0].removed_words == 0 and got[1].removed_words == 10 and got[1].kept
    assert got[10_001].removed_words == got[20_001].removed_words == 0
    assert got[30_000].depleted and got[30_001].depleted and not got[30_000].kept


def test_stage_drops_depleted_documents(spark):
    rows = hosts()
    kept = {r.doc_id for r in quality.kept_documents(documents(spark, rows)).collect()}
    assert kept == {d for d, _, _ in rows} - {30_000, 30_001}


def test_twin_where_lines_are_removed(spark, tmp_path):
    rows = [(k, "mid", f"{LINE}\n{OWN.format(word(k))}") for k in range(quality.HOST_FLOOR + 5)]
    rows += [(1_000 + k, "mid", f"{LINE}\nonly {word(k)} words here") for k in range(2)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(sql.QUALITY)
    assert got.columns == [c[0] for c in want.description]
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(want.fetchall())
    assert sum(r[6] > 0 for r in found) == len(rows) - 1 and sum(r[8] for r in found) == 2


def test_copies_across_hosts_fall_to_one(spark):
    stages = dict(corpus_pipeline.STAGES)
    rows = [(k, "hot", f"{LINE}\n{OWN.format(word(k))}") for k in range(20)]
    # Copies of a later carrier and of the first one, in a small host and in the hot one.
    rows += [(100, "small", rows[5][2]), (101, "small", rows[0][2]), (102, "hot", rows[0][2])]
    docs = documents(spark, rows)
    passed = stages["quality_rules"](spark, docs, "")
    assert sorted(map(tuple, passed.collect())) == sorted(map(tuple, docs.collect()))
    kept = stages["exact_duplicates"](spark, passed, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_lines_are_removed_on_request(spark):
    rows = [(k, "hot", f"{LINE}\n{OWN.format(word(k))}") for k in range(20)] + [(100, "small", LINE), (101, "hot", None)]
    got = {r.doc_id: r for r in quality.without_furniture(documents(spark, rows)).collect()}
    assert {d: got[d].text for d, _, _ in rows} == {
        d: OWN.format(word(d)) if 0 < d < 20 else t for d, _, t in rows
    }
    assert got[3].n_chars == len(got[3].text) and len(got) == len(rows)


def test_each_row_is_judged_by_itself(spark):
    carriers = [(k, "h", f"{LINE}\n{OWN.format(word(k))}") for k in range(30)]
    # Sixty percent of this document remain, however often its row is repeated.
    repeated = [(40, "h", f"{LINE}\nfifteen words of its own remain here so that this text is not ever called depleted")] * 3
    no_id = [(None, "h", f"{LINE}\n{OWN.format('none')}"), (None, "h", "short")]
    docs = documents(spark, carriers + repeated + no_id)
    got = quality.quality_rules(docs).collect()
    assert len(got) == 35
    assert [(r.removed_words, r.kept) for r in got if r.doc_id == 40] == [(10, True)] * 3
    assert sorted((r.n_words > 1, r.removed_words, r.kept) for r in got if r.doc_id is None) == [(False, 0, False), (True, 10, True)]
    kept = [tuple(r) for r in quality.kept_documents(docs).collect()]
    assert len(kept) == 34 and not any(r[0] is None and r[1] == "short" for r in kept)


def test_repeated_and_null_rows_equal_the_twin(spark, tmp_path):
    rows = [(k % 25, "mid", f"{LINE}\n{OWN.format(word(k))}") for k in range(40)] + [(3, "mid", f"{LINE}\nshort")] * 2
    rows += [(None, "mid", f"{LINE}\nshort")] * 2 + [(None, None, None), (7, "mid", f"{LINE}\n{LINE}")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_quality_rules"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(sql.QUALITY).fetchall()))
