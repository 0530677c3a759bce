"""The table of frequent pieces comes from all documents."""

from paperfold.llm import encoding, token_counts


def test_every_task_counts(spark, monkeypatch):
    rows = [(k, f"only{k % 3} {'early' if k < 300 else 'late'} words words") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(4, "doc_id")
    table = token_counts.frequent_lengths(docs)
    assert {"early", "late", "words"} <= set(table)
    model = encoding.PieceCounter({})
    assert all(n == model.length(piece) for piece, n in table.items())
    assert set(token_counts.frequent_lengths(docs, most=1)) == {"words"}
    monkeypatch.setattr(token_counts, "HELD", 4)
    assert "words" in token_counts.frequent_lengths(docs)


def test_a_second_run_has_a_table_of_its_own(spark):
    for word in ("alpha", "beta"):
        docs = spark.createDataFrame([(1, f"{word} {word} once"), (2, None)], "doc_id bigint, text string")
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
        assert got == {1: len(encoding.piece_model().encode(f"{word} {word} once")), 2: 0}
