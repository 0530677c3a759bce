"""Token counts by a two-tier lookup on the map side.

Most pieces of a text are frequent ones. Every task counts the pieces of all its
documents in a table of bounded size and gives its commonest ones; these small
tables are summed, and the lengths of the commonest pieces of the sum travel to
every worker as one compact table. A worker encodes any other piece once and
remembers it. Texts' pieces are never shuffled, only the tasks' tables, and the
table decides only what is fast: every count is exact for the whole text.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
are counted row by row; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm import encoding

TOKEN_LIMIT = 4096
# The table of frequent pieces: at most so many entries, from so many of each task.
FREQUENT = 20_000
OF_TASK = 4_000
# Different pieces a task holds while it counts; beyond them the rarer half goes.
HELD = 200_000


def frequent_lengths(
    docs: DataFrame, path: str = encoding.PIECE_BPE, most: int = FREQUENT, of_task: int = OF_TASK
) -> dict[str, int]:
    """Lengths of the `most` commonest pieces, by counts over all documents."""

    def count(batches):
        import pyarrow as pa

        seen = Counter()
        for batch in batches:
            for text in encoding.texts_of(batch):
                if text:
                    seen.update(encoding.pieces_of(text))
                    if len(seen) > HELD:
                        seen = Counter(dict(seen.most_common(HELD // 2)))
        top = [(piece, n) for piece, n in seen.most_common(of_task) if n > 1]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    def measure(batches):
        import pyarrow as pa

        counter = encoding.PieceCounter({}, path)
        for batch in batches:
            lengths = [counter.length(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32())], names=["piece", "length"])

    counted = docs.select("text").mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    common = counted.orderBy(F.desc("n"), "piece").limit(most).select("piece")
    return {row.piece: row.length for row in common.mapInArrow(measure, "piece string, length int").collect()}


def token_counts(docs: DataFrame, path: str = encoding.PIECE_BPE, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    run = uuid.uuid4().hex

    def count(batches):
        import pyarrow as pa

        # A worker keeps the counter of one run; that of an earlier one has another table.
        store = encoding.worker_store()
        if store.get("counter run") != run:
            store["counter run"], store["counter"] = run, encoding.PieceCounter(table.value, path)
        counter = store["counter"]
        for batch in batches:
            counts = [counter.count(text) for text in encoding.texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select("doc_id", _bytes().alias("n_bytes"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def _bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
