"""Token ids as compressed binary blocks, in ascending doc_id order.

Ids get canonical Huffman codes of limited length, built from the counts of all
ids. A block holds whole documents and can be read alone; every 256th id has its
bit offset stored, so a reader follows many stretches of a block abreast.

Layout of a folder: `code`, one row with the code length of each id (the code
words follow from them); `blocks`, one row per block with its place (part,
block), its documents' ids and lengths, the bits and the offsets. Both are
Parquet, so they are written and read wherever Spark can.

Defined results: a null or empty text is the end id alone; rows without a doc_id
come first; rows of one doc_id stand next to each other; further columns are
ignored; an empty table gives no blocks.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperfold.llm import encoding, huffman
from paperfold.session import shared_folder

END_ID = 2
# Ids after which a block is closed.
BLOCK_IDS = 1 << 18
_BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, bits binary, offsets binary"


def stored_ids(docs: DataFrame, path: str = encoding.BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (little-endian; two bytes each where the vocabulary allows)
    of every document, encoded once and written to the shared folder. Each task
    adds a row with the `counts` of its ids and nothing else."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder = encoding.byte_encoder(path)
        kind = id_kind(path)
        end = np.array([end_id], "<u4").tobytes()
        total = np.zeros(max(encoding.byte_tokenizer(path).get_vocab_size(), end_id + 1), np.int64)

        def sent(doc_ids, ids, counts):
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "ids", "counts"])

        for batch in batches:
            ids = [np.frombuffer(encoder.encode(text) + end, "<u4").astype(kind).tobytes() for text in encoding.texts_of(batch)]
            # A stretch of documents at a time: counting has a cost per vocabulary.
            for k in range(0, len(ids), 1024):
                total += np.bincount(np.frombuffer(b"".join(ids[k : k + 1024]), kind), minlength=len(total))
            yield sent(batch.column(0), ids, [None] * len(ids))
        yield sent(pa.array([None], pa.int64()), [None], [total.tobytes()])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    folder = shared_folder(docs.sparkSession, "token-ids")
    rows.mapInArrow(encode, "doc_id bigint, ids binary, counts binary").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def id_kind(path: str) -> str:
    return "<u2" if encoding.byte_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame):
    """Counts of all ids, as one array, from the counts of each task. The result has
    a row per id of the vocabulary, however large the input is."""
    import numpy as np

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                total = np.frombuffer(raw.as_buffer(), np.int64)
                met = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["id", "n"])

    counted = ids.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "id bigint, n bigint")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, folder: str, path: str = encoding.BYTE_BPE, end_id: int = END_ID) -> None:
    """Encodes every text, appends the end id and writes code and blocks to `folder`."""
    spark = docs.sparkSession
    ids = stored_ids(docs, path, end_id)
    lengths = huffman.code_lengths(id_counts(ids))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    code = spark.sparkContext.broadcast(lengths)

    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        codes = huffman.canonical_codes(code.value)
        kind = id_kind(path)
        number = 0

        def block(docs_, parts):
            bits, offsets = huffman.pack(np.concatenate(parts), code.value, codes)
            sizes = [len(x) for x in parts]
            columns = [[part], [number], [docs_], [sizes], [sum(sizes)], [bits], [offsets.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["part", "block", "doc_ids", "lengths", "n_ids", "bits", "offsets"],
            )

        held, parts, size = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(doc_id)
                parts.append(np.frombuffer(raw.as_buffer(), kind))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield block(held, parts)
                    held, parts, size, number = [], [], 0, number + 1
        if held:
            yield block(held, parts)

    ordered = ids.filter("counts IS NULL").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document."""
    code = spark.sparkContext.broadcast(_code(spark, folder))

    def decode(batches):
        import pyarrow as pa

        for place, doc_id, start, ids in _documents(batches, code.value):
            arrays = [*place, doc_id, start, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "doc_id", "start", "n_tokens", "ids"])

    return _placed(spark, folder, decode, "part int, block int, doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_checks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the blocks."""
    code = spark.sparkContext.broadcast(_code(spark, folder))

    def decode(batches):
        import zlib

        import pyarrow as pa

        for place, doc_id, start, ids in _documents(batches, code.value):
            arrays = [*place, doc_id, start, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, folder, decode, "part int, block int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _code(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/code").first().lengths)


def _documents(batches, lengths: bytes):
    """Per block: its place, doc_ids, starts inside the block and id arrays."""
    import numpy as np
    import pyarrow as pa

    table = huffman.decoding_table(np.frombuffer(lengths, np.uint8))
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.array(row["lengths"], np.int64)
            ids = huffman.unpack(row["bits"], np.frombuffer(row["offsets"], "<u4"), int(sizes.sum()), table).astype("<u4")
            ends = np.cumsum(sizes)
            place = [pa.array([row[k]] * len(sizes), pa.int32()) for k in ("part", "block")]
            yield place, pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes, pa.int64()), np.split(ids, ends[:-1])


def _placed(spark: SparkSession, folder: str, decode, schema: str) -> DataFrame:
    """Decoded documents with `start` counted from the first id of all.

    Parts lie in ascending order. The running sum over parts has one row per
    part; the one over blocks stays inside its part.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    bases = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    bases = bases.select("part", "block", (F.col("within") + F.col("ahead")).alias("base"))
    documents = blocks.mapInArrow(decode, schema)
    columns = [c for c in documents.columns if c not in ("part", "block", "doc_id", "start")]
    return documents.join(bases, ["part", "block"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), *columns)
