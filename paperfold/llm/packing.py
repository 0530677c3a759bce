"""Packing documents into sequences: dominance reduction, then best fit.

How pieces share sequences depends on their lengths alone, so the plan is made
from a histogram with at most `capacity` entries, whatever the input's size.
First, small sets that some best packing surely contains are fixed, as in the
reduction procedure of Martello and Toth: an item whose largest partner cannot
be beaten by any sum of other items. What remains is packed by best fit,
largest first. The plan says for the k-th piece of a length where it goes; the
pieces are numbered within their lengths and placed by binary search.

Defined results: a null or empty text is the end id alone; repeated rows are
packed row by row; rows without a doc_id are packed too; further columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperfold.llm import encoding
from paperfold.session import as_table

CAPACITY = 2048
END_ID = 0
# A length is numbered in so many slices, so that no length is one task's work.
SLICES = 256
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame,
    path: str = encoding.BYTE_BPE,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: only longer ones are cut, and only the first
    piece of a cut document may be shorter than `capacity`."""

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = encoding.byte_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            columns = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), encoding.texts_of(batch), strict=True):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                begins = [0, *range(first, n, capacity)]
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    part = ids[4 * a : 4 * b]
                    row = [doc_id, k, a, b - a, zlib.crc32(part), part]
                    for column, value in zip(columns, row):  # noqa: B905  ids only where asked for
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)  # noqa: B905

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


@dataclass
class Plan:
    """`moves`: (length, first rank, first sequence, offset, pieces per sequence).

    The pieces of a length from `first rank` up to its next move fill sequence
    after sequence, `pieces per sequence` in each, from `offset` on.
    """

    moves: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = {n: c for n, c in counts.items() if c > 0}
    plan = Plan()
    ranks = dict.fromkeys(left, 0)

    def place(length: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        plan.moves.append((length, ranks[length], sequence, offset, each))
        ranks[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    _fix_dominating(left, capacity, plan, place)
    plan.fixed = plan.sequences
    _best_fit(left, capacity, plan, place)
    return plan


def _sums(lengths, most: int) -> int:
    """Bit s is set if some multiset of the lengths adds up to s; s <= most."""
    reach, mask = 1, (1 << most + 1) - 1
    for n in lengths:
        step = n
        while step <= most:
            reach |= reach << step & mask
            step *= 2
    return reach


def _fix_dominating(left: dict[int, int], capacity: int, plan: Plan, place) -> None:
    """Fixes {item, partner} while no sum of other items fits the item's rest better.

    If the rest of `item` holds no sum above `partner`, whatever a packing puts
    beside the item fits where that packing has the partner, so the two may be
    swapped and nothing is lost. An item that nothing fits beside stands alone.
    The sums allow any number of repeats, which can only make a fix rarer.
    """
    again = True
    while again and left:
        again = False
        reach = _sums(left, capacity)
        for item in sorted(left, reverse=True):
            while item in left:
                rest = capacity - item
                above = reach & (1 << rest + 1) - 1
                best = above.bit_length() - 1  # the largest sum that fits: 0 if none
                if best == 0:
                    copies = left[item]
                    place(item, copies, plan.sequences, 0)
                elif best in left and best != item:
                    copies = min(left[item], left[best])
                    place(item, copies, plan.sequences, 0)
                    place(best, copies, plan.sequences, item)
                elif best == item and left[item] > 1:
                    copies = left[item] // 2
                    place(item, 2 * copies, plan.sequences, 0, each=2)
                else:
                    break
                plan.sequences += copies
                again = True


def _best_fit(left: dict[int, int], capacity: int, plan: Plan, place) -> None:
    """Best fit over groups of equal sequences: (first sequence, how many) by room."""
    rooms: dict[int, list[tuple[int, int]]] = {}

    def fill(length: int, first: int, many: int, room: int) -> None:
        """Puts the length into a group with that room until either runs out."""
        each = room // length
        whole = min(many, left[length] // each)
        offset = capacity - room
        if whole:
            place(length, whole * each, first, offset, each)
            rooms.setdefault(room - each * length, []).append((first, whole))
        if whole < many:
            rest = left.get(length, 0)
            if rest:  # fewer than one sequence takes
                place(length, rest, first + whole, offset, rest)
                rooms.setdefault(room - rest * length, []).append((first + whole, 1))
                whole += 1
            if whole < many:
                rooms.setdefault(room, []).append((first + whole, many - whole))

    for length in sorted(left, reverse=True):
        for room in sorted(r for r in rooms if r >= length):
            groups = rooms.pop(room)
            while groups and length in left:
                fill(length, *groups.pop(), room)
            if groups:
                rooms.setdefault(room, []).extend(groups)
            if length not in left:
                break
        if length in left:
            many = -(-left[length] // (capacity // length))
            first, plan.sequences = plan.sequences, plan.sequences + many
            fill(length, first, many, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset. Lengths must lie in 1..capacity."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    plan = packing_plan(counts, capacity)
    moves = pieces.sparkSession.sparkContext.broadcast(sorted(plan.moves))
    columns = pieces.columns
    ranked = _ranked(pieces)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(moves.value, np.int64).reshape(-1, 5)
        widest = int(table[:, 1].max(initial=0)) + 2
        keys = table[:, 0] * widest + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * widest + np.minimum(rank, widest - 1), "right") - 1
            k = rank - table[at, 1]
            sequence = table[at, 2] + k // table[at, 4]
            offset = table[at, 3] + k % table[at, 4] * length
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*columns, "__rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def _ranked(pieces: DataFrame) -> DataFrame:
    """`__rank`: number of the piece among those of its length, counted over slices."""
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int"))
    part = ["length", "__slice"]
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "piece")) - 1
    return sliced.withColumn("__within", within).join(offsets, part).withColumn("__rank", (F.col("__within") + F.col("__before")).cast("bigint"))


def packed_documents(docs: DataFrame, path: str = encoding.BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(as_table(token_pieces(docs, path, capacity=capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, from packed pieces with their ids.
    A sequence has at most `capacity` pieces."""
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length")
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))
