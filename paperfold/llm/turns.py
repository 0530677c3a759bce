"""Conversation structure repair: a run-length dynamic programme over roles and faults.

A repaired conversation reads system?, then user and assistant by turns, ending
with an assistant, or is empty. Each row is one symbol: what its role and fault
allow. Equal consecutive symbols collapse into runs. A symbol moves the four
states of the target pattern by a min-plus matrix; a run of n rows moves them by
its n-th power, put together from the cached powers 1, 2, 4, ... of the symbol's
matrix. The costs of finishing are carried from the last run to the first; then
the choices are unrolled from the first row on, the ASCII-least letter first.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty
turn 2; a truncated row that stays adds 1; blank and duplicate rows must go. The
audit is the edits' initials in order.

Spark finds the duplicates: equal rows of one turn collapse to one with a count
before they are shuffled, and the first turn of each role and text is an
aggregate. A conversation's symbols and then its texts stream through one task
in order, since its hash is sequential. That task holds the runs (nine bytes each)
and the audit, which is one cell of the result anyway, but never its texts.

Defined results: nulls count as one space (also in the key of the damage); rows
are ordered by turn, null turns first, then role, then a digest of the text; rows
without a conv_id form one conversation; repeated rows are duplicates; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.encoding import worker_store
from paperfold.session import as_table

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
_FAR = 1 << 60
# States: nothing yet, after system, after user, after assistant.
STATES = 4
ACCEPTED = (0, 3)
_NEXT_INSERTED = (2, 2, 3, 2)
_AFTER_ROLE = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
_NAMES = {2: "user", 3: "assistant"}
# Adjacent role initials that are right.
LEGAL = ("su", "ua", "au")
# Symbols: the role's class in lower case, in upper case where the row is truncated; x must go.
MUST_GO = "x"
SYMBOLS = "suaoSUAOx"
# Runs unrolled at a time.
BLOCK = 4096

OUTPUT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, letters ascending."""
    out = [("D", DELETE, state)]
    if symbol == MUST_GO:
        return out
    more = CUT_OFF if symbol.isupper() else 0
    kept = _AFTER_ROLE[symbol.lower()][state]
    if kept is not None:
        out.append(("K", KEEP + more, kept))
    return [*out, ("R", REROLE + more, _NEXT_INSERTED[state])]


def matrix(symbol: str) -> tuple:
    """Least cost from state to state over one row, with insertions before it."""
    rows = []
    for start in range(STATES):
        best, state, paid = [_FAR] * STATES, start, 0
        for _ in range(STATES):
            for _, cost, to in moves(symbol, state):
                best[to] = min(best[to], paid + cost)
            state, paid = _NEXT_INSERTED[state], paid + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def times(a: tuple, b: tuple) -> tuple:
    """The min-plus product."""
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(min(x + y for x, y in zip(row, c, strict=True)), _FAR) for c in columns) for row in a)


def power(symbol: str, k: int) -> tuple:
    """The matrix of 2 ** k rows of a symbol, kept while the worker lives."""
    held = worker_store().setdefault("turn powers", {})
    if (symbol, k) not in held:
        held[symbol, k] = times(power(symbol, k - 1), power(symbol, k - 1)) if k else matrix(symbol)
    return held[symbol, k]


def before(symbol: str, n: int, after: tuple) -> tuple:
    """Costs of finishing from each state ahead of `n` rows of a symbol, given those behind them."""
    k = 0
    while n:
        if n & 1:
            after = tuple(min(x + y for x, y in zip(row, after, strict=True)) for row in power(symbol, k))
        n, k = n >> 1, k + 1
    return after


def ending() -> tuple:
    """Costs of finishing behind the last row."""
    costs = []
    for state in range(STATES):
        paid = 0
        while state not in ACCEPTED:
            state, paid = _NEXT_INSERTED[state], paid + INSERT
        costs.append(paid)
    return tuple(costs)


def unroll(symbol: str, n: int, state: int, after: tuple) -> tuple[str, int]:
    """The letters of `n` rows of a symbol and the state behind them, by halves."""
    if n > 1:
        half = n // 2
        first, state = unroll(symbol, half, state, before(symbol, n - half, after))
        second, state = unroll(symbol, n - half, state, after)
        return first + second, state
    ahead, letters = before(symbol, 1, after), ""
    while True:
        choices = moves(symbol, state)
        options = [choices[0], ("I", INSERT, None), *choices[1:]]
        for letter, cost, to in options:
            rest = ahead[_NEXT_INSERTED[state]] if letter == "I" else after[to]
            if cost + rest == ahead[state]:
                break
        letters += letter
        if letter != "I":
            return letters, to
        state = _NEXT_INSERTED[state]


class Runs:
    """(symbol, rows) runs in nine bytes each; equal neighbours join."""

    def __init__(self):
        from array import array

        self.symbols, self.lengths = bytearray(), array("q")

    def add(self, symbol: str, n: int) -> None:
        if self.symbols and chr(self.symbols[-1]) == symbol:
            self.lengths[-1] += n
        else:
            self.symbols.append(ord(symbol))
            self.lengths.append(n)

    def __len__(self) -> int:
        return len(self.symbols)

    def between(self, start: int, end: int) -> list[tuple[str, int]]:
        return [(chr(s), n) for s, n in zip(self.symbols[start:end], self.lengths[start:end], strict=True)]


def repair(runs: Runs) -> tuple[int, str]:
    """Least cost and audit. Costs of finishing are held at the ends of blocks of
    runs; those inside a block are made again when it is unrolled."""
    blocks = [(k, min(k + BLOCK, len(runs))) for k in range(0, len(runs), BLOCK)]
    ends = [ending()]
    for start, end in reversed(blocks):
        after = ends[-1]
        for symbol, n in reversed(runs.between(start, end)):
            after = before(symbol, n, after)
        ends.append(after)
    cost, state, letters = ends.pop()[0], 0, []
    for start, end in blocks:
        block, behind = runs.between(start, end), [ends.pop()]
        for symbol, n in reversed(block[1:]):
            behind.append(before(symbol, n, behind[-1]))
        parts = []
        for symbol, n in block:
            part, state = unroll(symbol, n, state, behind.pop())
            parts.append(part)
        letters.append("".join(parts))
    while state not in ACCEPTED:
        letters.append("I")
        state = _NEXT_INSERTED[state]
    return cost, "".join(letters)


class Repaired:
    """Follows an audit row by row and hashes the turns it leaves."""

    def __init__(self, audit: str):
        from hashlib import sha256

        self.audit, self.at, self.state, self.hash, self.first = audit, 0, 0, sha256(), True

    def _turn(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _NEXT_INSERTED[self.state]
            self._turn(_NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _AFTER_ROLE[role[:1]][self.state]
            self._turn(role, text)
        elif letter == "R":
            self.state = _NEXT_INSERTED[self.state]
            self._turn(_NAMES[self.state], text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows after damage by crc32 of `conv_id:turn`."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    code = F.pmod(F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        said["role"].alias("role"),
        said["text"].alias("text"),
        code.alias("code"),
    )
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("code <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, copies, symbol, faults of different rows.

    `symbol` is that of the first copy; of a row seen earlier, or blank, all go.
    """
    text = F.col("text")
    marked = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2(text, 256)).alias("content"),
        "copies",
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    once = marked.groupBy("conv_id", "turn", "role", "content").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
    )
    once = as_table(once, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    first = once.filter("NOT blank").groupBy("conv_id", "role", "content").agg(F.min(place).alias("first"))
    first = first.toDF("first_conv", "first_role", "first_content", "first")
    same = (
        F.col("conv_id").eqNullSafe(F.col("first_conv"))
        & (F.col("role") == F.col("first_role"))
        & (F.col("content") == F.col("first_content"))
    )
    told = once.join(first, same, "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    seen = ~F.col("first").eqNullSafe(place)
    fault = F.when(F.col("blank"), "b").when(seen, "d").when(F.col("truncated"), "t").otherwise("")
    return told.select("conv_id", "turn", "role", "content", "copies", kind.alias("kind"), fault.alias("fault"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The verdict on each conversation of `rows` (conv_id, turn, role, text, copies).

    Symbols of a conversation come to its task first, then its texts, both in
    order: the audit is known when the first text arrives.
    """
    marks = symbols(rows).select(
        "conv_id", F.lit(0).alias("part"), "turn", "role", "content", "copies", "kind", "fault", F.lit(None).cast("string").alias("text")
    )
    texts = rows.select(
        "conv_id",
        F.lit(1).alias("part"),
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("content"),
        "copies",
        F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("fault"),
        "text",
    )
    ordered = (
        marks.unionByName(texts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "turn", "role", "content")
        .select("conv_id", "part", "turn", "role", "copies", "kind", "fault", "text")
    )

    def judge(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in OUTPUT.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in OUTPUT.split(", ")]

        def sent(done):
            columns = zip(*done, strict=True) if done else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        now, one = None, None
        for batch in batches:
            done = []
            for conv_id, part, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if one is None or conv_id != now:
                    if one is not None:
                        done.append(one.verdict(now))
                    now, one = conv_id, _Conversation()
                (one.text if part else one.mark)(*row)
            if done:
                yield sent(done)
        if one is not None:
            yield sent([one.verdict(now)])

    return ordered.mapInArrow(judge, OUTPUT)


class _Conversation:
    """One conversation while its rows pass by."""

    def __init__(self):
        self.runs, self.counts, self.illegal, self.last = Runs(), {"b": 0, "d": 0, "t": 0}, 0, None
        self.low = self.high = self.turn = None
        self.turns, self.cost, self.repaired = 0, 0, None

    def mark(self, turn, role, copies, kind, fault, text) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        if self.last is not None and self.last + kind not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.last = kind
        again = 0 if fault in ("b", "d") else copies - 1
        if fault:
            self.counts[fault] += copies - again
        self.counts["d"] += again
        symbol = MUST_GO if fault in ("b", "d") else kind.upper() if fault == "t" else kind
        for letter, n in ((symbol, copies - again), (MUST_GO, again)):
            if n:
                self.runs.add(letter, n)

    def _settle(self) -> None:
        if self.repaired is None:
            self.cost, audit = repair(self.runs)
            self.runs, self.repaired = None, Repaired(audit)

    def text(self, turn, role, copies, kind, fault, text) -> None:
        self._settle()
        for _ in range(copies):
            self.repaired.row(role, text)

    def verdict(self, conv_id):
        self._settle()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (self.counts[f] for f in "bdt")
        return (conv_id, gaps, *counts, self.illegal, self.cost, self.repaired.audit, self.repaired.digest())


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damages a table of conversations by rule and repairs it: a verdict on every conversation.

    A conversation that loses all its rows has zeros, an empty audit and the hash
    of nothing.
    """
    found = repaired_conversations(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("all_id")).distinct()
    counts = "gaps blank duplicate truncated illegal cost".split()
    return every.join(found, F.col("all_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("all_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
