"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once, with the character offsets of
its tokens. Assistant texts are character spans in ascending order; a binary
search in the sorted token offsets gives the tokens under each, so a mask costs
no second encoding. Control strings are tokens of their own, so no token reaches
across the border of a span.

Template: `<|turn|>` role `<|says|>` text `<|end|>`. Control strings inside roles
and texts lose their first character to a two-character escape, and a backslash
is doubled, so a text can neither close a turn nor open one, and is read back
exactly.

Defined results: null roles and texts count as empty; turns are ordered by turn,
then role, then text, so repeated rows stay; rows without a conv_id form one
conversation; further columns are ignored; an empty table gives an empty result.
Memory is bounded by one conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm import encoding

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED = "assistant"
# Strings that some template or tokenizer reads as control.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", TURN, SAYS, END)
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\i"}
_PLAIN = {v[1]: k for k, v in ESCAPES.items()}
_ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_PAIR = re.compile(r"\\(.)", re.DOTALL)
# Conversations are sent on when they hold so many tokens.
_FLUSH = 200_000

_OUTPUT = "conv_id bigint, n_turns bigint, ids binary, loss_mask binary"


def escape(text: str | None) -> str:
    return _ESCAPED.sub(lambda m: ESCAPES[m[0]], text or "")


def unescape(text: str) -> str:
    return _PAIR.sub(lambda m: _PLAIN[m[1]], text)


def chat_tokenizer(path: str = encoding.BYTE_BPE):
    """The tokenizer with the template's marks as tokens, and offsets as they are."""

    def load():
        from tokenizers import AddedToken, Tokenizer, processors

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, SAYS, END)])
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        return tokenizer

    return encoding.kept(f"chat tokenizer {path}", load)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of what is to be learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def encode(turns, tokenizer):
    """Ids and loss mask (a byte per token) of one conversation."""
    import numpy as np

    text, spans = render(turns)
    encoded = tokenizer.encode(text, add_special_tokens=False)
    begins = np.array([a for a, _ in encoded.offsets], np.int64)
    mask = np.zeros(len(begins), np.uint8)
    edges = np.searchsorted(begins, np.array(spans, np.int64).reshape(-1, 2))
    for first, end in edges:
        mask[first:end] = 1
    return np.array(encoded.ids, "<u4"), mask


def format_chats(conversations: DataFrame, path: str = encoding.BYTE_BPE) -> DataFrame:
    """conv_id, n_turns, ids (little-endian unsigned 32-bit), loss_mask."""

    def conversations_of(batches):
        now, turns = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and conv_id != now:
                    yield now, turns
                    turns = []
                now = conv_id
                turns.append((role, text))
        if turns:
            yield now, turns

    def form(batches):
        import pyarrow as pa

        tokenizer = chat_tokenizer(path)

        def sent(rows):
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "n_turns", "ids", "loss_mask"],
            )

        rows, size = [], 0
        for conv_id, turns in conversations_of(batches):
            ids, mask = encode(turns, tokenizer)
            rows.append((conv_id, len(turns), ids.tobytes(), mask.tobytes()))
            size += len(ids)
            if size >= _FLUSH:
                yield sent(rows)
                rows, size = [], 0
        if rows:
            yield sent(rows)

    ordered = (
        conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(form, _OUTPUT)


def read_back(ids, mask, tokenizer) -> tuple[list[tuple[str, str]], list[str], str]:
    """Turns, learned texts and rendered text of one formatted conversation."""
    import numpy as np

    turn, says, end = (tokenizer.token_to_id(m) for m in (TURN, SAYS, END))
    marks = np.flatnonzero((ids == turn) | (ids == says) | (ids == end))
    turns, learned, rendered = [], [], []

    def text_of(a, b):
        return tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False)

    for k in range(0, len(marks), 3):
        a, b, c = (int(x) for x in marks[k : k + 3])
        role, text = text_of(a + 1, b), text_of(b + 1, c)
        rendered.append(TURN + role + SAYS + text + END)
        turns.append((unescape(role), unescape(text)))
        under = mask[b + 1 : c]
        if under.any():
            first = b + 1 + int(np.argmax(under))
            learned.append(unescape(text_of(first, first + int(under.sum()))))
    return turns, learned, "".join(rendered)


def chat_digests(formatted: DataFrame, path: str = encoding.BYTE_BPE) -> DataFrame:
    """What the formatted conversations say, read from their ids and masks."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def digest(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        tokenizer = chat_tokenizer(path)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for conv_id, raw, under in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "ids", "loss_mask")), strict=True):
                turns, learned, text = read_back(np.frombuffer(raw, "<u4"), np.frombuffer(under, np.uint8), tokenizer)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(learned)
                rows.append((conv_id, len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.mapInArrow(digest, schema)
