"""Tokenizing inside Spark tasks: exact pieces, and caches that live as long as a worker.

Both tokenizers cut a text at white space before they merge anything, so a text
may be cut there first and each piece looked up. A piece is a run of white space
and the run of other characters behind it; no piece of either vocabulary reaches
across such a border. Pieces repeat, so most of them come out of a dictionary
and only unseen ones meet the tokenizer.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

# Pieces a worker remembers in each of two generations.
REMEMBERED = 400_000

# The characters with the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_SPACES = frozenset(["", *map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])])
_BLANKS = re.compile(r" +[^ ]*")


def worker_store() -> dict:
    """A dictionary that stays while a Python worker lives.

    Package code travels to workers by value, so its own globals do not last
    from task to task.
    """
    return sys.modules.setdefault("__paperfold_worker__", types.ModuleType("__paperfold_worker__")).__dict__


def kept(key: str, make: Callable):
    store = worker_store()
    if key not in store:
        store[key] = make()
    return store[key]


class _Remembering(dict):
    """`make(piece)` for pieces not seen yet. Bounded: when full, what is held
    becomes the older generation, and a piece asked for again comes back."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, piece):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(piece)
        self[piece] = value = self.make(piece) if value is None else value
        return value


def byte_tokenizer(path: str = BYTE_BPE):
    """The tokenizer of `path`, loaded once a worker, on one thread."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return kept(f"tokenizer {path}", load)


class ByteEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the
    tokenizer's own `encode(text, add_special_tokens=False)`."""

    def __init__(self, path: str = BYTE_BPE):
        import struct

        from tokenizers import pre_tokenizers

        self._tokenizer = byte_tokenizer(path)
        self._merge = self._tokenizer.model.tokenize
        self._pack = [struct.Struct(f"<{n}I").pack for n in range(64)]
        # Keys of pieces come without the blank in front, except those that begin a line.
        self._known = _Remembering(self._piece)
        self._firsts = _Remembering(self._encode, 50_000)
        self._words = _Remembering(self._word)
        show = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._letters = {c: show(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()}
        self._shown = {ord(c): shown for c, shown in self._letters.items()}
        self._blank = show(" ")[0][0]
        self._marks = {c: self._encode(c) for c in "\n.,"}

    def _encode(self, text: str) -> bytes:
        import numpy as np

        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a blank and a word of Latin-1 letters, which the tokenizer's own
        pattern takes whole; None for anything else."""
        if not word.isalpha():
            return None
        if word.isascii():
            return self._merged(self._blank + word)
        if any(c > "\x7f" and c not in self._letters for c in word):
            return None
        return self._merged(self._blank + word.translate(self._shown))

    def _merged(self, shown: str) -> bytes:
        ids = [token.id for token in self._merge(shown)]
        return self._pack[len(ids)](*ids) if len(ids) < 64 else b"".join(self._pack[1](i) for i in ids)

    def _piece(self, piece: str) -> bytes:
        newline = piece[:1] == "\n"
        mark = self._marks.get(piece[-1:])
        word = piece[newline : -1 if mark else None]
        if newline:
            ids = None if not (word.isascii() and word.isalpha()) else self._marks["\n"] + self._merged(word)
        else:
            # Only a word with a mark meets the same word again.
            ids = self._words[word] if mark else self._word(word)
        if ids is None:
            return self._encode(piece if newline else " " + piece)
        return ids + mark if mark else ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "\u180e" in text:  # white space to some libraries only
            return self._encode(text)
        known = self._known
        lines = text.replace("\n", " \n")
        even = "  " not in lines and "\n " not in lines and text[0] not in " \n" and text[-1] not in " \n"
        # Printable text has no white space but blanks.
        if even and (lines.isprintable() or lines.replace("\n", "").isprintable()):
            first, *rest = lines.split(" ")
            return self._firsts[first] + b"".join(map(known.__getitem__, rest))
        # A piece behind one blank is a key; any other run of white space is encoded as it is.
        return b"".join(
            known[p[1:]] if p[0] == " " and p[1:2] not in _SPACES else self._encode(p) for p in _PIECES.findall(text)
        )


def byte_encoder(path: str = BYTE_BPE) -> ByteEncoder:
    return kept(f"encoder {path}", lambda: ByteEncoder(path))


class PieceCounter:
    """Token counts of whole texts under a sentencepiece model, in two tiers.

    `frequent` (sent to every worker) answers common pieces; the others are
    encoded and remembered. A key is a piece without its first blank, or a
    piece that begins with a newline.
    """

    def __init__(self, frequent: dict[str, int], path: str = PIECE_BPE):
        self._model = piece_model(path)
        self._known = _Remembering(self._missing)
        self._frequent = frequent

    def length(self, piece: str) -> int:
        if not piece:
            return 1
        # The model sets a blank in front of whatever it encodes; in front of a
        # newline that blank is a token of its own and not part of the text.
        return len(self._model.encode(piece, num_threads=1)) - piece.startswith("\n")

    def _missing(self, piece: str) -> int:
        n = self._frequent.get(piece)
        return self.length(piece) if n is None else n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "\u2581" in text:  # the model's own sign for a blank
            return len(self._model.encode(text, num_threads=1))
        return sum(map(self._known.__getitem__, pieces_of(text)))


def pieces_of(text: str) -> list[str]:
    """Keys of all pieces of a text for `PieceCounter`.

    A piece is a word without the blank in front of it (an empty one stands for
    that blank alone) or a newline with what follows up to the next border.
    """
    lines = text.replace("\n", " \n")
    if text[0] not in " \n" and "  " not in lines:
        return lines.split(" ")
    keys = []
    for piece in _BLANKS.findall(" " + text):
        word, *lines = piece[1:].split("\n")
        keys.append(word)
        keys += ["\n" + line for line in lines]
    return keys


def piece_model(path: str = PIECE_BPE):
    def load():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    return kept(f"model {path}", load)


def texts_of(batch, column: str = "text") -> Iterable[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
