"""Encoding by the tokenizers library, with the ids of pieces that recur kept per worker.

A byte-level BPE tokenizer first splits a text by a fixed pattern and then encodes each match by itself. A single
space after a character that is not white space always begins a match, whatever precedes it, so the ids of a text are
the ids of the parts cut there, one after the other. ``PieceEncoder`` cuts at such spaces, has the library encode each
distinct part once (of a word followed by punctuation, the two by themselves) and joins the results; where the tokenizer is of another kind, whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: A space that follows a character that is not white space, and one that follows white space.
CUT, UNSAFE = re.compile(r"(?<=\S) "), re.compile(r"\s ")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters that end a match of letters before them and begin one of their own; none occurs in an added token.
TAIL = ".,;:!?%&$#*"


def cuttable(path: str) -> bool:
    """Whether the tokenizer is byte-level with the usual pattern, without normalizer and added prefix space.

    Nor may an added token be found within what is encoded apart: one of letters alone, or with a sign of ``TAIL``.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    special = [t for t in spec.get("added_tokens") or [] if any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or t["content"].isalpha() or set(t["content"]) & set(TAIL)]
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not special


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """Ids of pieces, by use: of the pieces seen since the table was last full, and of those seen before that."""

    def __init__(self, encode, keep: int):
        super().__init__()
        self.encode, self.keep, self.old = encode, keep, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by the library at ``path``.

    Memory: at most 2 * ``keep`` kept pieces of at most 64 characters, besides one text and its ids.
    """

    def __init__(self, path: str, keep: int = 500_000):
        self.tokenizer, self.cut = load(path), cuttable(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # each piece comes once
        self.tails, self.first, self.later = Kept(self.ids, 10_000), Kept(lambda p: self.piece("", p), keep // 10), Kept(lambda p: self.piece(" ", p), keep)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, lead: str, piece: str) -> bytes:
        body = piece.rstrip(TAIL)
        if body and body.isalpha() and (body.isascii() or max(body) < "\u0250"):
            if len(body) < len(piece):
                return (self.later if lead else self.first)[body] + self.tails[piece[len(body) :]]
            word = lead + body  # one match of the pattern: the model alone decides
            return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return self.ids(lead + piece)

    def encode_one(self, text: str | None) -> bytes:
        """The ids of a text; a null counts as empty."""
        if not text:
            return b""
        if not self.cut:
            return self.ids(text)
        plain = text[0] != " " and text[-1] != " " and not UNSAFE.search(text)
        parts = text.split(" ") if plain else CUT.split(text)
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]
