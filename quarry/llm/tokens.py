"""Token ids of whole texts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from quarry.llm.common import worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: White space of Unicode beyond ASCII, and ASCII separators that libraries disagree on.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Texts whose spaces stand next to other white space are encoded in one piece.
SPACE_RUN = re.compile(r" [ \t\n\r\x0b\x0c]|[\t\n\r\x0b\x0c] ")
#: Marks that end a word and never join its match.
MARKS = ".,;:!?"
#: Pieces kept in each of the two generations of a cache.
CACHE_PIECES = 500_000
LONGEST_PIECE = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes, in two bounded generations."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Encodes whole texts; each distinct piece between spaces goes to the library once.

    Cutting is safe where the vocabulary's own splitting always cuts: before a
    single space that follows a character which isn't white space (byte-level
    vocabularies), or at any white space (vocabularies that drop it). Other
    texts are encoded in one call. Strings of special tokens are ordinary text.
    pieces: kept in each generation of a cache (CACHE_PIECES); fewer take less
    memory and more time.
    """

    def __init__(self, path: str, pieces: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        self.spaced = kind == "ByteLevel" and not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
        self.worded = kind == "Sequence" and bool(spec["model"].get("end_of_word_suffix")) and '"Removed"' in json.dumps(spec["pre_tokenizer"])
        self.table = byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values(), default=0))]
        pieces = pieces or CACHE_PIECES
        self.heads, self.rest = Pieces(self.head, pieces), Pieces(self.after_space, pieces)
        self.words = Pieces(self.word, pieces)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def merged(self, letters: str, space: str = "") -> bytes:
        """Ids of one run of letters, after a space or none, which no splitting cuts."""
        if letters.isascii():  # these stand for themselves
            raw = self.table[32] + letters if space else letters
        else:
            raw = f"{space}{letters}".encode().decode("latin1").translate(self.table)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(raw)])

    def head(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.merged(piece)
        body = piece.rstrip(MARKS)
        if body.isalpha():  # splitting cuts between letters and marks
            return self.heads[body] + self.heads[piece[len(body) :]]
        return self.whole(piece)

    def after_space(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.merged(piece, " ")
        body = piece.rstrip(MARKS)
        if body.isalpha():
            return self.rest[body] + self.heads[piece[len(body) :]]
        line, end, other = piece.partition("\n")
        if end and line.rstrip(MARKS).isalpha() and other.rstrip(MARKS).isalpha():  # splitting cuts at both sides of a single line end
            return self.rest[line] + self.heads[end] + self.heads[other]
        return self.whole(f" {piece}")

    def word(self, piece: str) -> bytes:
        if piece.isalpha():
            # of composed Latin letters, lower case is all that normalizing does
            return self.merged(piece.lower()) if piece.isascii() or max(piece) < "İ" else self.whole(piece)
        body = piece.rstrip(MARKS)
        if body.isalpha() and (body.isascii() or max(body) < "İ"):
            return self.words[body] + self.words[piece[len(body) :]]
        return self.whole(piece)

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; nothing for a null text."""
        if not text:
            return b""
        if (self.spaced or self.worded) and not ODD_SPACE.search(text):
            if self.worded:
                return b"".join(map(self.words.__getitem__, text.split()))
            if not SPACE_RUN.search(text):
                head, *rest = text.split(" ")
                return (self.heads[head] if head else b"") + b"".join(map(self.rest.__getitem__, rest))
        return self.whole(text)


@worker_cache
def encoder(path: str, pieces: int | None = None) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, pieces)
