"""Token ids of whole texts, by the tokenizers library.

Words repeat, so a text is cut at blanks where the tokenizer's own
pre-tokenizer always ends a token, each distinct piece is encoded once, and a
document's ids are joined from its pieces. Where a cut could change the result
(blanks after white space, special tokens, control characters that the two
sides class differently) the whole text is encoded in one go. Both ways give
the ids of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Pieces that a worker remembers; further ones are encoded each time.
REMEMBERED = 1_000_000
#: Ends of words that are tokens of their own after a letter.
MARKS = ".,!?;:"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces, encoded when first asked for. ``before`` is what precedes each piece in the text.

    A piece of letters alone is one pre-token, so the tokenizer's model is
    asked directly; letters are those below U+0250, on whose class, case and
    normal form all sides agree. Other pieces take the tokenizer's full path.
    """

    def __init__(self, tokenizer, before: str, lower: bool, remembered: int):
        super().__init__()
        self.tokenizer, self.before, self.lower, self.remembered = tokenizer, before, lower, remembered
        self.model, self.letters = tokenizer.model, byte_letters()
        self.marks = {m: self._ids(m) for m in MARKS}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and max(piece) < "ɐ" and "İ" not in piece:
            one = self.before + (piece.lower() if self.lower else piece)
            one = one.encode().decode("latin-1").translate(self.letters)
            out = array("I", [t.id for t in self.model.tokenize(one)]).tobytes()
        # A letter and a mark never share a token; what counts is the letter as it is normalised, since that of İ ends in a combining dot.
        elif len(piece) > 1 and piece[-1] in self.marks and piece[-2] < "ɐ" and (piece[-2].lower()[-1] if self.lower else piece[-2]).isalpha():
            out = self[piece[:-1]] + self.marks[piece[-1]]
        else:
            out = self._ids(self.before + piece)
        if len(self) < self.remembered:
            self[piece] = out
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``words``: the tokenizer drops white space, so texts are cut at any of it.
    """

    def __init__(self, path: str, words: bool = False, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.unsafe = re.compile(r"[\x1c-\x1f]|<\|") if words else re.compile(r"\s |<\|")
        self.known = _Pieces(self.tokenizer, "" if words else " ", words, remembered)

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if self.unsafe.search(text):
            return self.known._ids(text)
        get = self.known.__getitem__
        if self.words:
            return b"".join(map(get, text.split()))
        first, *rest = text.split(" ")
        return (self.known._ids(first) if first else b"") + b"".join(map(get, rest))


@lru_cache(maxsize=4)
def encoder(path: str, words: bool = False) -> Encoder:
    """This worker's encoder for a file."""
    return Encoder(path, words)
