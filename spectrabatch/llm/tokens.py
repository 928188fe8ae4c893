"""Token ids of whole texts, as little-endian 32-bit bytes.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Most of
that call's time goes into cutting the text and into words seen before. For texts
in Latin-1 the cut is known in advance, so here a pattern cuts the text, every new
piece is encoded once by the tokenizer's own model, and its ids are kept. Any
other text, and any that holds the content of an added token such as
``<|endoftext|>``, goes through the tokenizer as a whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

END_ID = 2

# Unicode letters, numbers and white space within Latin-1.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
SPACES = "\t-\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: How the two public vocabularies cut a text.
CUTS = {
    "byte_bpe_50k.json": rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+",
    "word_bpe_49k.json": rf"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+",
}
LOWER = {"word_bpe_49k.json"}

#: Pieces kept per Python worker (about 100 bytes each); beyond it new ones are encoded every time.
KEPT_PIECES = 1_000_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in own}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(own)))
    return [names[b] for b in range(256)]


class _Pieces(dict):
    """Ids of each piece seen, as bytes."""

    def __init__(self, model):
        self.model, self.names = model, dict(enumerate(byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.names)
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(piece) <= KEPT_LENGTH and len(self) < KEPT_PIECES:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts with the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the tokenizer takes these out of a text before it cuts the rest
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        name = os.path.basename(path)
        self.cut = re.compile(CUTS[name]).findall if name in CUTS else None
        self.lower = name in LOWER
        self.pieces = _Pieces(self.tokenizer.model)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.cut is None or any(content in text for content in self.added):
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self.cut(text.lower() if self.lower else text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    return Encoder(path)


def end_bytes(end_id: int = END_ID) -> bytes:
    return array("I", [end_id]).tobytes()
