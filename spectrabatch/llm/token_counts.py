"""Token counts of every prefix of every text, stored once and asked many times.

The vocabularies meant here cut a text into words, drop white space and end each
word's last token with a mark (``</w>``). The tokens of a prefix are those of the
words it holds whole and of the part of the word it ends in, that part taken as a
word of its own.

Inside a word, dynamic programming over prefixes finds the counts. The encoding of
a prefix ends in exactly one token ``t`` such that ``t`` may follow the last token of
the shorter prefix before it; two tokens may be neighbours if merging their letters
together never joins them. So each prefix needs only the tokens that end at it (found by an
Aho-Corasick automaton) and the last tokens of shorter prefixes, once without and
once with the mark at the end. Time is linear in the length of a text, also for one
endless word, and words seen before are looked up.

What is stored per document is the change of the count at each code point, packed
(``steps``). ``tokens_of``, ``tokens_within`` and ``chars_within`` read counts of
prefixes and the longest prefix within a budget from it; no text is encoded again.

Where normalization changes a word's length (composed accents, some upper-case
letters), prefixes that end inside the word count as the one that ends before it.
Strings of added tokens inside a text are single tokens, as the library has them;
their own prefixes are ordinary text. Null text counts as empty and has no tokens.
Rows alike are counted each, null doc_ids stay null, empty tables give no rows,
other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import stored
from .tokens import CONTRACTIONS, CUTS, KEPT_LENGTH, SPACES, byte_letters, encoder

#: Words and pairs of neighbours remembered per Python worker; beyond it new ones are worked out every time.
KEPT_WORDS = KEPT_PAIRS = 500_000
INDEX = "doc_id long, n_bytes long, n_chars long, steps binary"


class _Words(dict):
    """The changes of the count along each word seen, as signed bytes; OverflowError where they don't fit."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, word: str) -> bytes:
        steps = bytes(len(word)) if word.isspace() else array("b", self.counter.changes(word)).tobytes()
        if len(word) <= KEPT_LENGTH and len(self) < KEPT_WORDS:
            self[word] = steps
        return steps


class PrefixCounter:
    """Prefix counts under the word vocabulary file at ``path``."""

    def __init__(self, path: str):
        import ahocorasick

        self.library = encoder(path)
        tokenizer = self.library.tokenizer
        model = json.loads(tokenizer.to_str())["model"]
        self.mark = model["end_of_word_suffix"]
        if not self.mark:
            raise ValueError("prefix counts need a vocabulary that marks the ends of words")
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = {letter: byte for byte, letter in self.letters.items()}
        self.halves = {a + b: (a, b) for a, b in self.ranks}
        self.whole: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)
        self.automaton = ahocorasick.Automaton()
        for letters in {token.removesuffix(self.mark) for token in model["vocab"]}:
            forms = (token if token in model["vocab"] else None for token in (letters, letters + self.mark))
            self.automaton.add_word(letters, (len(letters), *forms))
        self.automaton.make_automaton()
        self.contraction = re.compile(CONTRACTIONS).fullmatch
        cut = CUTS["word_bpe_49k.json"]
        self.cut = re.compile(cut).findall
        self.cut_all = re.compile(rf"{cut}|[{SPACES}]+").findall
        self.added = re.compile("|".join(map(re.escape, self.library.added)) or r"(?!)")

    def is_whole(self, token: str) -> bool:
        """Whether a vocabulary entry is the encoding of its own letters."""
        known = self.whole.get(token)
        if known is None:
            symbols = [*token.removesuffix(self.mark)]
            symbols[-1] = token[len(symbols) - 1 :]
            while len(symbols) > 1:
                ready = [(self.ranks[pair], at) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in self.ranks]
                if not ready:
                    break
                at = min(ready)[1]
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            known = self.whole[token] = symbols == [token]
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at a token's left (0) or right (1) end while it is merged: the part and the rank that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, ends = [], token, math.inf
            while part in self.halves:
                known.append((part, ends))
                part, ends = self.halves[part][side], self.ranks[self.halves[part]]
            known.append((part, ends))
            known.reverse()
            self.edges[side][token] = known
        return known

    def may_follow(self, before: str, token: str) -> bool:
        """Whether ``token`` is one after ``before`` (empty: at a word's start) in an encoding.

        It is unless, at some time while both are merged, the parts that meet would
        merge with each other first: at a lower rank than either goes on with, or
        at the same rank as the right one, as the leftmost pair goes first.
        """
        fits = self.is_whole(token) and (not before or self._stay_apart(self.edge(before, 1), self.edge(token, 0)))
        if len(self.neighbours) < KEPT_PAIRS:
            self.neighbours[before, token] = fits
        return fits

    def _stay_apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = self.ranks.get((a, b), math.inf)
            if rank < a_ends and rank <= b_ends and rank < math.inf:
                return False
            if a_ends == b_ends == math.inf:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, by code points."""
        if len(word) > 1 and self.contraction(word):
            return [*(sum(self.counts(part)[-1] for part in self.cut(word[:k])) for k in range(1, len(word))), self._closed(word)[-1]]
        closed = self._closed(word)
        return closed if word.isascii() else [closed[end - 1] for end in accumulate(len(c.encode()) for c in word)]

    def _closed(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, by bytes, each prefix taken as a whole word."""
        spelled = word.encode().decode("latin-1").translate(self.letters)
        last, inner, closed = [""] + [None] * len(spelled), [0] * (len(spelled) + 1), [0] * len(spelled)
        known = self.neighbours.get
        for end, (length, inside, at_end) in self.automaton.iter(spelled):
            before, stop = last[end + 1 - length], end + 1
            if inside is not None and last[stop] is None:
                fits = known((before, inside))
                if self.may_follow(before, inside) if fits is None else fits:
                    last[stop], inner[stop] = inside, inner[stop - length] + 1
            if at_end is not None and not closed[end]:
                fits = known((before, at_end))
                if self.may_follow(before, at_end) if fits is None else fits:
                    closed[end] = inner[stop - length] + 1
        return closed

    def changes(self, word: str) -> list[int]:
        found = self.counts(word)
        return [b - a for a, b in zip([0, *found], found)]

    def _plain(self, text: str) -> np.ndarray:
        """The change of the count at each code point of a text without added tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._normalized(text)
        words = self.cut_all(text.lower())
        try:
            return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int8)
        except OverflowError:
            return np.concatenate([np.array([0] * len(w) if w.isspace() else self.changes(w), np.int32) for w in words])

    def _normalized(self, text: str) -> np.ndarray:
        """The same by the library's own normalization and words."""
        from tokenizers import PreTokenizedString

        tokenizer, steps = self.library.tokenizer, np.zeros(len(text), np.int32)
        pieces = PreTokenizedString(text)
        pieces.normalize(tokenizer.normalizer.normalize)
        tokenizer.pre_tokenizer.pre_tokenize(pieces)
        for spelled, (start, end), _ in pieces.get_splits("original", "char"):
            word = bytes(map(self.bytes.__getitem__, spelled)).decode()
            changes = self.changes(word)
            if len(word) == end - start and all(a.lower() == b for a, b in zip(text[start:end], word)):
                steps[start:end] += changes
            else:
                steps[end - 1] += sum(changes)
        return steps if abs(steps).max(initial=0) > 127 else steps.astype(np.int8)

    def steps(self, text: str) -> np.ndarray:
        """The change of the count at each code point."""
        parts, at = [], 0
        for found in self.added.finditer(text):
            before, inside = found.start() - at, len(found[0]) - 1
            counted = self._plain(text[at : found.end()]).astype(np.int32)[: before + inside]
            counted = np.append(counted, 1 - counted[before:].sum())
            parts.append(counted)
            at = found.end()
        rest = self._plain(text[at:])
        return np.concatenate([*parts, rest]) if parts else rest


def pack(steps: np.ndarray) -> bytes:
    """Steps as bytes: the width of a number, then the numbers, compressed."""
    steps = np.ascontiguousarray(steps, steps.dtype.newbyteorder("<"))
    return bytes([steps.itemsize]) + zlib.compress(steps.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    """Tokens of each prefix, the empty one first."""
    steps = np.frombuffer(zlib.decompress(packed[1:]), f"<i{packed[0]}")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter per vocabulary and Python worker."""
    return PrefixCounter(path)


def prefix_index(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars and the packed steps of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([pack(count.steps(t)) for t in texts], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_chars", "steps"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, INDEX)


@F.pandas_udf(LongType())
def tokens_of(steps: pd.Series) -> pd.Series:
    """Tokens of the whole text."""
    return steps.map(lambda s: int(unpack(s)[-1]))


@F.pandas_udf(LongType())
def tokens_within(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` code points (of the whole text, if it is shorter)."""
    return pd.Series([int((found := unpack(s))[min(max(n, 0), len(found) - 1)]) for s, n in zip(steps, chars)], dtype="int64")


@F.pandas_udf(LongType())
def chars_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix with at most ``budget`` tokens (null if the budget is negative)."""
    return pd.Series([int(fits[-1]) if len(fits := np.flatnonzero(unpack(s) <= b)) else None for s, b in zip(steps, budget)], dtype="Int64")


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Answers from the stored index: tokens of each row, whether they pass ``limit``, and the code points that fit within it."""
    index = stored(prefix_index(docs, path), "token-counts")
    return index.select("doc_id", "n_bytes", tokens_of("steps").alias("n_tokens"), chars_within("steps", F.lit(limit)).alias("limit_chars")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
