"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut into paragraphs (lines), paragraphs into runs of words. A run ends
where a word's checksum says so, so cuts follow the content and an edit moves only
the cuts beside it; runs of about eight words are the leaves. Paragraphs gather
into sections in the same way, by their own hash. A node's hash covers its
children's, so equal roots mean equal texts, and comparing two trees from the root
down finds the branches in which they differ without looking into equal ones.

A fingerprint is the root, followed by the tree: ``root|section;section;...`` with
paragraphs separated by commas and leaves by dots, each leaf a short hash. Root and
inner hashes are those of the full leaf hashes. Likeness is the share of leaves
that two fingerprints have in common, counted with repeats and weighted by
length class: twice the common weight over the weight of both; equal roots give 1.

Null and empty texts have a tree without leaves; two of them are equal, and none is
like any other text. Very long texts are cut in one pass, and long runs without
spaces are cut at 256 characters. Rows that share a doc_id follow each other in the
order of their texts; null doc_ids come first. The only row of a table is its own
next one. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: One word in so many ends a run, one paragraph in so many a section.
RUN_WORDS = 8
SECTION_PARAGRAPHS = 16
#: Characters of text per partition of the ordered pass.
PART_CHARS = 16_000_000
PIECE = re.compile(r"[^ ]{1,256} *| +")
LEAF = 4  # bytes of a leaf's hash that the fingerprint keeps


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def leaves(paragraph: str) -> list[str]:
    """Runs of words; together they are the paragraph."""
    found, start = [], 0
    for piece in PIECE.finditer(paragraph):
        if crc32(piece[0].encode("utf-8", "surrogatepass")) % RUN_WORDS == 0:
            found.append(paragraph[start : piece.end()])
            start = piece.end()
    if start < len(paragraph):
        found.append(paragraph[start:])
    return found


def weight_class(text: str) -> int:
    """0 .. 15, the bit length of the text's length."""
    return min(15, len(text).bit_length())


def fingerprint(text: str) -> str:
    """Root and tree of one text."""
    sections, paragraphs, hashes = [], [], []
    top = hashlib.blake2b(digest_size=16)

    def close() -> None:
        sections.append(",".join(paragraphs))
        top.update(_hash(b"s" + b"".join(hashes)))
        paragraphs.clear()
        hashes.clear()

    for line in text.split("\n") if text else []:
        runs = leaves(line)
        own = [_hash(r.encode("utf-8", "surrogatepass")) for r in runs]
        whole = _hash(b"p" + b"".join(own))
        paragraphs.append(".".join(f"{weight_class(r):x}{h[:LEAF].hex()}" for r, h in zip(runs, own)))
        hashes.append(whole)
        if whole[0] % SECTION_PARAGRAPHS == 0:
            close()
    if paragraphs:
        close()
    return f"{top.hexdigest()}|{';'.join(sections)}"


def leaf_counts(print_: str) -> Counter:
    tree = print_.partition("|")[2]
    return Counter(x for x in re.split("[;,.]", tree) if x)


def _weight(counts: Counter) -> int:
    return sum(n << int(leaf[0], 16) for leaf, n in counts.items())


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the weighted share of common leaves."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    left, right = leaf_counts(a), leaf_counts(b)
    both = _weight(left) + _weight(right)
    return 2.0 * _weight(left & right) / both if both else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Section and paragraph numbers of ``a`` that ``b`` lacks: where to look for an edit."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    other = b.partition("|")[2].split(";")
    known_sections, known = set(other), {p for s in other for p in s.split(",")}
    return [
        (i, j)
        for i, section in enumerate(a.partition("|")[2].split(";"))
        if section not in known_sections
        for j, paragraph in enumerate(section.split(","))
        if paragraph not in known
    ]


def edited(text: str, after: str) -> str:
    """The last half of the text (rounded down) gives way to as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc, text: str, print_: str, after: str, after_print: str) -> tuple:
    changed = edited(text, after)
    changed_print = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, print_, changed_print, likeness(print_, changed_print), likeness(print_, after_print)


def in_order(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Documents dealt by ranges of doc_id and sorted, each part followed by the first document of the next.

    Parts begin at doc_ids that occur, so a row knows by itself whether it opens
    one; it then also goes, marked ``extra``, to the part before (the first part's
    to the last). The driver holds the first doc_id of every part.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chars, least = rows.agg(F.sum(F.length("text") + 1), F.min("key")).first()
    parts = max(1, -(-(chars or 0) // part_chars))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    firsts = sorted({least, *cuts}) if parts > 1 else [least]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = np.array(firsts, dtype=np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            part = np.searchsorted(opening, keys, side="right") - 1
            opens = np.flatnonzero(opening[part] == keys)
            rows = np.concatenate([np.arange(len(keys)), opens])
            home = np.concatenate([part, (part[opens] - 1) % len(opening)]).astype(np.int32)
            extra = np.arange(len(rows)) >= len(keys)
            taken = batch.take(pa.array(rows))
            yield pa.record_batch([*taken.columns, pa.array(home), pa.array(extra)], ["key", "doc_id", "text", "part", "extra"])

    dealt = rows.mapInArrow(deal, "key long, doc_id long, text string, part int, extra boolean")
    return dealt.repartitionById(len(firsts), F.col("part")).sortWithinPartitions("extra", "key", "text")


def compare_next(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to it and to the next document.

    One ordered pass that holds two documents at a time.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done, out = None, False, []
        fields = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for doc, extra, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                if done:
                    continue  # further rows with the next part's first doc_id
                text = text.as_py()
                print_ = fingerprint(text)
                if before is not None:
                    out.append(_compared(*before, text, print_))
                before, done = (doc, text, print_), extra
                if len(out) >= 256:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), fields)], names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), fields)], names)

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], RESULT)
    return in_order(docs, part_chars).select("doc_id", "text", "extra").mapInArrow(walk, RESULT)
