"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms of a text are its byte trigrams, hashed to a fixed number of buckets, with
damped counts weighted by rarity, and the share of words that repeat the word
before. The leading singular directions of the labelled sample make the space. Every document is placed there, its cosines to all
labelled vectors are computed exactly in blocks, and the nearest ones vote with
their label, weighted by similarity.

The labelled sample is bounded by ``PER_LABEL`` rows of each label, chosen by a
hash of doc_id; so is everything the driver holds and sends out: the directions
and the labelled vectors (under 2 MB at the defaults). Scoring is one pass without
a shuffle. Only the text enters a score.

Rows whose crc32 of doc_id as text leaves 2 modulo 4 are held out from learning,
as are labels that are null or neither 0 nor 1, and rows with a null doc_id (not
held out, scored). Null and empty texts have no direction and score 0.5, as does
every text if no label is known. Repeated rows are scored each. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash

BUCKETS = 1024
#: Counts besides the buckets: words, and words equal to the one before.
EXTRA = 2
#: Weight of the share of repeats beside a unit vector of trigrams.
REPEAT_WEIGHT = 1.0
DIMENSIONS = 48
PER_LABEL = 1500
NEIGHBOURS = 15
CUT = 0.7
#: Similarities count by this power, so that close neighbours decide.
SHARPNESS = 8


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams, then words and words equal to the one before."""
    data = (text or "").encode()
    out = np.zeros(BUCKETS + EXTRA, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), 1 << 20):
        b = np.frombuffer(data[at : at + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77)) + b[2:] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        out[:BUCKETS] += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    words = data.split()
    out[BUCKETS:] = len(words), sum(map(bytes.__eq__, words, words[1:]))
    return out


@dataclass(frozen=True)
class Space:
    """Term weights, directions, and the labelled vectors with their labels."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
        rarity = np.log((1 + len(counts)) / (1 + (counts[:, :BUCKETS] > 0).sum(axis=0))) + 1
        weighted = damped(counts, rarity)
        values, vectors = np.linalg.eigh(weighted.T @ weighted)
        directions = vectors[:, np.argsort(-values)[:dimensions]].astype(np.float32)
        return cls(rarity, directions, unit(weighted @ directions), labels.astype(np.float32))

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Votes of the nearest labelled vectors for each row of counts."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        placed = unit(damped(counts, self.rarity) @ self.directions)
        near = placed @ self.vectors.T
        k = min(neighbours, len(self.labels))
        rows = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, rows, axis=1), 0, None).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[rows]).sum(axis=1)
        return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), 0.5), 0, 1)


def damped(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    trigrams = unit((np.log1p(counts[:, :BUCKETS]) * rarity).astype(np.float32))
    repeats = REPEAT_WEIGHT * counts[:, BUCKETS + 1] / np.maximum(1, counts[:, BUCKETS])
    return unit(np.column_stack([trigrams, repeats.astype(np.float32)]))


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Space:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col(label).isin(0, 1))
    once = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    # a doc_id in the sample need not occur in the documents; those that do are drawn first
    present = docs.select("doc_id").distinct().join(once, "doc_id").withColumn("_order", order)
    drawn = [r for value in (0, 1) for r in first_by_hash(present.filter(F.col("label") == value), "_order", per_label, "doc_id").collect()]
    if not drawn:
        return Space(np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 1)), np.zeros((0, 1)), np.zeros(0))
    sample = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in drawn], "doc_id long, label int"))  # at most 2 x per_label rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [term_counts(t.as_py()).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "label", "counts"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    found = texts.select("doc_id", "text", "label").mapInArrow(counted, "doc_id long, label int, counts binary")
    first = found.groupBy("doc_id", "label").agg(F.min("counts").alias("counts")).orderBy("doc_id").collect()
    return Space.fit(np.stack([np.frombuffer(r["counts"], "<u4").astype(np.int64) for r in first]), np.array([r["label"] for r in first]))


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """All columns of the documents and ``score``; a batch of 256 texts is held at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    names = docs.columns
    target = "score" if "score" not in names else "_score"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = np.stack([term_counts(t.as_py()) for t in part.column(names.index("text"))])
                yield pa.record_batch([*part.columns, pa.array(model.scores(counts), pa.float64())], [*names, target])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(target, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    marked = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return marked.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    marked = scored(docs, fit(docs, labels))
    return marked.filter(F.col(marked.columns[-1]) >= cut).select(*docs.columns)
