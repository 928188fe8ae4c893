"""Exact top-k inner products over a bit-sliced index.

Components are turned into integers, floor(scale x). Rows are laid out in blocks;
in a block, bit b of component d over all rows is one bitmap, a slice. A query's
scores are the sum of its weights times the components, computed for all rows of
a block at once by adding slices: a weight's set bits shift them, carries are kept
apart (carry-save) and resolved once at the end, a negative weight adds the
complement. The result is again a bit-sliced number, so the best rows are found
from the most significant slice downward: rows with the bit set displace the
others while enough remain. Rows equal to the end tie; they go by vec_id. Scores
are read off the slices of the chosen rows, so nothing is approximate.

Queries are laid out in chunks, and every pair of block and chunk is one unit of
work of bounded size, spread over the cluster by its pair of numbers. Each pair
returns k rows per query; a window with a group limit keeps the best k overall.

Vectors that are null, empty of numbers, or hold a null or non-finite component
take no part. Shorter vectors count as padded with zeros. Rows that share a
query's vec_id are its own; of several query rows with one vec_id the smallest
vector asks. Scores must stay below 2^62, else an error is raised. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
BLOCK_ROWS = 16_384
CHUNK_QUERIES = 512


def quantised(vector: str, scale: int) -> Column:
    """floor(scale x) per component as longs."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))


def usable(vector: str) -> Column:
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as little-endian words of 64 bits."""
    spare = -bits.shape[-1] % 64
    padded = np.concatenate([bits, np.zeros((*bits.shape[:-1], spare), dtype=bool)], axis=-1)
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


class Block:
    """The slices of some rows, ordered by vec_id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.low = values.min(axis=0)
        spread = values - self.low
        self.width = max(1, int(spread.max(initial=0)).bit_length())
        self.slices = np.stack([bitmaps((spread >> b & 1).astype(bool).T) for b in range(self.width)], axis=1)  # component, bit, word
        self.valid = bitmaps(np.ones(len(ids), dtype=bool))

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of a non-negative number per row, and what to add to it for the inner product."""
        size = min(len(weights), len(self.low))
        weights = weights[:size].tolist()
        low = self.low[:size].tolist()
        most = (1 << self.width) - 1
        height = max(1, (sum(map(abs, weights)) * most).bit_length())
        if height > 62:
            raise OverflowError("scores need more than 62 bits")
        total, carry = np.zeros((2, height + 1, self.slices.shape[2]), dtype=np.uint64)
        shift = sum(w * a for w, a in zip(weights, low))
        for d, w in enumerate(weights):
            if not w:
                continue
            term = self.slices[d]
            if w < 0:
                shift += w * most
                term = ~term
            for j in range(abs(w).bit_length()):
                if abs(w) >> j & 1:
                    top = min(height, j + self.width)
                    s, c = total[j:height], carry[j:height]
                    half = s ^ c
                    both = s & c
                    overlap = top - j
                    both[:overlap] |= half[:overlap] & term[:overlap]
                    half[:overlap] ^= term[:overlap]
                    total[j:height] = half
                    carry[j + 1 : height + 1] = both
                    carry[j] = 0
        over = np.zeros_like(total[0])
        for r in range(height):
            s, c = total[r], carry[r]
            half = s ^ c
            total[r], over = half ^ over, (s & c) | (half & over)
        return total[:height], shift

    def top(self, query: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score), the query's own rows left out."""
        total, shift = self.scores(weights)
        tied, sure = self.valid.copy(), np.zeros_like(self.valid)
        for row in range(*np.searchsorted(self.ids, [query, query + 1])):
            tied[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        for slice_ in total[::-1]:
            with_bit = tied & slice_
            count = int(np.bitwise_count(sure | with_bit).sum())
            if count > k:
                tied = with_bit
            else:
                sure = sure | with_bit
                tied = tied & ~slice_
                if count == k:
                    tied = np.zeros_like(tied)
                    break
        certain = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        boundary = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - len(certain)]  # rows are in vec_id order
        rows = np.concatenate([certain, boundary])
        bits = total[:, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)
        values = (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0) + shift
        return list(zip(self.ids[rows].tolist(), values.tolist()))

    def dump(self) -> tuple:
        return len(self.ids), self.width, self.ids.tobytes(), self.low.tobytes(), self.slices.tobytes()

    @classmethod
    def load(cls, rows: int, width: int, ids: bytes, low: bytes, slices: bytes) -> Block:
        block = cls.__new__(cls)
        block.width, block.ids, block.low = width, np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
        block.slices = np.frombuffer(slices, np.uint64).reshape(len(block.low), width, -1)
        block.valid = bitmaps(np.ones(rows, dtype=bool))
        return block


def build_index(vectors: DataFrame, rows: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Blocks of about ``block_rows`` rows from (vec_id, q), numbered from 0, and their number."""
    blocks = max(1, -(-rows // block_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows]
        if held:
            wide = max(m.shape[1] for _, m in held)
            values = np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for _, m in held])
            dump = Block(np.concatenate([i for i, _ in held]), values).dump()
            yield pa.record_batch([pa.array([v]) for v in (TaskContext.get().partitionId(), *dump)], ["block", "rows", "width", "ids", "low", "slices"])

    # dealt out evenly, so a partition is a block
    built = vectors.repartition(blocks).mapInArrow(build, "block long, rows long, width long, ids binary, low binary, slices binary")
    return stored(built, "sliced-blocks"), blocks


def chunked_queries(queries: DataFrame, rows: int, chunk_queries: int = CHUNK_QUERIES) -> tuple[DataFrame, int]:
    chunks = max(1, -(-rows // chunk_queries))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows]
        if held:
            wide = max(m.shape[1] for _, m in held)
            values = np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for _, m in held])
            ids = np.concatenate([i for i, _ in held])
            row = (TaskContext.get().partitionId(), ids.tobytes(), np.ascontiguousarray(values).tobytes())
            yield pa.record_batch([pa.array([v]) for v in row], ["chunk", "queries", "weights"])

    built = queries.repartition(chunks).mapInArrow(build, "chunk long, queries binary, weights binary")
    return stored(built, "sliced-queries"), chunks


def top_k(table: DataFrame, vector: str, is_query: Column, k: int, scale: int = SCALE, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every query row."""
    vectors = stored(table.filter(usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(vector, scale).alias("q"), is_query.alias("asks")).filter("vec_id is not null"), "sliced-vectors")
    queries = vectors.filter("asks").groupBy("vec_id").agg(F.min("q").alias("q"))
    index, blocks = build_index(vectors.select("vec_id", "q"), vectors.count(), block_rows)
    asked, chunks = chunked_queries(queries, queries.count(), chunk_queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.load(row["rows"], row["width"], row["ids"], row["low"], row["slices"])
                ids = np.frombuffer(row["queries"], np.int64)
                weights = np.frombuffer(row["weights"], np.int64).reshape(len(ids), -1)
                found = [(q, v, s) for q, w in zip(ids.tolist(), weights) for v, s in block.top(q, w, k)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    grid = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    asking = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = grid.join(asking, ["block", "chunk"]).mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
