"""Token-ID files: every id in the fewest bits that hold the vocabulary.

A file holds the documents of one range of doc_id in ascending order:

    block 0, block 1, ...  equal length: 12-byte head, ids at ``width`` bits, line end
    index                  doc_id, missing flag and first id of every document
    footer                 32 bytes, see ``FOOTER``

All blocks but the last hold ``block_ids`` ids, so block k starts at byte
k x stride and a reader reaches any id without reading what precedes it. Eight ids
fill exactly ``width`` bytes, which lets numpy pack and unpack whole blocks.

Files are written by Spark's text writer (one record per block, each closed by the
line end that is part of the format) and read by Spark's binary reader, so they
live in any store Spark reaches, and its commit protocol covers lost executors.

Documents with null text count as empty and get the end id alone. Rows that share
a doc_id keep the order of their texts; a null doc_id comes first. An empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import stored, text_or_empty

BLOCK_IDS = 65_536
#: Characters of text per file.
FILE_CHARS = 32_000_000
HEAD = struct.Struct("<4sBxxxI")  # mark, width, ids
FOOTER = struct.Struct("<4sBxxxIIQQ")  # mark, width, shard, ids per block, ids, documents
MARK, END = b"TIDB", b"\n"


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids at ``width`` bits each, low bits first, padded to a multiple of eight ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    groups = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), dtype=np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = groups[:, j] << np.uint64(shift)
        for k in range(first, -(-(j * width + width) // 8)):
            out[:, k] |= (value >> np.uint64(8 * (k - first))).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of ``pack``'s bytes."""
    groups = np.frombuffer(data, dtype=np.uint8, count=-(-count // 8) * width).reshape(-1, width).astype(np.uint64)
    out = np.empty((len(groups), 8), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = np.zeros(len(groups), dtype=np.uint64)
        for k in range(first, -(-(j * width + width) // 8)):
            value |= groups[:, k] << np.uint64(8 * (k - first))
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


def packed_size(count: int, width: int) -> int:
    return -(-count // 8) * width


class IdFile:
    """Random access to the ids and documents of one file's bytes."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        mark, self.width, self.shard, self.block_ids, self.n_ids, self.n_docs = FOOTER.unpack(data[-FOOTER.size - 1 : -1])
        if mark != MARK:
            raise ValueError("not a token-ID file")
        self.data = data
        self.stride = HEAD.size + packed_size(self.block_ids, self.width) + len(END)
        at = len(data) - FOOTER.size - 1 - 17 * self.n_docs
        self.starts = np.frombuffer(data, dtype="<u8", count=self.n_docs, offset=at)
        self.doc_ids = np.frombuffer(data, dtype="<i8", count=self.n_docs, offset=at + 8 * self.n_docs)
        self.missing = np.frombuffer(data, dtype=np.uint8, count=self.n_docs, offset=at + 16 * self.n_docs)

    def block(self, k: int) -> np.ndarray:
        mark, width, count = HEAD.unpack_from(self.data, k * self.stride)
        if mark != MARK or width != self.width:
            raise ValueError(f"block {k} is damaged")
        return unpack(self.data[k * self.stride + HEAD.size :], count, width)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the file."""
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        joined = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return joined[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id and ids of every document; holds one document and one block."""
        ends = [*self.starts[1:].tolist(), self.n_ids]
        at, kept = -1, None
        for doc, gone, start, end in zip(self.doc_ids.tolist(), self.missing.tolist(), self.starts.tolist(), ends):
            parts = []
            while start + sum(map(len, parts)) < end:
                here = start + sum(map(len, parts))
                if here // self.block_ids != at:
                    at = here // self.block_ids
                    kept = self.block(at)
                parts.append(kept[here - at * self.block_ids : end - at * self.block_ids])
            yield None if gone else doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint32)])


def _block(ids: bytes, width: int) -> bytes:
    count = len(ids) // 4
    return HEAD.pack(MARK, width, count) + pack(np.frombuffer(ids, dtype="<u4"), width) + END


def _footer(width: int, shard: int, block_ids: int, n_ids: int, n_docs: int) -> bytes:
    return FOOTER.pack(MARK, width, shard, block_ids, n_ids, n_docs)


def write_ids(docs: DataFrame, path: str, vocabulary_file: str, end_id: int = tokens.END_ID, block_ids: int = BLOCK_IDS, file_chars: int = FILE_CHARS) -> None:
    """Encode all documents and write the files; each task holds one block and its index."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary_file)
        width, end = width_of(max(encode.tokenizer.get_vocab_size(), end_id + 1)), tokens.end_bytes(end_id)
        shard, waiting, held, n_ids = TaskContext.get().partitionId(), [], 0, 0
        doc_ids, missing, starts = [], bytearray(), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                doc_ids.append(doc or 0)
                missing.append(doc is None)
                starts.append(n_ids)
                n_ids += len(ids) // 4
                waiting.append(ids)
                held += len(ids)
                if held >= 4 * block_ids:
                    joined = b"".join(waiting)
                    full = held - held % (4 * block_ids)
                    for at in range(0, full, 4 * block_ids):
                        yield pa.record_batch([pa.array([_block(joined[at : at + 4 * block_ids], width)[:-1]], pa.binary())], ["record"])
                    waiting, held = [joined[full:]], held - full
        if starts:
            last = [_block(b"".join(waiting), width)] if held else []
            index = np.array(starts, "<u8").tobytes() + np.array(doc_ids, "<i8").tobytes() + bytes(missing)
            footer = _footer(width, shard, block_ids, n_ids, len(starts))
            yield pa.record_batch([pa.array([b"".join(last) + index + footer], pa.binary())], ["record"])

    ordered = rows.repartitionByRange(max(1, -(-chars // file_chars)), "doc_id").sortWithinPartitions("doc_id", "text")
    # every record is closed by the writer's line end, the last byte of a block and of the file
    ordered.mapInArrow(records, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: shard, doc_id, its first id in the shard, number and crc32 of its ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                if not data.size:
                    continue
                held = IdFile(memoryview(data))
                found = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in held.documents()]
                columns = list(zip(*found))
                yield pa.record_batch([pa.array([held.shard] * len(found), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "shard long, doc_id long, shard_start long, n_tokens long, ids_crc32 long")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``read_ids`` with ``start``, the number of ids of all documents before each one."""
    from pyspark.sql import Window

    found = stored(read_ids(spark, path), "ids-read")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard")
