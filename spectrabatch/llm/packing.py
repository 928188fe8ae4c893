"""Packing documents into training sequences by non-negative least squares.

A document's ids are cut into full windows and a rest. Rests are counted by their
length in units (a histogram of at most window / unit bins). Every way to fill a
window with two or three bins is enumerated, non-negative least squares finds how
often to use each way so that the histogram is met, and the counts are rounded
within what is there. The rests so chosen fill windows exactly but for their last
part of less than a unit. Those tails and the rests left over are packed greedily:
they follow one another, each filling the open window to its end and going on in
the next. The last window is closed by sequences whose lengths are powers of two,
so no sequence needs padding.

Only the histogram reaches the driver. A rest's place follows from its rank in its
bin, a tail's from a running sum; both are counted in slices (``running_start``).

Null texts count as empty and get the end id alone; rows that are alike are packed
once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import running_start, slices, slices_of, stored, text_or_empty
from .id_files import pack, unpack, width_of

WINDOW = 4096
UNIT = 64
DEPTH = 3
#: Rows ranked in one window of the distributed sums.
SLICE_ROWS = 4_000


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        passive[best] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                break
            low = passive & (z <= 0)
            step = (x[low] / (x[low] - z[low])).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
            if not passive.any():
                break
        if not passive.any():
            break
        x = z
    return x


def strategies(units: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of 2 .. depth bins that fill a window of ``units`` units."""
    found = []
    for d in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, units), d - 1):
            last = units - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return found


def plan(histogram: list[int], depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """How often to use each strategy; ``histogram[q]`` counts the rests of q units."""
    units = len(histogram)
    ways = strategies(units, depth)
    total = sum(histogram[1:])
    if not ways or not total:
        return []
    a = np.zeros((units - 1, len(ways)))
    for j, way in enumerate(ways):
        for q in way:
            a[q - 1, j] += 1
    x = nnls(a, np.array(histogram[1:], dtype=float) / total) * total
    left, chosen = list(histogram), []
    for j in sorted(np.flatnonzero(x), key=lambda j: (-x[j], j)):
        need = {q: ways[j].count(q) for q in ways[j]}
        times = min(round(float(x[j])), *(left[q] // m for q, m in need.items()))
        if times > 0:
            chosen.append((ways[j], times))
            for q, m in need.items():
                left[q] -= m * times
    return chosen


def _places(chosen: list[tuple[tuple[int, ...], int]], units: int, unit: int):
    """Per bin: first rank of each use, its sequences' first number, rests per sequence, and their offsets."""
    uses: dict[int, list[tuple[int, int, int, int]]] = {q: [] for q in range(units)}
    taken, base = [0] * units, 0
    for way, times in chosen:
        for q in sorted(set(way)):
            m = way.count(q)
            uses[q].append((taken[q], base, m, unit * sum(way[: way.index(q)])))
            taken[q] += m * times
        base += times
    return uses, taken, base


def token_table(docs: DataFrame, vocabulary_file: str, end_id: int) -> DataFrame:
    """Written once: uid, doc_id, n ids, their packed bytes and a hash of the row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary_file)
        width, end = width_of(max(encode.tokenizer.get_vocab_size(), end_id + 1)), tokens.end_bytes(end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t.as_py()) + end for t in part.column(1)]
                packed = [pack(np.frombuffer(i, "<u4"), width) for i in ids]
                yield pa.record_batch(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(packed, pa.binary())],
                    ["doc_id", "n", "width", "packed"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = rows.mapInArrow(encoded, "doc_id long, n long, width int, packed binary")
    return stored(found.select(F.monotonically_increasing_id().alias("uid"), "*", F.xxhash64("doc_id", "packed").alias("digest")), "pack-ids")


def pack_documents(docs: DataFrame, vocabulary_file: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end_id: int = tokens.END_ID) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window & (window - 1) or window % unit:
        raise ValueError("the window must be a power of two and a multiple of the unit")
    ids = token_table(docs, vocabulary_file, end_id)
    units = window // unit
    rest = F.col("n") % window
    lengths = ids.select("uid", "n", "digest", F.floor(rest / unit).cast("int").alias("q"), F.lit(1).cast("long").alias("one"), F.floor(F.col("n") / window).cast("long").alias("windows"))
    counts = {r["q"]: r["c"] for r in lengths.groupBy("q").agg(F.count("*").alias("c")).collect()}  # at most `units` rows
    rows = sum(counts.values())
    chosen = plan([0] + [counts.get(q, 0) for q in range(1, units)], depth)
    uses, taken, planned = _places(chosen, units, unit)

    ranked = running_start(lengths, ["q"], "digest", ["uid"], {"rank": "one"}, slices_of(F.col("q"), counts, SLICE_ROWS))
    fits = F.col("rank") < F.get(F.array(*[F.lit(t).cast("long") for t in taken]), F.col("q"))
    streamed = ranked.select("uid", "n", "digest", "q", "rank", "windows", fits.alias("fits"), F.when(fits, F.col("n") % unit).otherwise(rest).alias("stream"))
    sums = running_start(streamed, [], "digest", ["uid"], {"first_window": "windows", "at": "stream"}, F.lit(slices(rows, SLICE_ROWS)))
    whole = lengths.agg(F.sum("windows")).first()[0] or 0
    flowing = (streamed.agg(F.sum("stream")).first()[0] or 0) if rows else 0

    def cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = whole + planned
        last = flowing - flowing % window
        closing, at = [], last  # the final powers of two: (from, to, sequence)
        for bit in range(window.bit_length() - 2, -1, -1):
            if flowing % window >> bit & 1:
                closing.append((at, at + (1 << bit), base + last // window + len(closing)))
                at += 1 << bit
        firsts = {q: [u[0] for u in use] for q, use in uses.items()}

        def spots(begin: int, end: int):
            while begin < end:
                if begin < last:
                    seq, lo, hi = base + begin // window, begin - begin % window, begin - begin % window + window
                else:
                    lo, hi, seq = next(c for c in closing if c[0] <= begin < c[1])
                stop = min(end, hi)
                yield stop - begin, seq, begin - lo
                begin = stop

        for frame in frames:
            out = []
            for uid, n, q, rank, fit, stream, windows, first, at in frame[["uid", "n", "q", "rank", "fits", "stream", "windows", "first_window", "at"]].itertuples(index=False):
                pieces = [(k * window, window, first + k, 0) for k in range(windows)]
                done = windows * window
                if fit:
                    start, base_seq, m, offset = uses[q][int(np.searchsorted(firsts[q], rank, side="right")) - 1]
                    pieces.append((done, q * unit, whole + base_seq + (rank - start) // m, offset + (rank - start) % m * q * unit))
                    done += q * unit
                for length, seq, offset in spots(at, at + stream):
                    pieces.append((done, length, seq, offset))
                    done += length
                out.append((uid, *map(list, zip(*pieces))))
            yield pd.DataFrame(out, columns=["uid", "starts", "lengths", "sequences", "offsets"])

    places = sums.mapInPandas(cuts, "uid long, starts array<long>, lengths array<long>, sequences array<long>, offsets array<long>")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                part = batch.slice(at, 1024)
                plain = [part.column(c).to_pylist() for c in ("doc_id", "n", "width", "starts", "lengths", "sequences", "offsets")]
                for packed, doc, n, width, starts, lengths, seqs, offsets in zip(part.column("packed"), *plain):
                    held = unpack(packed.as_buffer(), n, width).astype("<u4")
                    out += [(doc, s, k, zlib.crc32(held[s : s + k].tobytes()), n, seq, offset) for s, k, seq, offset in zip(starts, lengths, seqs, offsets)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names)

    joined = ids.select("uid", "doc_id", "n", "width", "packed").join(places.hint("shuffle_hash"), "uid")
    return joined.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
