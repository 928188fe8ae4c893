"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents one after another in the order
of a hash, repeated up to ``limit`` times. Its target says how many words of the
stream the mix takes. Streams are cut into blocks, and the blocks a source owes
are its quota. Output shards are the leaves of a binary tree: at each node the
quotas of all sources are split between the two halves by a draw from the
multivariate hypergeometric distribution, so every shard gets an exact number of
blocks, the shards of a split are as different as random ones, and all quotas
come out exactly. A keyed permutation of a source's blocks deals disjoint blocks
to the leaves, and a shard orders its pieces by a hash of its own. The draw
decides where words go, not which: of every stream the mix takes the first words
up to the target, as the SQL does. ``mixed_documents`` writes its rows in the
draw's order; ``taken_words`` counts, so the draw doesn't show in it.

A node's draw depends on the seed, the quotas and the node alone. A task walks
only the nodes its blocks pass through, so there is no table of shards, reruns
agree, and a lost task repeats the same draws. The driver holds one total per
source.

Size is the number of words; null text has none. Rows alike in doc_id, source and
text are one unit whose words are shared out evenly. Sources without words have
target 0. A null source is a source of its own, the last. An empty table gives no
rows. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_start, slices_of, stored, text_or_empty, with_all_columns

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 65_536
SHARD_BLOCKS = 256
#: Rows of a source ranked in one window of the distributed sums.
SLICE_ROWS = 4_000
#: Leading bits of ``place`` that cut a shard into tasks.
PLACE_BITS = 3
#: numpy draws from at most this many blocks; larger corpora need larger blocks.
MOST_BLOCKS = 10**9


def targets(sizes: list[int], weights: list[float], limit: int = LIMIT) -> list[float]:
    """Shares of the total by weight; what exceeds ``limit`` x size goes to the others by weight until none exceeds."""
    capped: set[int] = set()
    while True:
        left = float(sum(sizes) - sum(limit * sizes[i] for i in capped))
        open_weight = sum(w for i, w in enumerate(weights) if i not in capped)
        found = [float(limit * s) if i in capped else left * weights[i] / open_weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and found[i] > limit * s}
        if not over:
            return found
        capped |= over


@dataclass(frozen=True)
class Tree:
    """The splitting tree over ``shards`` leaves for the blocks each source owes."""

    quotas: tuple[int, ...]
    shards: int
    seed: int

    def split(self, node: int, quotas: np.ndarray, left: int, both: int) -> np.ndarray:
        """The quotas of the left child: blocks in proportion to its leaves, drawn without replacement."""
        total = int(quotas.sum())
        draw = np.random.default_rng([self.seed, node])
        return draw.multivariate_hypergeometric(quotas, total * left // both, method="marginals") if total else quotas * 0

    def shard_of(self, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The leaf of each block, given its source and its place in the source's permutation."""
        out = np.empty(len(rank), dtype=np.int64)
        todo = [(1, np.array(self.quotas, dtype=np.int64), 0, self.shards, np.arange(len(rank)), rank.astype(np.int64))]
        while todo:
            node, quotas, first, leaves, rows, places = todo.pop()
            if not len(rows):
                continue
            if leaves == 1:
                out[rows] = first
                continue
            half = leaves // 2
            mine = self.split(node, quotas, half, leaves)
            left = places < mine[source[rows]]
            todo.append((2 * node, mine, first, half, rows[left], places[left]))
            rest = ~left
            todo.append((2 * node + 1, quotas - mine, first + half, leaves - half, rows[rest], places[rest] - mine[source[rows[rest]]]))
        return out


def permuted(values: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """A keyed bijection of 0 .. size - 1 for every source: four Feistel rounds, walked until the value is below size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))) / 2 + 0.5).astype(np.int64)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = values.astype(np.uint64), np.arange(len(values))
    while len(todo):
        h, m, k, v = half[todo], mask[todo], key[todo].astype(np.uint64), out[todo]
        left, right = v >> h, v & m
        for r in range(4):
            mixed = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 31 + r + 1) & 0xFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            left, right = right, left ^ (mixed & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _source_key() -> F.Column:
    """A key that is never null and sorts by code point with null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def _digest() -> F.Column:
    """The first 64 bits of the MD5 of doc_id and text: an order that other engines can follow."""
    hashed = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))
    return F.conv(F.substring(hashed, 1, 16), 16, -10).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """Rows alike become one unit: doc_id, source_key, digest, size of a row, copies."""
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", _source_key().alias("source_key"), _digest().alias("digest"), words.alias("size"))
    return stored(rows.groupBy("doc_id", "source_key", "digest", "size").agg(F.count("*").alias("copies")), "mix-units")


@dataclass(frozen=True)
class Mix:
    units: DataFrame
    sources: list[str]  # keys in order
    sizes: list[int]
    targets: list[float]
    pieces: DataFrame  # doc_id, source_key, digest, epoch, first_word, words, shard, place
    shards: int


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 9, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Pieces of documents per output shard; ``place`` orders a shard's pieces.

    A piece is ``words`` words from word ``first_word`` of the unit, in the
    ``epoch``-th pass over its source.
    """
    table = units(docs)
    found = table.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("s"), F.count("*").alias("n")).collect()
    totals, counts = {r["source_key"]: r["s"] for r in found}, {r["source_key"]: r["n"] for r in found}
    sources = sorted(totals)
    sizes = [totals[s] for s in sources]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], limit) if sources else []
    owed = [min(limit * s, int(t + 0.5)) for s, t in zip(sizes, wanted)]
    quotas = tuple(-(-t // block_words) for t in owed)
    if sum(quotas) >= MOST_BLOCKS:
        raise ValueError("too many blocks for one draw; take larger blocks")
    tree = Tree(quotas, max(1, -(-sum(quotas) // shard_blocks)), seed)
    number = {s: i for i, s in enumerate(sources)}

    weighed = table.withColumn("span", F.col("size") * F.col("copies"))
    placed = running_start(weighed, ["source_key"], "digest", ["doc_id", "size"], {"start": "span"}, slices_of(F.col("source_key"), counts, SLICE_ROWS))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goal, size, quota = np.array(owed, np.int64), np.array(sizes, np.int64), np.array(quotas, np.int64)
        for frame in frames:
            who = frame["source_key"].map(number).to_numpy(np.int64)
            row, begin, span = np.arange(len(frame)), frame["start"].to_numpy(np.int64), frame["span"].to_numpy(np.int64)
            for epoch in range(limit):
                lo = epoch * size[who] + begin
                hi = np.minimum(lo + span, goal[who])
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                blocks = (hi[some] - 1) // block_words - lo[some] // block_words + 1
                rows = np.repeat(row[some], blocks)
                nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                block = lo[rows] // block_words + nth
                start = np.maximum(lo[rows], block * block_words)
                stop = np.minimum(hi[rows], (block + 1) * block_words)
                # a block is looked up once, however many documents lie in it
                pairs, back = np.unique(np.stack([who[rows], block]), axis=1, return_inverse=True)
                shard = tree.shard_of(pairs[0], permuted(pairs[1], quota[pairs[0]], pairs[0], seed))
                picked = frame.iloc[rows]
                yield pd.DataFrame(
                    {
                        "doc_id": picked["doc_id"].array,
                        "source_key": picked["source_key"].array,
                        "digest": picked["digest"].array,
                        "epoch": np.full(len(rows), epoch, np.int32),
                        "first_word": start - lo[rows],
                        "words": stop - start,
                        "shard": shard[back.reshape(-1)],
                    }
                )

    pieces = placed.select(F.col("doc_id").cast("long"), "source_key", "digest", "span", "start").mapInPandas(
        cut, "doc_id long, source_key string, digest long, epoch int, first_word long, words long, shard long"
    )
    place = F.xxhash64(F.lit(seed), "shard", "digest", "epoch", "first_word")
    return Mix(table, sources, sizes, wanted, pieces.withColumn("place", place), tree.shards)


def _by_source(mixed: Mix, values: list, kind: str) -> F.Column:
    """A source's value as an expression on ``source_key`` (one literal per source)."""
    if not values:
        return F.lit(None).cast(kind)
    entries = [x for s, v in zip(mixed.sources, values) for x in (F.lit(s), F.lit(v).cast(kind))]
    return F.element_at(F.create_map(*entries), F.col("source_key"))


def taken_words(mixed: Mix) -> DataFrame:
    """Per row of the documents: doc_id, size, source_size, target, taken.

    The rows of a unit share its words; the division leaves less than one word
    per row.
    """
    keys = ["doc_id", "digest", "source_key"]
    taken = mixed.pieces.groupBy(*keys).agg(F.sum("words").alias("words"))
    same = [mixed.units[k].eqNullSafe(taken[k]) for k in keys]
    joined = mixed.units.join(taken, same[0] & same[1] & same[2], "left").select(mixed.units["*"], "words")
    rows = joined.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id",
        "size",
        _by_source(mixed, mixed.sizes, "long").alias("source_size"),
        _by_source(mixed, mixed.targets, "double").alias("target"),
        F.floor(F.coalesce(F.col("words"), F.lit(0)) / F.col("copies")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: one row per document and pass, whole or cut after the words that fit the target.

    Partitions follow each other by shard and, within a shard, by ``place``, and
    rows are sorted by it. A document goes where its first piece of the pass goes;
    copies of a row, which share their pieces, each go to a shard by a hash.
    """
    return with_all_columns(docs, lambda rows: _mixed_rows(rows, settings))


def _mixed_rows(docs: DataFrame, settings: dict) -> DataFrame:
    mixed = mix(docs, **settings)
    keys = ["doc_id", "digest", "source_key"]
    passes = mixed.pieces.groupBy(*keys, "epoch").agg(F.sum("words").alias("words"), F.min_by(F.struct("shard", "place"), "first_word").alias("at"))
    shares = mixed.units.join(passes, [mixed.units[k].eqNullSafe(passes[k]) for k in keys]).select(
        *[mixed.units[k].alias(f"_{k}") for k in keys],
        F.struct((F.col("words") / F.col("copies")).cast("long").alias("words"), "at.shard", "at.place").alias("_share"),
        F.col("size").alias("_size"),
        F.col("copies").alias("_copies"),
    )
    plans = shares.filter("_share.words > 0").groupBy("_doc_id", "_digest", "_source_key", "_size", "_copies").agg(F.sort_array(F.collect_list("_share"), asc=False).alias("_take"))  # at most `limit` entries
    keyed = docs.withColumns({"_d": _digest(), "_s": _source_key(), "_row": F.monotonically_increasing_id()})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_d") == F.col("_digest")) & (F.col("_s") == F.col("_source_key"))
    rows = keyed.join(plans.hint("shuffle_hash"), on).withColumn("_t", F.explode("_take")).withColumn("_n", F.col("_t.words"))
    place = F.when(F.col("_copies") > 1, F.xxhash64("_t.place", "_row")).otherwise(F.col("_t.place"))
    shard = F.when(F.col("_copies") > 1, F.pmod(F.xxhash64("_row", "_t.place"), F.lit(mixed.shards))).otherwise(F.col("_t.shard"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    kept = F.when(F.col("_n") >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_n").cast("int")), " "))
    cut = [kept.alias("text") if c == "text" else (F.length(kept).cast("long").alias("n_chars") if c == "n_chars" else F.col(c)) for c in docs.columns]
    part = (F.col("_part") * 2**PLACE_BITS + F.shiftrightunsigned("_place", 64 - PLACE_BITS)).cast("int")
    dealt = rows.select(*cut, shard.alias("_part"), place.alias("_place")).repartitionById(mixed.shards * 2**PLACE_BITS, part)
    return dealt.sortWithinPartitions("_place").select(*docs.columns)


# The words taken in DuckDB, for comparison. The levels that cap sources are found
# at once: with the k sources of the smallest limit per weight at their limits, the
# others share what is left; the first k that keeps the next one under its limit holds.


def taken_sql(weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> str:
    cycle = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
    WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                         substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 16) AS digest FROM documents),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(weights)} {cycle} END AS w
                FROM docs GROUP BY source),
    ordered AS (SELECT *, row_number() OVER (ORDER BY {limit} * s / w, source) AS k, {limit} * s / w AS ratio FROM sources),
    shared AS (SELECT *, (SELECT sum(s) FROM sources) - coalesce(sum({limit} * s) OVER before, 0) AS left_over,
                      (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER before, 0) AS open_weight
               FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT k, left_over, open_weight FROM shared WHERE left_over / open_weight <= ratio ORDER BY k LIMIT 1),
    goals AS (SELECT o.source, o.s, CASE WHEN o.k < l.k THEN CAST({limit} * o.s AS DOUBLE) ELSE CAST(l.left_over AS DOUBLE) * o.w / l.open_weight END AS target
              FROM ordered o, level l),
    placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs)
    SELECT doc_id, size, s AS source_size, target,
           CAST({" + ".join(f"greatest(0, least(size, least({limit} * s, floor(target + 0.5)) - {e} * s - start))" for e in range(limit))} AS BIGINT) AS taken
    FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source"""
