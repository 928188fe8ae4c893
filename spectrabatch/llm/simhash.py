"""Near-duplicates by 64-bit SimHash: pigeonhole blocks, verified distance, connected components.

A text's words (ASCII letters lower-cased) form shingles; every shingle, repeats
included, is hashed by XXH64 with seed 42, and a fingerprint bit is set if over
half the hashes set it. Two fingerprints link at ``distance`` or fewer differing
bits.

Fingerprints are split into ``blocks`` blocks. Two that differ in at most
``distance`` bits agree in at least ``blocks - distance`` blocks, so they meet
under one of the combinations of that many blocks; with five blocks and distance
two, ten keys of 38 or 39 bits. Fingerprints that share a key are compared, and
only pairs within the distance are kept. A key under which more than
``KEY_LIMIT`` different fingerprints meet (a dense family of near copies) is not
paired: its members are expanded into all values within half the distance, and
two fingerprints within the distance share such a value. That is exact for even
distances, never grows with the square of a family, and no link is lost.

Only different fingerprints are compared; copies of a text share one. Components
are found by repeated contraction towards the smallest member, each round written
to the shared folder.

Null and empty texts have fingerprint zero and link like any other. A text with
fewer words than a shingle is one shingle. Rows with equal doc_id each keep a row
of the result; rows with a null doc_id are labelled by the smallest doc_id of
their component, null if it has none. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_all_columns

SEED = 42
BITS = 64
SHINGLE = 3
DISTANCE = 2
BLOCKS = 5
#: Most fingerprints under one key that are compared in pairs; beyond it neighbours are expanded.
KEY_LIMIT = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text; bytes.split cuts at exactly space and tab to carriage return."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:count]
    stops = ends[-count:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=">u8", count=count)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest (a hash of the text as it is) and fp, the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "digest", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    return texts.mapInArrow(rows, "doc_id long, digest long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(distance: int, blocks: int) -> list[int]:
    """One mask for every choice of blocks that must agree."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(single[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def near_pairs(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints within the distance.

    ``prints`` has one row per different fingerprint, in ``fp``. Light keys give
    every such pair; dense families give links to the smallest fingerprint around
    each shared neighbour, which connect the same fingerprints.
    """
    if distance % 2 or distance >= blocks:
        raise ValueError("the distance must be even and below the number of blocks")
    masks = [F.struct(F.lit(i).alias("no"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(block_masks(distance, blocks))]
    keyed = prints.select("fp", F.explode(F.array(*masks)).alias("k")).select("fp", F.col("k.no").alias("no"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))
    members = keyed.groupBy("no", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1")
    keys = stored(members, "simhash-keys")
    crowded = keyed.join(keys.select("no", "key", "n"), ["no", "key"])
    shared = stored(crowded.select("no", "key", "fp", "n"), "simhash-shared")

    light = shared.filter(F.col("n") <= key_limit)
    left = light.select("no", "key", F.col("fp").alias("a"))
    right = light.select("no", "key", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["no", "key"]).filter((F.col("a") < F.col("b")) & (apart <= distance)).select("a", "b")

    dense = shared.filter(F.col("n") > key_limit).select("fp").distinct()
    flips = [0, *(_signed(sum(1 << i for i in chosen)) for d in range(1, distance // 2 + 1) for chosen in combinations(range(BITS), d))]
    around = dense.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    # at most len(flips) fingerprints lie around a value
    rings = around.groupBy("near").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    spokes = rings.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.unionByName(spokes).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, its smallest connected node, for every node of ``links`` (a, b).

    Each round every node points to its smallest neighbour, pointers are followed
    once more, and links are rewritten between the roots; what is left shrinks at
    least by half. Minima merge before the shuffle, so hubs cost nothing extra.
    """
    edges = stored(links, "component-links")
    mapping = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        step = stored(smallest, "component-step")
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumped = stored(step.join(hop, "to").select("node", F.col("far").alias("root")), "component-jump")
        one = jumped.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = jumped.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(
            edges.join(one, "a").join(two, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "component-links",
        )
        if mapping is None:
            mapping = jumped
        else:
            later = jumped.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = stored(mapping.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "component-map")
    if mapping is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return mapping


def _families(docs: DataFrame, shingle: int, distance: int, blocks: int = BLOCKS, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Per row of the documents: doc_id, digest, fp, root, a fingerprint that names the component, and component_id."""
    marked = stored(fingerprints(docs, shingle), "simhash-docs")
    prints = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    roots = components(near_pairs(prints.select("fp"), distance, blocks, key_limit))
    # a family's label is its smallest doc_id, whichever fingerprint carries it
    rooted = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = stored(rooted, "simhash-roots")
    labels = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = stored(linked.join(labels, "root").select("fp", "root", "component_id"), "simhash-labels")
    return marked.join(by_print, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Per row of the documents: doc_id, digest, fp and component_id, the smallest doc_id reachable over links."""
    return _families(docs, shingle, distance, blocks, key_limit).drop("root")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of every component, with all columns.

    The smallest doc_id stays, a null one only if there is no other; under one
    doc_id the text with the smallest digest; and of rows alike in both the first
    by their other columns. Doc_ids don't name components: one may stand in several.
    """
    return with_all_columns(docs, lambda rows: _first_rows(rows, shingle, distance))


def _first_rows(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    alike = _families(docs, shingle, distance).groupBy("root", "doc_id", "digest").agg(F.count("*").alias("rows"))
    least = alike.groupBy("root").agg(F.min_by(F.struct("doc_id", "digest", "rows"), order).alias("least"))
    first = least.select(F.col("least.doc_id").alias("_first"), F.col("least.digest").alias("_digest"), F.col("least.rows").alias("_rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_first")) & (F.xxhash64("text") == F.col("_digest"))
    kept = docs.join(stored(first, "simhash-first").hint("shuffle_hash"), same)
    single = kept.filter("_rows = 1").select(*docs.columns)
    one = Window.partitionBy("doc_id", "_digest").orderBy(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], "doc_id")
    several = kept.filter("_rows > 1").withColumn("_place", F.row_number().over(one))
    return single.unionByName(several.filter("_place = 1").select(*docs.columns))
