"""How far the sources of a language differ in their words: Iceberg prefix refinement, exact divergences.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Only
terms in at least ``least`` documents of their language count, and most different
terms are rarer than that. They are found without ever counting all terms: level by
level, at prefixes of 4, 8, 16, ... bytes, the distinct documents of each prefix
are counted, and prefixes below ``least`` are discarded with every term under them.
A term no longer than the level is complete and its count is its own; longer ones go
on under their prefix if it stays. The refinement ends when no open prefix is left,
after about log2 of the longest kept term's bytes.

Prefixes that stay are handed to the next level as a bitmap of fixed size
(``BITMAP_BITS``, 8 MB broadcast). Two prefixes may share a bit; that costs work,
never correctness, as the next level counts again and complete terms pass by their
exact counts.

Each document is cut into terms once and written as its different terms with
counts; a document is one row, so distinct documents per prefix need no shuffle of
their own. Each pass codes a batch's terms once and counts by arrays; tasks add up
before Spark does. A group with a third of
all rows is spread over tasks like any other rows, since every sum has partial
results. With the kept terms, the counts per source give p, and both parts follow:

* ``term``: p against the language's, the ten largest by a group-limited window;
* ``pair``: sums over all kept terms. Terms are dealt to blocks, and each block of
  the (term, source) table is summed for all pairs of its sources by numpy; where a
  language has thousands of sources, bands of sources bound what a task holds.

Null text, lang and source count as ''. Rows alike count each, as documents of
their own; doc_id plays no role and may be null. A group without kept terms has p of
count 0; a language without kept terms has value 0 in all pairs. A source alone in
its language has no pairs. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: A term stays if this many documents of its language hold it.
LEAST = 10
#: Ranks of part ``term``.
RANKS = 10
#: Bytes of the first level's prefixes; each level doubles them.
FIRST_LEVEL = 4
BITMAP_BITS = 1 << 26
#: Bits that Spark's bitmap functions put in one bitmap.
BUCKET_BITS = 1 << 15
#: (term, source) cells of a block, cells of its dense part, and pairs of a band.
BLOCK_CELLS, DENSE_CELLS, BAND_PAIRS = 1 << 17, 1 << 21, 1 << 20
SCALE = 1_000_000_000
HASH_SEED = 42

# The characters of a term.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

TERMS = "lang string, source string, terms string, counts binary"


def term_rows(docs: DataFrame) -> DataFrame:
    """lang, source, the row's different terms in byte order (joined by spaces) and their counts (32-bit)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for text in batch.column(2):
                found = Counter(text.as_py().encode().translate(BYTES).split())
                different = sorted(found)
                terms.append(b" ".join(different))
                counts.append(array("I", map(found.__getitem__, different)).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.binary())], ["lang", "source", "terms", "counts"])

    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_or_empty().alias("text")).mapInArrow(rows, TERMS)


def _bits(rows: DataFrame, key: str) -> bytes | None:
    """The bitmap of (lang, key); None if there are no rows."""
    place = F.xxhash64("lang", key).bitwiseAND(BITMAP_BITS - 1)
    buckets = (
        rows.select(F.floor(place / BUCKET_BITS).cast("int").alias("bucket"), (place % BUCKET_BITS).alias("place"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
        .collect()  # at most BITMAP_BITS / BUCKET_BITS rows of 4 KB
    )
    if not buckets:
        return None
    size = BUCKET_BITS // 8
    out = bytearray(BITMAP_BITS // 8)
    for row in buckets:
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = row["bits"]
    return bytes(out)


def _holds(bits: bytes, lang: str) -> Callable[[bytes], bool]:
    """Whether the bitmap has a key of this language (or one that shares its bit)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), HASH_SEED)

    def test(key: bytes) -> bool:
        place = xxhash.xxh64_intdigest(key, seed) & (BITMAP_BITS - 1)
        return bool(bits[place >> 3] >> (place & 7) & 1)

    return test


def _all_hold(bits: bytes, lang: str, keys: pa.Array) -> np.ndarray:
    """For each of a column of keys, with repeats, whether the bitmap has it."""
    coded = keys.dictionary_encode()
    holds = _holds(bits, lang)
    return np.fromiter(map(holds, coded.dictionary.to_pylist()), bool, len(coded.dictionary))[coded.indices.to_numpy()]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(langs.dictionary) + 1))
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.take(pa.array(order[ends[code] : ends[code + 1]]))


def _flat(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each row's terms start, and all terms, coded."""
    lists = pc.split_pattern(rows.column("terms"), " ")
    return lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.flatten().cast(pa.binary()).dictionary_encode()


def _level_counts(rows: DataFrame, level: int, before: int, bits) -> DataFrame:
    """lang, prefix, whether it goes on, and partial numbers of documents, from the terms that are still open.

    A row's terms are in byte order, so those with one prefix are neighbours and the
    first of them counts the document.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, mine in _by_lang(batch):
                starts, terms = _flat(mine)
                length = pc.binary_length(terms.dictionary).to_numpy()
                prefixes = pc.binary_slice(terms.dictionary, 0, level).dictionary_encode()
                key = prefixes.indices.to_numpy() * 2 + (length > level)
                still = length > before
                if bits:
                    still &= _all_hold(bits.value, lang, pc.binary_slice(terms.dictionary, 0, before))
                codes = terms.indices.to_numpy()
                keys = key[codes]
                first = np.append(True, keys[1:] != keys[:-1])
                first[starts] = True
                docs = np.bincount(keys[first & still[codes]], minlength=1)
                found = np.flatnonzero(docs)
                yield pa.record_batch(
                    [pa.array([lang] * len(found), pa.string()), prefixes.dictionary.take(pa.array(found // 2)), pa.array(found % 2 == 1), pa.array(docs[found].astype(np.int64))],
                    ["lang", "prefix", "open", "docs"],
                )

    return rows.filter("terms <> ''").select("lang", "terms").mapInArrow(counted, "lang string, prefix binary, open boolean, docs long")


def kept_terms(spark: SparkSession, rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term (bytes) and docs of all terms in at least ``least`` documents of their language."""
    level, before, bits, found = FIRST_LEVEL, 0, None, []
    while True:
        counted = _level_counts(rows, level, before, bits).groupBy("lang", "prefix", "open").agg(F.sum("docs").alias("docs"))
        counted = stored(counted.filter(F.col("docs") >= least), "divergence-level")
        if bits:
            bits.unpersist()
        found.append(counted.filter("not open").select("lang", F.col("prefix").alias("term"), "docs"))
        alive = _bits(counted.filter("open"), "prefix")
        if alive is None:
            return reduce(DataFrame.unionByName, found)
        before, level, bits = level, level * 2, spark.sparkContext.broadcast(alive)


def term_counts(spark: SparkSession, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term and n, occurrences of the kept terms."""
    kept_bits = _bits(kept, "term")
    if kept_bits is None:
        return spark.createDataFrame([], "lang string, source string, term binary, n long")
    bits = spark.sparkContext.broadcast(kept_bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, mine in _by_lang(batch):
                starts, terms = _flat(mine)
                sources = mine.column("source").dictionary_encode()
                codes = terms.indices.to_numpy().astype(np.int64)
                source = np.repeat(sources.indices.to_numpy().astype(np.int64), np.diff(np.append(starts, len(codes))))
                numbers = np.frombuffer(b"".join(mine.column("counts").to_pylist()), np.uint32).astype(np.int64)
                holds = _all_hold(bits.value, lang, terms.dictionary)[codes]
                width = len(terms.dictionary)
                keys = (source * width + codes)[holds]
                order = np.argsort(keys, kind="stable")
                keys, numbers = keys[order], numbers[holds][order]
                firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.array([], np.int64)
                found = keys[firsts]
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        sources.dictionary.take(pa.array(found // width)),
                        terms.dictionary.take(pa.array(found % width)),
                        pa.array(np.add.reduceat(numbers, firsts) if len(firsts) else numbers),
                    ],
                    ["lang", "source", "term", "n"],
                )

    partial = rows.filter("terms <> ''").mapInArrow(counted, "lang string, source string, term binary, n long")
    summed = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return summed.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")


def _p(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)), exact; null if there are no kept terms."""
    wide = "cast({} as decimal(19,0))".format
    return F.expr(f"1 + ({wide(count)} + 2) * {SCALE}BD div nullif({wide(total)} + 2 * {wide(kept)}, 0)")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def groups_of(rows: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (lang, source) with its number within the language, total of kept terms, cells, and the language's kept terms."""
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    numbers = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    every = rows.groupBy("lang", "source").agg(F.count("*").alias("documents")).drop("documents").join(totals, ["lang", "source"], "left").join(numbers, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return every.na.fill(0, ["total", "cells", "kept"]).withColumn("number", number)


def top_terms(groups: DataFrame, counts: DataFrame, ranks: int) -> DataFrame:
    """The terms of each group whose share most exceeds the language's."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("kept").alias("lang_kept"))
    language = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(whole, "lang").select("lang", "term", _p("lang_n", "lang_total", "lang_kept").alias("q"))
    own = counts.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).select("lang", "source", "term", _p("n", "total", "kept").alias("p"))
    over = own.join(language, ["lang", "term"]).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = over.select("lang", "source", "term", _divergence("p", "q").alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")


def _block_sums(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Divergences between a band of sources and all later ones, summed over the terms of one block."""
    base = groups.sort_values("number")["p0"].to_numpy(np.int64)
    sources, (lang, _, band) = len(base), key
    bands = int(groups["bands"].iloc[0]) if sources else 1
    mine = [i for i in range(sources) if i * bands // sources == band]
    sums = np.zeros((len(mine), sources), np.int64)
    codes = pd.factorize(cells["term"])[0]
    order = np.argsort(codes, kind="stable")
    codes, numbers, shares = codes[order], cells["number"].to_numpy()[order], cells["p"].to_numpy(np.int64)[order]
    terms, step = int(codes[-1]) + 1 if len(codes) else 0, max(1, DENSE_CELLS // max(1, sources))
    for start in range(0, terms, step):
        first, last = np.searchsorted(codes, [start, start + step])
        dense = np.tile(base, (min(step, terms - start), 1))
        dense[codes[first:last] - start, numbers[first:last]] = shares[first:last]
        for row, a in enumerate(mine):
            p, q = dense[:, a : a + 1], dense[:, a + 1 :]
            sums[row, a + 1 :] += ((p - q) ** 2 // (p + q)).sum(axis=0)
    pairs = [(a, b) for a in mine for b in range(a + 1, sources)] if terms else []
    return pd.DataFrame({"lang": lang, "a": [a for a, _ in pairs], "b": [b for _, b in pairs], "value": [int(sums[a - mine[0], b]) for a, b in pairs]})


def source_pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources with the sum of their divergences over all kept terms."""
    sources, cells = F.col("sources"), F.col("lang_cells")
    per_block = F.greatest(F.lit(BLOCK_CELLS), F.least((sources * sources / 4).cast("long"), F.lit(8 * BLOCK_CELLS)))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("cells").alias("lang_cells"))
    sizes = sizes.select("lang", F.ceil(cells / per_block).alias("blocks"), F.ceil(sources * sources / BAND_PAIRS).alias("bands"))
    spread = groups.join(sizes, "lang").select("lang", "source", "number", "total", "kept", "blocks", "bands", _p("0", "total", "kept").alias("p0"))
    band = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)).alias("band")
    left = (
        counts.join(spread, ["lang", "source"])
        .select("lang", "number", "term", _p("n", "total", "kept").alias("p"), F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "bands")
        .select("lang", "number", "term", "p", "block", band)
    )
    right = (
        spread.filter("blocks > 0")
        .select("lang", "number", "p0", "bands", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        .select("lang", "number", "p0", "bands", "block", band)
    )
    right = right.toDF(*right.columns)  # both sides come from the groups; new columns keep them apart
    key = ["lang", "block", "band"]
    partial = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_block_sums, "lang string, a int, b int, value long")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("number").alias("x"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("y"))
    pairs = one.join(other, "lang").filter("x <> y").select("lang", "source", "item", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    valued = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank of all pairs of sources and of each group's top terms."""
    spark = docs.sparkSession
    rows = stored(term_rows(docs), "divergence-terms")
    kept = kept_terms(spark, rows, least)
    counts = stored(term_counts(spark, rows, kept), "divergence-counts")
    groups = stored(groups_of(rows, kept, counts), "divergence-groups")
    return source_pairs(groups, counts).unionByName(top_terms(groups, counts, ranks))


def divergence_sql(least: int = LEAST, ranks: int = RANKS) -> str:
    p = f"(1 + {SCALE}::HUGEINT * ({{}} + 2) // ({{}} + 2 * {{}}))".format
    return f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "total", "v")} AS p
  FROM t JOIN k ON t.lang = k.lang JOIN v ON t.lang = v.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (
  SELECT l.lang, term, {p("n", "total", "v")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) l JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT p.lang, source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {ranks}"""
