"""How five text filters interact, in every order they can be applied.

Each document is reduced to a mask with one bit per filter that it fails, and the
masks are counted per part (source), so all that follows works on at most 32 masks
times four label marks per part. Per cell, ``transform``
goes over the 120 orders and ``aggregate`` along each of them, carrying the filters
applied so far: 600 structs of counts, weighted by the cell's documents. The cells
of a part (at most 128, so they fit in one row) are merged by elementwise sums, and
a filter's share over all orders (its Shapley sum) is folded from the merged array.

The order array is a constant of the plan, 120 times five bits whatever the data.

Copies are found by the SHA-256 of the text: the smallest doc_id per digest is an
aggregate with partial results, and joining it back moves small rows only, on
written tables, where the adaptive skew split cuts a digest or an id that many rows
share. Texts are read once.

A null text counts as empty, a null source is the part ''. Filter E compares
doc_ids: rows with a null doc_id neither fail it nor make others fail, and rows
alike under one doc_id don't fail each other. A document counts as good (toxic) if
any of its label rows has quality (toxic) 1; null doc_ids have no labels. Rows alike
count each. Parts without rows don't exist, so an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

STEP = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"

# The limits and characters of the filters.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = r"[#$%&*|]"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _mask(failures: dict[str, Column]) -> Column:
    """The sum of the bits of the filters that fail."""
    mask = F.lit(0)
    for letter, fails in failures.items():
        mask = mask + F.when(fails, bit(letter)).otherwise(0)
    return mask


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of filters A to D, one small row per document."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text")
    )
    counted = texts.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"),
        F.length("text").alias("length"),
        F.col("text").rlike(SYMBOLS).alias("symbols"),
    )
    every, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    failures = {
        "A": every < LEAST_WORDS,
        "B": distinct * 100 < every * LEAST_DISTINCT_PERCENT,
        "C": F.col("capitals").cast("long") * 100 > F.col("length").cast("long") * MOST_CAPITALS_PERCENT,
        "D": F.col("symbols"),
    }
    return counted.select("doc_id", "part", "digest", _mask(failures).alias("own"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part, mask, good and toxic."""
    rows = stored(own_failures(docs), "filter-audit")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("copies")).filter("copies > 1").drop("copies")
    marks = (
        labels.filter("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    )
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    masked = rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(copied, bit("E")).otherwise(0)).alias("mask"))
    without_id = masked.filter("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    marked = (
        masked.filter("doc_id is not null")
        .join(marks, "doc_id", "left")
        .select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )
    return marked.unionByName(without_id).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def _step(cell: Column, done: Column, now: Column) -> Column:
    """What a cell's documents count for when filter ``now`` comes after the filters in ``done`` (as bits)."""
    mask = cell["mask"]
    there, fails = done.bitwiseAND(mask) == 0, now.bitwiseAND(mask) != 0
    gone = there & fails
    values = [there & ~fails, gone, ~there & fails, mask == now, gone & cell["good"], gone & cell["toxic"]]
    return F.struct(*[F.when(v, cell["n"]).otherwise(F.lit(0).cast("long")).alias(name) for v, name in zip(values, COUNTS)])


def _fold(cell: Column, orders: Column) -> Column:
    """600 structs of a cell, order by order and step by step; the inner fold carries the filters applied so far."""
    nothing = F.struct(F.lit(0).alias("done"), F.array().cast(f"array<{STEP}>").alias("out"))

    def along(order: Column) -> Column:
        return F.aggregate(
            order,
            nothing,
            lambda a, now: F.struct((a["done"] + now).alias("done"), F.concat(a["out"], F.array(_step(cell, a["done"], now))).alias("out")),
            lambda a: a["out"],
        )

    return F.flatten(F.transform(orders, along))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[name] + y[name]).alias(name) for name in COUNTS]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: documents kept, removed, redundant, failing alone, good lost, toxic lost, and the filter's Shapley sum."""
    orders = F.array(*[F.array(*[F.lit(bit(letter)) for letter in order]) for order in ORDERS])
    nothing = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(name) for name in COUNTS]), len(ORDERS) * len(FILTERS))

    def with_shapley(steps: Column) -> Column:
        flat = F.flatten(orders)
        sums = F.transform(
            F.array(*[F.lit(bit(letter)) for letter in FILTERS]),
            lambda letter: F.aggregate(
                F.zip_with(steps, flat, lambda step, now: F.when(now == letter, step["removed"]).otherwise(F.lit(0).cast("long"))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )
        return F.struct(steps.alias("steps"), sums.alias("shapley"))

    parts = mask_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    merged = parts.select("part", F.aggregate("cells", nothing, lambda a, cell: _added(a, _fold(cell, orders)), with_shapley).alias("merged"))
    rows = merged.select("part", F.col("merged.shapley").alias("shapley"), F.posexplode("merged.steps").alias("at", "counts"))
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.floor(F.col("at") / len(FILTERS)).cast("int") + 1)
    step = F.col("at") % len(FILTERS) + 1
    named = rows.select("part", order.alias("filter_order"), step.cast("int").alias("step"), "counts", "shapley")
    filter_number = F.instr(F.lit(FILTERS), F.col("filter_order").substr(F.col("step"), F.lit(1)))
    return named.select("part", "filter_order", "step", *[f"counts.{name}" for name in COUNTS], F.element_at("shapley", filter_number).alias("shapley"))


def audit_sql() -> str:
    letters = ", ".join(f"('{letter}', {bit(letter)})" for letter in FILTERS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > {MOST_CAPITALS_PERCENT} * length(w.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.text, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w JOIN firsts ON w.text = firsts.text),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN marks ON m.doc_id = marks.doc_id GROUP BY ALL),
f(letter, b) AS (VALUES {letters}),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31
    AND a.b <> b.b AND a.b <> c.b AND a.b <> d.b AND a.b <> e.b AND b.b <> c.b AND b.b <> d.b AND b.b <> e.b AND c.b <> d.b AND c.b <> e.b AND d.b <> e.b),
steps AS (
  SELECT filter_order, step, bits[step] AS now, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS done
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counts AS (
  SELECT part, filter_order, step, now,
    sum(CASE WHEN mask & (done | now) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & done = 0 AND mask & now <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & done <> 0 AND mask & now <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = now THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN good AND mask & done = 0 AND mask & now <> 0 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN toxic AND mask & done = 0 AND mask & now <> 0 THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, now) AS BIGINT) AS shapley
FROM counts"""
