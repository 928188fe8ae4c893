"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger
remembers which blob was scanned by which version of which rule and what was
found. A scan hashes all rows, takes from the new blobs and the blobs that lack a
rule version one carrier row each, runs only the missing rules on it, appends the
outcome to the ledger and joins the findings back to every path. Copies and
unchanged history are never scanned twice, and a new rule version scans only for
itself.

Everything runs as DataFrame expressions. A rule's matches are leftmost and do not
overlap; ``split`` by the same pattern gives the texts between them. Only lengths
leave the text: running sums over one row per match give the places, in code
points, end exclusive, in time that grows with the text and its matches. Matches
that fail the rule's length are dropped without another try.

Only carrier rows travel with their text, keyed by blob and path, so a text with
very many copies moves once. Joins on the blob alone carry small rows and stand on
written tables, where the adaptive skew split applies.

Null text counts as empty. Rows alike get their findings each. An empty table
gives no rows and an empty ledger entry. Columns other than the path and the text
are ignored by scans and kept by ``redact``. A ledger that does not exist yet is
empty; any other read error is raised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, text_or_empty, with_all_columns

SPAN = "array<struct<kind:string,no:int,start:int,end:int>>"
LEDGER = f"blob binary, scanned array<string>, findings {SPAN}"
MASK = "[secret]"
BLOCK = 1024  # code points of a text that are looked through for one place


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and the least length that passes.

    With ``spent``, the pattern has no group of its own.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    #: What the start of a failed match uses up, where no later start in it can do better.
    spent: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    @property
    def scanned(self) -> tuple[str, int]:
        """The pattern to run and its group: a failed start is a match whose group is empty."""
        return (f"({self.pattern})|{self.spent}", 1) if self.spent else (self.pattern, self.group)


def any_case(words: str) -> str:
    """The pattern with both cases of every ASCII letter, the same in every engine."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# The patterns asked for, in their order.
BASE = (
    Rule("assign", "(" + any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
# Public formats of further credentials, added by this scanner.
FURTHER = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{20,}"),
    # Every further start in a run of letters is nearer to the same dot, so one try a run is enough.
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", spent="eyJ[A-Za-z0-9_-]*"),
)
RULES = (*BASE, *FURTHER)
#: What may stand between a key's first and last line: base64, header fields, written line ends, and hyphens that start neither line.
KEY_BODY = r"[A-Za-z0-9+/=:,\\\s]*+(?:-(?!----(?:BEGIN|END))[A-Za-z0-9+/=:,\\\s]*+)*+"
#: For masking, a private key reaches to its END line; reports give its first line, as their SQL does.
MASKED = tuple(Rule(r.kind, rf"{r.pattern}(?:{KEY_BODY}-----END [A-Z ]{{0,30}}PRIVATE KEY-----)?", version=3) if r.kind == "private_key" else r for r in RULES)


def _quoted(pattern: str) -> str:
    """The pattern as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lengths(rule: Rule, number: int, text: str = "text") -> Column:
    """Per match of the rule in a text column: the gap before it, its length, and the length that counts; NULL without any."""
    scanned, group = rule.scanned
    pattern = _quoted(scanned)
    counted = f"regexp_extract_all({text}, {pattern}, {group})"
    found = F.expr(
        f"""
        named_struct('no', {number}, 'matches', arrays_zip(
          transform(split({text}, {pattern}, -1), g -> length(g)),
          transform(regexp_extract_all({text}, {pattern}, 0), m -> length(m)),
          transform({counted}, c -> length(c))))"""
    )
    return F.when(F.expr(f"{text} rlike {pattern}"), found)


def placed(work: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, findings`` of the carriers (``blob, todo, text``) with any: places by running sums over small rows.

    A window holds the matches of one rule in one text.
    """
    by_rule = [F.when(F.array_contains("todo", r.name), lengths(r, i)) for i, r in enumerate(rules)]
    each = work.select("blob", F.explode(F.array_compact(F.array(*by_rule))).alias("r")).select("blob", "r.*")
    # Rows alike share blob and path and carry twice; their lengths are dropped here, so no text is shuffled for it.
    per_rule = each.dropDuplicates(["blob", "no"])
    matches = per_rule.select("blob", "no", F.posexplode("matches").alias("i", "m")).select("blob", "no", "i", "m.*").toDF("blob", "no", "i", "gap", "hit", "counted")
    # The gap after the last match has no match of its own.
    length = F.col("gap") + F.coalesce("hit", F.lit(0))
    end = F.sum(length).over(W.partitionBy("blob", "no").orderBy("i")).cast("int")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("no") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("no") + 1)
    kept = matches.withColumn("end", end).where(F.col("hit").isNotNull() & (F.col("counted") >= least))
    span = F.struct(kind.alias("kind"), "no", (F.col("end") - F.col("hit")).alias("start"), "end")
    return kept.groupBy("blob").agg(F.collect_list(span).alias("findings"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries; several per blob if rules came later."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(rows: DataFrame, path: list[str], ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return every row's path, blob and findings.

    ``findings`` is null for rows without any; else sorted by start, then by the
    rules' order.
    """
    spark = rows.sparkSession
    names = [r.name for r in rules]
    hashed = rows.select(*path, text_or_empty().alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = stored(hashed.select(*path, "blob"), "blob-paths")

    known = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    carriers = paths.groupBy("blob").agg(F.min(F.struct(*path)).alias("carrier"))
    lacking = carriers.join(known, "blob", "left").withColumn(
        "todo", F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("seen", F.array().cast("array<string>")))
    )
    pending = stored(lacking.filter(F.size("todo") > 0).select("blob", "carrier.*", "todo"), "blob-pending")

    work = hashed.alias("r").join(pending.alias("p").hint("shuffle_hash"), [F.col("r.blob") == F.col("p.blob"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in path]]).select("p.blob", "p.todo", "r.text")
    hits = placed(work, rules).select(F.col("blob").alias("_hit"), "findings")
    fresh = pending.join(hits, F.col("blob") == F.col("_hit"), "left").select(
        "blob", F.col("todo").alias("scanned"), F.coalesce("findings", F.expr(f"cast(array() as {SPAN})")).alias("findings")
    )
    fresh.write.mode("append").parquet(ledger)

    names_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.name)])
    entries = spark.read.schema(LEDGER).parquet(ledger)
    dated = entries.withColumn("findings", F.filter("findings", lambda f: F.array_contains(F.col("scanned"), F.element_at(names_of, f["kind"])))).filter(F.size("findings") > 0)
    merged = dated.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    ordered = F.array_sort("findings", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["no"] - b["no"]).cast("int")))
    found = stored(merged.select("blob", ordered.alias("findings")), "blob-findings")
    return paths.join(found, "blob", "left")


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def report(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts per base kind, the digest of the base findings and all spans, per path."""
    every = F.coalesce("findings", F.expr(f"cast(array() as {SPAN})"))
    kinds = F.array(*[F.lit(r.kind) for r in base])
    found_kinds = F.transform(every, lambda f: f["kind"])
    counts = {f"n_{r.kind}": (F.size(found_kinds) - F.size(F.array_remove(found_kinds, r.kind))).cast("long") for r in base}
    of_base = F.filter(every, lambda f: F.array_contains(kinds, f["kind"]))
    return found.withColumns({**counts, "base_sha256": F.sha2(listed(of_base), 256), "spans": listed(every)}).drop("findings", "blob")


def redact(docs: DataFrame, path: list[str], ledger: str, rules: tuple[Rule, ...] = MASKED, mask: str = MASK) -> DataFrame:
    """All rows and columns, with every finding in ``text`` replaced by the mask.

    ``path`` names columns of documents.
    """
    return with_all_columns(docs, lambda rows: _redacted(rows, path, ledger, rules, mask))


def _cuts(found: DataFrame) -> DataFrame:
    """Per blob the findings that reach beyond all earlier ones, each with the place ``at`` up to which those reach."""
    each = found.select("blob", F.posexplode("findings").alias("i", "f")).select("blob", "i", "f.start", "f.end")
    earlier = W.partitionBy("blob").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    ahead = each.withColumn("at", F.coalesce(F.max("end").over(earlier), F.lit(0))).where("end > at")
    cuts = F.sort_array(F.collect_list(F.struct("at", "start", "end")))
    return ahead.groupBy(F.col("blob").alias("_blob")).agg(cuts.alias("_findings"), F.max("end").alias("_last"))


def _between(start: str, end: str) -> str:
    """SQL for the text from one place to another, from the blocks that hold it; empty if the places are in the wrong order."""
    first, last = f"cast({start} div {BLOCK} as int)", f"cast({end} div {BLOCK} as int)"
    head = f"substring(get(_blocks, {first}), {start} % {BLOCK} + 1)"
    tail = f"coalesce(substring(get(_blocks, {last}), 1, {end} % {BLOCK}), '')"
    within = f"coalesce(substring(get(_blocks, {first}), {start} % {BLOCK} + 1, {end} - {start}), '')"
    between = f"array_join(slice(_blocks, {first} + 2, {last} - {first} - 1), '')"
    return f"case when {end} <= {start} then '' when {first} = {last} then {within} else concat({head}, {between}, {tail}) end"


def _redacted(rows: DataFrame, path: list[str], ledger: str, rules: tuple[Rule, ...], mask: str) -> DataFrame:
    found = scan(rows, path, ledger, rules)
    hits = stored(_cuts(found.filter("findings is not null").select("blob", "findings").dropDuplicates(["blob"])), "blob-redact")
    keyed = rows.withColumn("_key", F.unhex(F.sha2(text_or_empty(), 256)))
    joined = keyed.join(hits.hint("shuffle_hash"), F.col("_key") == F.col("_blob"), "left")
    # Places in a string are found from its start; in blocks they cost the same everywhere.
    blocks = F.when(F.col("_findings").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    joined = joined.withColumn("_blocks", blocks)
    masked = F.concat(
        F.expr(f"array_join(transform(_findings, c -> concat({_between('c.at', 'c.start')}, if(c.start < c.at, '', '{mask}'))), '')"),
        F.expr(_between("_last", "length(text)")),
    )
    clean = F.when(F.col("_findings").isNull(), F.col("text")).otherwise(masked)
    return joined.select(*[clean.alias("text") if c == "text" else F.when(F.col("_findings").isNull(), F.col(c)).otherwise(F.length(masked)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in rows.columns])


# The same scan in DuckDB, for comparison.


def _sql_kind(rule: Rule, number: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{rule.kind}' AS kind, {number} AS no, start, start + length(hit) AS stop
    FROM (
      SELECT doc_id, hits[i] AS hit, counted[i] AS c,
             CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start
      FROM (SELECT doc_id, hits, counted, gaps, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS counted,
                         string_split_regex(t, '{pattern}') AS gaps FROM texts)))
    WHERE length(c) >= {rule.least}"""


def report_sql(base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> str:
    every = " UNION ALL ".join(_sql_kind(r, i) for i, r in enumerate(rules))
    last = len(base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    one = "kind || ':' || start || ':' || stop"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({every}),
    per_doc AS (SELECT doc_id, {counts},
                       coalesce(string_agg({one}, ',' ORDER BY start, no) FILTER (no < {last}), '') AS base,
                       string_agg({one}, ',' ORDER BY start, no) AS spans
                FROM found GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id"""
