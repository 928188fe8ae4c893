"""URL filter: rules first, then empirical-Bayes host reputation.

Pages that a rule fits are the labelled outcomes: blocked is bad, allowed is good.
Outcomes are counted per host, registered domain (the last two labels) and suffix
(the last label). A host's rate of bad pages is shrunk towards its domain's, that
towards its suffix's, that towards the rate of all labelled pages, each by a
beta-binomial prior whose strength is estimated from how much the rates of a
level's groups differ (method of moments). A page without a rule is blocked if the
lower posterior bound of its host's bad rate lies above the cut, else allowed: the
filter acts only on what it is sure of.

Counts merge before the shuffle, so a hot host costs nothing extra; only hosts
that have pages without a rule are joined back, from a written table, where the
adaptive skew split applies.

A null url, or one without ``://``, has an empty host and path, and no rule fits
it. Ports and user names stay part of the host. Without any labelled page all
other pages are allowed. Repeated pages count each. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Standard deviations from the posterior mean to the bound.
BOUND = 1.645
CUT = 0.5
#: Strength of a prior where the groups of a level can't tell, and its limits.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules asked for.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    rest = F.regexp_extract("url", "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def first_fit(rules: tuple[UrlRule, ...], value) -> Column:
    """The value of the rule that fits best: the longest, by host and path together."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        of_host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = of_host & F.col("path").startswith(rule.path)
        found = F.when(fits, value(rule)) if found is None else found.when(fits, value(rule))
    return F.lit(None).cast("string") if found is None else found


def domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def strength() -> Column:
    """An aggregate over (n, bad, mean): the beta-binomial strength by moments.

    With p the pooled rate, S = sum n (rate - p)^2 has a known expectation for a
    spread rho between groups; the strength is 1 / rho - 1. Rates come from whole
    numbers, and the result is rounded, so it does not hang on the order of sums.
    """
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    count, total, squares = F.count("*"), F.sum("n").cast("double"), F.sum(F.col("n") * F.col("n")).cast("double")
    p = F.sum("bad").cast("double") / total
    spread = F.sum(bad * bad / n) - total * p * p
    within = p * (1 - p)
    rho = (spread - within * (count - 1)) / (within * (total - squares / total - (count - 1)))
    raw = F.when((count > 1) & (within > 0) & (total - squares / total - (count - 1) > 0) & (rho > 0), 1 / rho - 1)
    return F.round(F.least(F.greatest(F.coalesce(raw, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), 6)


def reputations(labelled: DataFrame, hosts: DataFrame, bound: float = BOUND) -> DataFrame:
    """host, rate and lower bound of the bad rate for all ``hosts``; ``labelled`` has host and bad (0, 1).

    Levels hold one row per group; the strengths and the overall rate are three
    numbers fetched once.
    """
    by_host = stored(labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "reputation-hosts")
    by_domain = by_host.groupBy(domain(F.col("host")).alias("domain")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy(suffix(F.col("domain")).alias("suffix")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = by_host.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (whole["bad"] / whole["n"]) if whole["n"] else 0.0
    k_suffix, k_domain, k_host = (level.agg(strength().alias("k")).first()["k"] for level in (by_suffix, by_domain, by_host))

    def shrunk(n: Column, bad: Column, k: float, prior: Column) -> Column:
        return (F.coalesce(bad, F.lit(0)) + k * prior) / (F.coalesce(n, F.lit(0)) + k)

    suffixes = by_suffix.select("suffix", F.col("n").alias("sn"), F.col("bad").alias("sb"))
    domains = by_domain.select("domain", F.col("n").alias("dn"), F.col("bad").alias("db"))
    joined = (
        hosts.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
        .join(by_host.select("host", "n", "bad"), "host", "left")
        .join(domains, "domain", "left")
        .join(suffixes, "suffix", "left")
    )
    of_suffix = shrunk(F.col("sn"), F.col("sb"), k_suffix, F.lit(float(overall)))
    of_domain = shrunk(F.col("dn"), F.col("db"), k_domain, F.col("of_suffix"))
    of_host = shrunk(F.col("n"), F.col("bad"), k_host, F.col("of_domain"))
    rates = joined.withColumn("of_suffix", of_suffix).withColumn("of_domain", of_domain).withColumn("rate", of_host)
    weight = F.coalesce("n", F.lit(0)) + k_host
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return rates.select("host", "rate", (F.col("rate") - bound * deviation).alias("lower"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, bound: float = BOUND, cut: float = CUT) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits) and verdict."""
    marked = parsed(pages).withColumns({"rule": first_fit(rules, lambda r: F.lit(r.name)), "by_rule": first_fit(rules, lambda r: F.lit(r.verdict))})
    labelled = marked.filter("by_rule is not null").select("host", (F.col("by_rule") == "block").cast("long").alias("bad"))
    open_pages = marked.filter("by_rule is null")
    known = stored(reputations(labelled, open_pages.select("host").distinct(), bound), "reputation-rates")
    by_method = F.when(F.col("lower") > cut, "block").otherwise("allow")
    judged = open_pages.join(known, "host").select("page_id", "host", "path", "rule", by_method.alias("verdict"))
    return marked.filter("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict")).unionByName(judged)


# The same judgement in DuckDB, for comparison.


def _strength_sql(source: str) -> str:
    return f"""(
      SELECT round(least(greatest(coalesce(CASE WHEN c > 1 AND w > 0 AND d > 0 AND (s - w * (c - 1)) / (w * d) > 0 THEN 1 / ((s - w * (c - 1)) / (w * d)) - 1 END,
                   {MOST_STRENGTH}), {LEAST_STRENGTH}), {MOST_STRENGTH}), 6)
      FROM (SELECT c, s, p * (1 - p) AS w, t - q / t - (c - 1) AS d
            FROM (SELECT count(*) AS c, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS q, sum(bad)::DOUBLE / sum(n)::DOUBLE AS p,
                         sum(bad::DOUBLE * bad / n) - sum(n)::DOUBLE * (sum(bad)::DOUBLE / sum(n)::DOUBLE) * (sum(bad)::DOUBLE / sum(n)::DOUBLE) AS s FROM {source})))"""


def judge_sql(rules: tuple[UrlRule, ...] = RULES, bound: float = BOUND, cut: float = CUT) -> str:
    def cases(value) -> str:
        whens = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in sorted(rules, key=lambda r: -len(r.name))]
        return f"CASE {' '.join(whens)} END"

    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    marked AS (SELECT *, {cases(lambda r: r.name)} AS rule, {cases(lambda r: r.verdict)} AS by_rule,
                      list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix FROM parts),
    hosts AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, count(*) FILTER (by_rule = 'block') AS bad FROM marked WHERE by_rule IS NOT NULL GROUP BY host),
    domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain),
    suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
    k AS (SELECT {_strength_sql('suffixes')} AS ks, {_strength_sql('domains')} AS kd, {_strength_sql('hosts')} AS kh,
                 coalesce((SELECT sum(bad)::DOUBLE / sum(n)::DOUBLE FROM hosts), 0.0) AS overall),
    rates AS (
      SELECT m.*, coalesce(h.n, 0) + kh AS weight,
             (coalesce(h.bad, 0) + kh * ((coalesce(d.bad, 0) + kd * ((coalesce(s.bad, 0) + ks * overall) / (coalesce(s.n, 0) + ks))) / (coalesce(d.n, 0) + kd))) / (coalesce(h.n, 0) + kh) AS rate
      FROM marked m CROSS JOIN k LEFT JOIN hosts h ON m.host = h.host LEFT JOIN domains d ON m.domain = d.domain LEFT JOIN suffixes s ON m.suffix = s.suffix)
    SELECT page_id, host, path, rule,
           coalesce(by_rule, CASE WHEN rate - {bound} * sqrt(rate * (1 - rate) / (weight + 1)) > {cut} THEN 'block' ELSE 'allow' END) AS verdict
    FROM rates"""
