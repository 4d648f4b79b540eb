"""URL filtering by empirical-Bayes host reputation.

Every labelled page is a good or bad outcome for its host. Hosts with few
outcomes borrow from their registered domain, domains from their suffix, and
suffixes from all pages: each level is a beta-binomial whose prior mean is the
shrunken rate of the level above, its own outcomes left out so that none counts
twice, and whose prior strength is estimated from the spread of the level's own
rates by the method of moments. A host is blocked when
the lower bound of its posterior bad rate, ``z`` standard deviations below the
mean, exceeds ``threshold``: little evidence never blocks.

Fixed rules come first: the longest rule that fits a page decides.

Only DataFrame functions are used. Outcomes are summed before any shuffle, so a
host with a third of all pages arrives as one row per task; pages meet host
verdicts in an equi-join that adaptive execution splits where a host is hot.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is judged like the host of all such pages; pages without an outcome
are judged by what is known of their host and the levels above; without any
outcome nothing is blocked; a page repeated, or with several labels, counts once
for each page row, bad if any label is; an empty table gives no rows; columns
other than the id and URL are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import persist, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Suffixes:
    """Under which suffixes names are registered.

    By rule: under a country's two letters, labels that name a kind of registrant
    make a suffix of two labels. ``also`` holds further suffixes of several labels,
    of which the longest that fits counts, ``never`` hosts that the rule would take
    for suffixes. Everything else is registered under its last label.
    """

    kinds: tuple[str, ...] = ("ac", "co", "com", "edu", "gob", "gov", "go", "gouv", "govt", "id", "info", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch", "school")
    also: tuple[str, ...] = ()
    never: tuple[str, ...] = ()

    def labels(self, host: Column) -> Column:
        """How many labels the suffix of a host has."""
        parts = F.split(host, r"\.")
        last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
        two = last.rlike(r"^[a-z]{2}\z") & F.coalesce(before.isin(*self.kinds), F.lit(False))
        if self.never:
            two = two & ~F.substring_index(host, ".", -2).isin(*self.never)
        found = F.when(two, 2).otherwise(1)
        for suffix in sorted(self.also, key=lambda s: s.count(".")):
            fits = (host == suffix) | F.endswith(host, F.lit("." + suffix))
            found = F.when(fits, suffix.count(".") + 1).otherwise(found)
        return found


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Reputation:
    """Parameters of the method."""

    threshold: float = 0.25
    z: float = 1.645
    least_strength: float = 1.0
    greatest_strength: float = 10_000.0
    suffixes: Suffixes = Suffixes()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between ``://`` and the path, and the path without query and fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes: Suffixes = Suffixes()) -> Column:
    """The labels under which names are registered."""
    return F.array_join(F.slice(F.split(host, r"\."), -F.least(suffixes.labels(host), F.size(F.split(host, r"\."))), F.lit(64)), ".")


def registered_domain(host: Column, suffixes: Suffixes = Suffixes()) -> Column:
    """The suffix and one label more."""
    return F.array_join(F.slice(F.split(host, r"\."), -F.least(suffixes.labels(host) + 1, F.size(F.split(host, r"\."))), F.lit(64)), ".")


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(getattr(rule, value))).otherwise(found)
    return found


def strength(children: DataFrame, mean: float, limits: Reputation) -> float:
    """Prior strength of a level from its children's outcomes (n, bad), by moments.

    The spread of the rates beyond binomial noise gives the correlation rho of
    outcomes under one child; the strength is (1 - rho) / rho within the limits.
    """
    if not 0 < mean < 1:
        return limits.greatest_strength
    rate = F.col("bad") / F.col("n")
    s = children.where("n > 0").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread")).first()
    free = (s["n"] - s["nn"] / s["n"] - (s["c"] - 1)) if s["c"] and s["c"] > 1 else 0
    if free <= 0:
        return limits.greatest_strength
    rho = (s["spread"] / (mean * (1 - mean)) - (s["c"] - 1)) / free
    return limits.greatest_strength if rho <= 0 else min(limits.greatest_strength, max(limits.least_strength, (1 - rho) / rho))


def host_verdicts(pages: DataFrame, outcomes: DataFrame, method: Reputation) -> DataFrame:
    """(host, bound, method_verdict) of every host of ``pages`` (page_id, host).

    ``outcomes`` holds (page_id, bad) with bad 0 or 1, one row for each page.
    """
    labelled = pages.join(outcomes, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = persist(hosts.withColumns({"domain": registered_domain(F.col("host"), method.suffixes), "suffix": suffix_of(F.col("host"), method.suffixes)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = whole["bad"] / whole["n"] if whole["n"] else 0.0
    m_suffix, m_domain, m_host = (strength(level, mean, method) for level in (suffixes, domains, hosts))
    above = suffixes.select("suffix", F.col("n").alias("ns"), F.col("bad").alias("bs"))
    by_domain = domains.select("domain", "suffix", F.col("n").alias("nd"), F.col("bad").alias("bd")).join(above, "suffix")
    suffix_mean = (F.col("bs") - F.col("bd") + m_suffix * mean) / (F.col("ns") - F.col("nd") + m_suffix)
    by_domain = by_domain.select("domain", "suffix", "nd", "bd", suffix_mean.alias("suffix_mean"))
    joined = hosts.join(by_domain, ["domain", "suffix"])
    domain_mean = (F.col("bd") - F.col("bad") + m_domain * F.col("suffix_mean")) / (F.col("nd") - F.col("n") + m_domain)
    a = F.col("bad") + m_host * domain_mean
    total = F.col("n") + F.lit(m_host)
    posterior = a / total
    bound = posterior - method.z * F.sqrt(posterior * (1 - posterior) / (total + 1))
    scored = joined.select("host", bound.alias("bound"))
    return scored.withColumn("method_verdict", F.when(F.col("bound") > method.threshold, "block").otherwise("allow"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, method: Reputation | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every page. ``outcomes`` holds (page_id, bad), repeats allowed."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    once = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    verdicts = persist(host_verdicts(parsed.select("page_id", "host"), once, method or Reputation()), "host-verdicts")
    ruled = parsed.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, "name"), "__ruled": rule_column(F.col("host"), F.col("path"), rules, "verdict")})
    judged = ruled.join(verdicts.select("host", "method_verdict"), "host", "left")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("__ruled", "method_verdict").alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page; an outcome is bad where the label says low quality or toxic."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


_KINDS = ", ".join(f"'{kind}'" for kind in Suffixes().kinds)


def _strength_sql(level: str) -> str:
    return f"""
  SELECT CASE WHEN p <= 0 OR p >= 1 OR c <= 1 OR n - nn / n - (c - 1) <= 0 THEN 10000.0
    WHEN (spread / (p * (1 - p)) - (c - 1)) <= 0 THEN 10000.0
    ELSE least(10000.0, greatest(1.0, (1 - (spread / (p * (1 - p)) - (c - 1)) / (n - nn / n - (c - 1)))
      / ((spread / (p * (1 - p)) - (c - 1)) / (n - nn / n - (c - 1))))) END AS m, p
  FROM (SELECT count(*) AS c, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS nn,
          sum(n * (bad / n - p) * (bad / n - p)) AS spread, min(p) AS p
        FROM {level}, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS p FROM hosts) WHERE n > 0)"""


ORACLE = f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), parts AS (
  SELECT page_id, host, string_split(host, '.') AS l FROM parsed
), named AS (
  SELECT page_id, host, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one,
         regexp_full_match(l[-1], '[a-z]{{2}}') AND len(l) > 1 AND coalesce(l[-2], '') IN ({_KINDS}) AS deep FROM parts
), hosts AS (
  SELECT host, CASE WHEN deep THEN three ELSE two END AS domain, CASE WHEN deep THEN two ELSE one END AS suffix,
         count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad
  FROM named LEFT JOIN outcomes USING (page_id) GROUP BY ALL
), domains AS (
  SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY ALL
), ms AS ({_strength_sql("suffixes")}), md AS ({_strength_sql("domains")}), mh AS ({_strength_sql("hosts")}),
by_domain AS (
  SELECT d.domain, d.suffix, d.n AS nd, d.bad AS bd, (s.bad - d.bad + m * p) / (s.n - d.n + m) AS suffix_mean FROM domains d JOIN suffixes s USING (suffix), ms
), priors AS (
  SELECT host, n, bad, (bd - bad + m * suffix_mean) / (nd - n + m) AS domain_mean FROM hosts JOIN by_domain USING (domain, suffix), md
), scored AS (
  SELECT host, (bad + m * domain_mean) / (n + m) AS post, n + m AS total FROM priors, mh
), verdicts AS (
  SELECT host, CASE WHEN post - 1.645 * sqrt(post * (1 - post) / (total + 1)) > 0.25 THEN 'block' ELSE 'allow' END AS method_verdict FROM scored
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE method_verdict END AS verdict
FROM ruled LEFT JOIN verdicts USING (host)
"""
