"""URL filter: fixed rules first, then empirical-Bayes host reputation, in DataFrame expressions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's rate is shrunk towards its parent's
by a beta-binomial prior: mean of the parent, strength estimated from the level's own spread by the method of moments. A host
without labels gets its nearest known parent's prior. A page is blocked if the lower bound of its host's posterior bad rate (mean less ``Z`` standard
deviations) is above ``MAX_BAD``.

Pages are counted by host and document before they meet the labels, and by host before the levels are estimated; the table of hosts is written once, and the
four scalars of the priors (one row each) come from it. The page table, read twice in all, meets it (one row per host) in an equi-join which Spark may
broadcast or split. Rules become one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

# Rules (verdict, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz"]
Z = 1.64
MAX_BAD = 0.3
#: Limits of the intra-level correlation, 1 / (strength + 1).
LEAST_RHO, MOST_RHO = 0.001, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """From the first :// up to the next slash, question mark or hash, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(h: Column) -> Column:
    return F.when(F.substring_index(h, ".", -2).isin(DOUBLE_SUFFIXES), F.substring_index(h, ".", -2)).otherwise(F.substring_index(h, ".", -1))


def registered(h: Column) -> Column:
    """The registered domain: one label above the suffix."""
    return F.when(F.substring_index(h, ".", -2).isin(DOUBLE_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def rule(h: Column, p: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule fits its host and all subdomains if the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _strength(level: DataFrame, mean: str) -> float:
    """Prior strength from how far the rates n, bad of a level spread about their parents' mean, beyond binomial noise."""
    m, n = F.col(mean), F.col("n")
    spread = F.sum(n * F.pow(F.col("bad") / n - m, 2)) - F.sum(m * (1 - m))
    room = F.sum((n - 1) * m * (1 - m))
    r = level.agg(spread.alias("spread"), room.alias("room")).first()
    rho = min(MOST_RHO, max(LEAST_RHO, r.spread / r.room)) if r.room else MOST_RHO
    return 1 / rho - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, bound) of every host in outcomes(host, bad, pages), bad being 0 or 1; null outcomes are unlabelled.

    Without a column pages every row counts once.
    """
    pages = F.col("pages") if "pages" in outcomes.columns else F.lit(1)
    counted = [F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), pages)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bad") * pages), F.lit(0)).alias("bad")]
    hosts = outcomes.groupBy("host").agg(*counted).withColumn("domain", registered(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    hosts = materialise(outcomes.sparkSession, hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    p0 = (whole.bad + 0.5) / (whole.n + 1) if whole.n else 0.5
    s_suffix = _strength(suffixes.filter("n > 0").withColumn("m", F.lit(p0)), "m")
    suffixes = suffixes.select("suffix", ((F.col("bad") + s_suffix * p0) / (F.col("n") + s_suffix)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix")
    s_domain = _strength(domains.filter("n > 0"), "suffix_mean")
    domains = domains.select("domain", "suffix", ((F.col("bad") + s_domain * F.col("suffix_mean")) / (F.col("n") + s_domain)).alias("domain_mean"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    s_host = _strength(hosts.filter("n > 0"), "domain_mean")
    mean = (F.col("bad") + s_host * F.col("domain_mean")) / (F.col("n") + s_host)
    hosts = hosts.withColumn("mean", mean)
    return hosts.withColumn("bound", F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s_host + 1))).select("host", "domain", "suffix", "n", "bad", "mean", "bound")


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad, pages) by host and document number: bad if the document that its path numbers has low quality or is toxic; null without label.

    pages(url) name their document by the first number that is a whole path segment, up to a dot; labels(doc_id, quality, toxic). Of a document's repeated labels the worst counts.
    """
    worst = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    url = F.col("url")
    named = pages.select(host(url).alias("host"), F.regexp_extract(path(url), r"/(\d{1,18})(?:[./]|$)", 1).alias("d")).select("host", F.when(F.col("d") != "", F.col("d").cast("long")).alias("doc"))
    counted = named.groupBy("host", "doc").agg(F.count("*").alias("pages"))
    # Pages without a number join nothing; they keep off the shuffle.
    return counted.filter("doc is not null").join(worst, "doc", "left").select("host", "bad", "pages").unionByName(counted.filter("doc is null").select("host", F.lit(None).cast("int").alias("bad"), "pages"))


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, bound of every row of pages(page_id, url).

    A null url or one without :// has empty host and path and is judged as the empty host. Repeated rows repeat; empty tables
    give an empty result or, without labels, the even prior.
    """
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    known = reputation(outcomes(pages, labels)).select("host", "mean", "bound")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    mine = F.when(F.col("bound") > MAX_BAD, "block").otherwise("allow")
    return rows.join(known, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, mine).alias("verdict"), "mean", "bound")
