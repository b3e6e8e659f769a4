"""Empirical-Bayes host reputation, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second labels under which a country's domains are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
#: Strength of a prior where its children show no spread to estimate it from, and its bounds.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 1000.0


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and the path's start."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where registrations are made below a second one."""
    labels = F.split(host, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return F.when(second.isin(*SECOND_LEVEL) & last.rlike("^[a-z][a-z]$"), F.concat(second, F.lit("."), last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it."""
    suffix = suffix_of(host)
    before = F.substring_index(F.substr(host, F.lit(1), F.length(host) - F.length(suffix) - 1), ".", -1)
    return F.when(F.length(host) > F.length(suffix), F.concat(before, F.lit("."), suffix)).otherwise(host)


def _strength(children: DataFrame, parent: list[str]) -> DataFrame:
    """Of each parent the counts and the strength of its beta prior, by the moments of its children.

    With m children of n_i pages and q the parent's rate, the between-children variance is what the
    squared distances n_i (p_i - q)^2 exceed their binomial expectation by; strength is
    q (1 - q) / variance - 1, within bounds. Every sum is a partial aggregate.
    """
    totals = children.groupBy(*parent).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("m"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s1"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    q = F.col("bad") / F.col("n")
    spread = F.col("s1") - F.col("bad") * F.col("bad") / F.col("n")
    between = (spread - (F.col("m") - 1) * q * (1 - q)) / (F.col("n") - F.col("n2") / F.col("n"))
    return totals.select(*parent, "n", "bad", F.when(
        (F.col("m") < 2) | (q <= 0) | (q >= 1), F.lit(STRENGTH)).when(between <= 0, F.lit(STRONGEST)).otherwise(
        F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), q * (1 - q) / between - 1))).alias("strength"))


def _rate(n: str, bad: str, strength: str, prior: Column) -> Column:
    return (F.col(bad) + F.col(strength) * prior) / (F.col(n) + F.col(strength))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, a, b): beta posterior of each host's bad share.

    outcomes: (host, bad 0/1), one row per labelled page. Counts go up from host to registered domain
    to suffix to all; rates come down: a suffix shrinks to the overall rate, a domain to its suffix,
    a host to its domain, each with the strength estimated from the level's own spread.
    """
    hosts = (outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
             .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domains = _strength(hosts, ["domain", "suffix"])
    suffixes = _strength(domains.select("suffix", "n", "bad"), ["suffix"])
    whole = _strength(suffixes.select("n", "bad"), []).select(F.struct("n", "bad", "strength").alias("w")).scalar()
    levels = (suffixes.withColumn("w", whole)
              .select("suffix", "strength", _rate("n", "bad", "w.strength", F.col("w.bad") / F.col("w.n")).alias("rate")))
    shrunk = (domains.join(levels.select("suffix", F.col("strength").alias("ss"), "rate"), "suffix")
              .select("domain", F.col("strength").alias("ds"), _rate("n", "bad", "ss", F.col("rate")).alias("drate")))
    return (hosts.join(shrunk, "domain")
            .select("host", "domain", "suffix", "n", "bad", (F.col("bad") + F.col("ds") * F.col("drate")).alias("a"),
                    (F.col("n") - F.col("bad") + F.col("ds") * (1 - F.col("drate"))).alias("b")))


def bounded(reputation: DataFrame, limit: float, deviations: float) -> DataFrame:
    """Hosts to block: the posterior's mean less so many standard deviations is above limit."""
    total = F.col("a") + F.col("b")
    lower = F.col("a") / total - deviations * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return reputation.where(lower > limit).select("host", lower.alias("lower_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", limit: float = 0.5, deviations: float = 1.64) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages.

    The longest fitting rule decides; without one a page is blocked if its host's reputation is bad
    beyond doubt (bounded), else allowed, so unknown hosts and empty tables of outcomes allow. A null
    url or one without :// has an empty host and path. outcomes: (host, bad); rows with a null in
    either take no part. Repeated rows come back as often as given.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seen = pages.select(id_col, host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    known = outcomes.where("host is not null and bad is not null and host != ''")
    blocked = bounded(reputations(known), limit, deviations).select("host", F.lit("block").alias("found"))
    return (seen.join(blocked, "host", "left")
            .select(id_col, "host", "path", rule.alias("rule"),
                    F.coalesce(said, F.col("found"), F.lit("allow")).alias("verdict")))
