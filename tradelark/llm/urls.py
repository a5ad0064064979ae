"""Empirical-Bayes host reputation for URL filtering.

A page's outcome (1 bad, 0 good) is known where a rule decides it. The bad rate of every
host is shrunk through beta-binomial priors: the suffix towards the rate of all labelled
pages, the registered domain towards its suffix, the host towards its domain. How
strongly a level follows the one above is estimated from the spread between its groups
(method of moments). A page without a rule is blocked when the lower bound of its host's
posterior bad rate reaches the threshold, so a host without evidence passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelark.plans.staging import staged

# Fixed values of the contract: verdict, host, start of the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The share of a group's spread that is its own lies within these bounds; without two
# labelled pages in any group it is the middle.
LEAST_OWN, MOST_OWN, UNKNOWN_OWN = 0.001, 0.999, 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, domain, start in sorted(rules, key=lambda rule: (len(rule[1] + rule[2]), rule[1] + rule[2])):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


def _strength(groups: DataFrame, rate: str) -> float:
    """Pseudo-counts with which a level's prior weighs, from the spread of its groups.

    The squared distance of a group's rate from its prior's is worth rate * (1 - rate)
    * (1 + (n - 1) * own) in expectation, summed with weights n.
    """
    noise = F.col(rate) * (1 - F.col(rate))
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(rate), 2)
    labelled = groups.where("n > 0").agg(
        F.sum(spread).alias("spread"), F.sum(noise).alias("noise"), F.sum(noise * (F.col("n") - 1)).alias("extra")
    )
    own = F.when(F.col("extra") > 0, (F.col("spread") - F.col("noise")) / F.col("extra")).otherwise(UNKNOWN_OWN)
    bounded = F.greatest(F.lit(LEAST_OWN), F.least(F.lit(MOST_OWN), own))
    return labelled.select(1 / bounded - 1).first()[0]


def host_reputation(pages: DataFrame) -> DataFrame:
    """Per host of ``pages`` (host, outcome; null where unknown): n, bad, posterior rate and sd."""
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    # Written once: the levels below read one row per host, never the pages again, and the
    # driver sees one number per level.
    hosts = staged(hosts, "host-outcomes")
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((bad or 0) + 0.5) / ((n or 0) + 1)

    def shrink(groups: DataFrame, prior: str, rate: str) -> DataFrame:
        return groups.withColumn("weight", F.lit(_strength(groups, prior))).withColumn(
            rate, (F.col("weight") * F.col(prior) + F.col("bad")) / (F.col("weight") + F.col("n"))
        )

    suffixes = shrink(suffixes.withColumn("all_rate", F.lit(overall)), "all_rate", "suffix_rate")
    domains = shrink(domains.join(suffixes.select("suffix", "suffix_rate"), "suffix"), "suffix_rate", "domain_rate")
    hosts = shrink(hosts.join(domains.select("domain", "suffix", "domain_rate"), ["domain", "suffix"]), "domain_rate", "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + F.col("n") + 1))
    return hosts.select("host", "n", "bad", "rate", sd.alias("sd"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, z: float = 1.645, threshold: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    A null url, or one without ://, has an empty host and path and is judged like a host
    of that name. Repeated rows are judged each; other columns are ignored. An empty
    table gives an empty result. ``z`` is the number of standard deviations between the
    posterior mean and its lower bound.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "decision": decision})
    outcome = F.when(F.col("decision") == "block", 1).when(F.col("decision") == "allow", 0)
    standing = host_reputation(ruled.select("host", outcome.alias("outcome")))
    known = standing.select("host", (F.col("rate") - z * F.col("sd") >= threshold).alias("bad_host"))
    method = F.when(F.col("bad_host"), "block").otherwise("allow")
    return ruled.join(known, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("decision", method).alias("verdict")
    )
