"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Rules name a host and a path prefix and decide pages directly. All other pages
are judged by their host's share of good outcomes among labelled pages, those of
a host without any by its registered domain's, else its suffix's, else that of
all pages. The share is beta-binomial: the prior of a host is its registered domain, that of a
domain its suffix, that of a suffix all labelled pages. At each level the prior
counts as ``strength`` pages, estimated from how much the shares of the level's
members differ (method of moments), so levels that agree shrink much and levels
that differ shrink little. A prior never counts for more pages than there are
behind it. A host is blocked only if it is surely bad: if the
upper posterior bound, mean + ``z`` standard deviations, is below ``least``.

Only DataFrame functions are used. Outcomes are counted per host before any
join, so a host with a third of all pages is one row in every join. Tables of
hosts are joined by Spark's choice; pages meet them in one join on the host.

A NULL URL or one without ``://`` has an empty host and path, fits no rule, and
has all pages as its prior. Outcomes with a NULL value are left out; without any
outcome the share is 1/2 and nothing is blocked. Repeated pages each get a row.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Second-level labels under which domains are registered, before a country code.
#: Fixed values.
PUBLIC_SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``target`` is a host, then a path prefix from its first slash on."""

    target: str
    verdict: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2] if "/" in self.target else ""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """``com`` of ``a.b.com``, ``co.uk`` of ``a.b.co.uk``."""
    second = "|".join(PUBLIC_SECOND_LEVEL)
    return F.regexp_extract(host, rf"((?:(?<=\.)(?:{second})\.[a-z]{{2}}|[^.]*))$", 1)


def domain_of(host: Column) -> Column:
    """The label before the suffix, with the suffix; the host itself if there is none."""
    second = "|".join(PUBLIC_SECOND_LEVEL)
    domain = F.regexp_extract(host, rf"([^.]+\.(?:(?:{second})\.[a-z]{{2}}|[^.]+))$", 1)
    return F.when(domain == "", host).otherwise(domain)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or NULL; a short list written into the plan."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.target)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, rule.target).otherwise(found)
    return found


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(rule == r.target, r.verdict).otherwise(verdict)
    return verdict


def _strength(members: DataFrame, by: list[str]) -> DataFrame:
    """Pages that the prior of each group counts for, from the spread of its members.

    With shares of mean m, the variance between members beyond the binomial part
    is v = m(1-m) / (strength + 1). Kept within 1 and 1000.
    """
    share = F.col("good") / F.col("n")
    mean = F.sum("good") / F.sum("n")
    groups = members.groupBy(*by).agg(
        F.sum("good").alias("group_good"), F.sum("n").alias("group_n"), mean.alias("m"),
        F.sum(F.col("n") * share * share).alias("squares"), F.count("*").alias("members"),
        F.sum(F.col("n") * F.col("n")).alias("n_squares"),
    )
    variance = F.col("m") * (1 - F.col("m"))
    within = (F.col("members") - 1) * variance
    between = F.col("squares") - F.col("group_n") * F.col("m") * F.col("m")
    scale = F.col("group_n") - F.col("n_squares") / F.col("group_n")
    # Members of one page each, or of one share, say nothing about the spread.
    rho = F.try_divide(between - within, (scale - (F.col("members") - 1)) * variance)
    rho = F.greatest(F.least(F.coalesce(rho, F.lit(0.0)), F.lit(0.5)), F.lit(1 / 1001))
    return groups.select(*by, "group_good", "group_n", (1 / rho - 1).alias("strength"))


def _upper(a: Column, b: Column, z: float) -> Column:
    """The upper bound of a beta posterior."""
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.least(a / (a + b) + z * deviation, F.lit(1.0))


def reputations(outcomes: DataFrame, *, z: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior of every host, and of every domain, suffix and all pages for hosts not seen.

    ``outcomes`` has ``host`` and ``good`` (1 or 0).
    """
    labelled = outcomes.where(F.col("good").isNotNull() & F.col("host").isNotNull())
    hosts = labelled.groupBy("host").agg(
        F.sum(F.col("good").cast("double")).alias("good"), F.count("*").cast("double").alias("n")
    )
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = _strength(hosts, ["domain", "suffix"])
    as_members = domains.select("domain", "suffix", F.col("group_good").alias("good"), F.col("group_n").alias("n"))
    suffixes = _strength(as_members, ["suffix"])
    as_members = suffixes.select("suffix", F.col("group_good").alias("good"), F.col("group_n").alias("n"))
    everything = _strength(as_members.withColumn("all", F.lit(0)), ["all"]).drop("all")

    # One row for all pages, joined by key, so that every share has a prior.
    everything = everything.select(
        F.lit(0).alias("root"), ((F.col("group_good") + 1) / (F.col("group_n") + 2)).alias("root_mean"),
        F.col("strength").alias("root_strength"),
    )
    suffixes = suffixes.withColumn("root", F.lit(0)).join(everything, "root").select(
        "suffix", F.least("strength", F.col("group_n") + F.col("root_strength")).alias("suffix_strength"),
        ((F.col("group_good") + F.col("root_strength") * F.col("root_mean")) / (F.col("group_n") + F.col("root_strength"))).alias("suffix_mean"),
    )
    domains = domains.join(suffixes, "suffix").select(
        "domain", F.least("strength", F.col("group_n") + F.col("suffix_strength")).alias("domain_strength"),
        ((F.col("group_good") + F.col("suffix_strength") * F.col("suffix_mean")) / (F.col("group_n") + F.col("suffix_strength"))).alias("domain_mean"),
    )
    a = F.col("good") + F.col("domain_strength") * F.col("domain_mean")
    b = F.col("n") - F.col("good") + F.col("domain_strength") * (1 - F.col("domain_mean"))
    hosts = hosts.join(domains, "domain").select(
        "host", (a / (a + b)).alias("mean"), _upper(a, b, z).alias("upper")
    )
    return hosts, domains, suffixes, everything


def _prior(level: DataFrame, name: str, z: float) -> DataFrame:
    """What a member of a level that was not seen is expected to be."""
    mean, strength = F.col(f"{name}_mean"), F.col(f"{name}_strength")
    return level.select(name, mean, _upper(strength * mean, strength * (1 - mean), z).alias(f"{name}_upper"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], *, z: float = 2.0, least: float = 0.5
) -> DataFrame:
    """Host, path, rule, verdict and the host's posterior share for every page.

    A host without outcomes is judged by its prior alone.
    """
    parsed = with_host(pages, rules)
    hosts, domains, suffixes, everything = reputations(outcomes, z=z)
    # Priors meet the distinct hosts, so pages are still joined once.
    named = parsed.select("host").distinct().withColumns(
        {"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host")), "root": F.lit(0)}
    )
    named = named.join(hosts, "host", "left").join(_prior(domains, "domain", z), "domain", "left")
    named = named.join(_prior(suffixes, "suffix", z), "suffix", "left")
    named = named.join(F.broadcast(_prior(everything, "root", z)), "root", "left")
    named = named.select("host", *[
        F.coalesce(own, F.col(f"domain_{own}"), F.col(f"suffix_{own}"), F.col(f"root_{own}")).alias(own)
        for own in ("mean", "upper")
    ])
    judged = parsed.join(named, "host", "left")
    by_host = F.when(F.coalesce(F.col("upper"), F.lit(1.0)) < least, BLOCK).otherwise(ALLOW)
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), by_host).alias("verdict"),
        F.col("mean").alias("good_share"), F.col("upper").alias("good_share_upper"),
    )


def with_host(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def rule_outcomes(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pages that a rule decides, as labelled outcomes of their hosts."""
    decided = with_host(pages, rules).where("rule is not null")
    return decided.select("host", (verdict_of(F.col("rule"), rules) == ALLOW).cast("int").alias("good"))
