"""URL filters: rules first, else an empirical-Bayes reputation of the host.

Labelled outcomes of pages are shrunk through beta-binomial priors, from host to registered domain to suffix to all pages;
a host is blocked if the lower bound of its posterior rate of bad pages is above a threshold. Only DataFrame functions are
used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.plans.shared import stash

THRESHOLD, Z = 0.5, 1.645
# Suffixes of two labels, below which domains are registered.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty if the url is null or has no `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (`host/path`) that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_levels(hosts: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """`hosts` with the registered domain and the suffix of column host; a host of one label is its own domain. `suffixes`
    are those of two labels, a table (suffix) of them if there are many."""
    labels = F.split(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", ""), r"\.")
    out = hosts.withColumn("_l", labels)
    out = out.withColumn("_two", F.array_join(F.slice("_l", F.greatest(F.size("_l") - 1, F.lit(1)), F.lit(2)), "."))
    if isinstance(suffixes, DataFrame):
        listed = suffixes.select(F.col("suffix").alias("_two"), F.lit(True).alias("_listed")).distinct()
        out, known = out.join(listed, "_two", "left"), F.coalesce("_listed", F.lit(False))
    else:
        known = F.col("_two").isin(*suffixes)
    n = F.when(known & (F.size("_l") > 2), 2).otherwise(1)

    def tail(k: Column) -> Column:
        k = F.least(k, F.size("_l"))
        return F.array_join(F.slice("_l", F.size("_l") - k + 1, k), ".")

    return out.select(*hosts.columns, tail(n + 1).alias("domain"), tail(n).alias("suffix"))


def _strength(children: DataFrame, mean: str) -> float:
    """Prior strength of a level by moments: how many labelled pages its parent's rate is worth. `children` has n, x and
    the parent's rate."""
    m = F.col(mean)
    spread = F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - m, 2))
    alone, more = F.sum(m * (1 - m)), F.sum((F.col("n") - 1) * m * (1 - m))
    s, a, b = children.filter(F.col("n") > 0).agg(spread, alone, more).first()
    rho = (s - a) / b if b else 0.0
    return 1 / min(0.5, max(0.001, rho)) - 1


def reputations(hosts: DataFrame, outcomes: DataFrame, *, z: float = Z, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """(host, n, x, rate, lower) for each of `hosts` (host, distinct) from `outcomes` (host, bad as 0 or 1).

    Counts are summed before any join, so a host of a third of all pages is one row. Hosts without outcomes have their
    domain's rate, domains without any their suffix's, suffixes without any that of all pages; without outcomes at all
    the rate is one half."""
    seen = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("x"))
    seen = stash(with_levels(seen, suffixes), "host-outcomes")  # each level's prior reads it
    total, bad = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("x"), F.lit(0))).first()
    mean = (bad + 1) / (total + 2)

    def level(name: str) -> DataFrame:
        return seen.groupBy(name).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))

    def shrunk(strength: float, parent: Column) -> Column:
        return (F.coalesce("x", F.lit(0)) + strength * parent) / (F.coalesce("n", F.lit(0)) + strength)

    top = level("suffix").withColumn("m", F.lit(mean))
    top = top.select("suffix", shrunk(_strength(top, "m"), F.col("m")).alias("suffix_rate"))
    mid = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(top, "suffix")
    mid = mid.select("domain", shrunk(_strength(mid, "suffix_rate"), F.col("suffix_rate")).alias("domain_rate"))
    strength = _strength(seen.join(mid, "domain"), "domain_rate")
    every = with_levels(hosts.select("host"), suffixes).join(seen.select("host", "n", "x"), "host", "left").join(mid, "domain", "left").join(top, "suffix", "left")
    rate = shrunk(strength, F.coalesce("domain_rate", "suffix_rate", F.lit(mean)))
    every = every.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0)).alias("x"), rate.alias("rate"))
    return every.withColumn("lower", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1)))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str], *, threshold: float = THRESHOLD, z: float = Z, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n, rate, lower) of every row of `pages`: n labelled pages of its host, the mean
    and the lower bound of its posterior.

    `labels` (doc_id, quality, toxic) label the pages of the same id; a page is bad if its quality is 0 or it is toxic;
    nulls there count as good, null ids label nothing. Repeated pages are judged each, repeated labels count each; urls of
    any length are read whole; no pages give no rows."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    outcomes = parsed.select("page_id", "host").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id")
    known = reputations(parsed.select("host").distinct(), outcomes, z=z, suffixes=suffixes).select("host", "n", "rate", "lower")
    known = stash(known, "reputations")  # read by an exchange of its own, so that the pages of one host can be split
    judged = parsed.join(known, "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    verdict = F.coalesce(verdicts, F.when(F.col("lower") > threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n", "rate", "lower")
