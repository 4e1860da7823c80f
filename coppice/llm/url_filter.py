"""Operator 9: urls judged by rules, else by empirical-Bayes host reputation.

Labelled pages give each host a count of good and bad outcomes. A host's bad rate has a beta prior around its
registered domain's posterior rate, a domain's around its suffix's, a suffix's around the overall rate; the strength of
each prior comes from the spread of the children's rates (method of moments) and is limited by how well the parent's
rate itself is known. A host is blocked when the lower posterior bound of its bad rate is above a threshold. All counts are grouped aggregations; only a row a host is joined
back, salted, so that a host with a third of all pages is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.plans.materialize import table

#: Suffixes of two labels under which names are registered.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.ar")
SALTS = 16
STRENGTH = (1.0, 1000.0)  # bounds of a prior's strength
FEW = (0.5, 9.5)  # bad and good outcomes assumed before any is seen


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def suffix_and_domain(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> tuple[Column, Column]:
    """The suffix under which names are registered (one label, or one of two_labels), and the registered domain."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last_two = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    double = last_two.isin(*two_labels) & (n > 2)
    suffix = F.when(double, last_two).otherwise(F.element_at(labels, -1))
    domain = F.when(double, F.concat_ws(".", F.slice(labels, F.greatest(n - 2, F.lit(1)), 3))).otherwise(last_two)
    return suffix, domain


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host or a parent domain, path's start) and its verdict; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):  # later ones override
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.host + r.path).otherwise(text)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def shrink(counts: DataFrame, child: str, parent: str, above: DataFrame) -> DataFrame:
    """Posterior of each child: counts(child, parent, n, bad) shrunk to above(parent, rate).

    The strength comes from all children of the level by moments: sum of n (p - m)^2 - m (1 - m) over sum of
    (n - 1) m (1 - m) estimates the correlation within a child, rho; 1 / rho - 1 is the strength, within STRENGTH. One
    child with outcomes doesn't tell how children differ: the strength is then the least. The parent's mean is itself
    uncertain; variances add, so a strength s below a posterior of size a counts as s a / (s + a).
    Adds alpha, beta, rate.
    """
    rows = counts.join(above.select(parent, F.col("rate").alias("mean"), (F.col("alpha") + F.col("beta")).alias("sure")), parent)
    p = F.col("bad") / F.col("n")
    noise = F.col("mean") * (1 - F.col("mean"))
    level = rows.where("n > 0").agg(F.sum(F.col("n") * (p - F.col("mean")) ** 2 - noise).alias("extra"), F.sum((F.col("n") - 1) * noise).alias("room"), F.count("*").alias("seen"))
    rho = F.coalesce(F.try_divide("extra", "room"), F.lit(0.0))
    level = level.select(F.when(F.col("seen") < 2, STRENGTH[0]).when(rho <= 0, STRENGTH[1]).otherwise(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / rho - 1))).alias("strength"))
    rows = rows.crossJoin(F.broadcast(level))  # one row
    rows = rows.withColumn("strength", F.col("strength") * F.col("sure") / (F.col("strength") + F.col("sure")))
    rows = rows.withColumn("alpha", F.col("strength") * F.col("mean") + F.col("bad")).withColumn("beta", F.col("strength") * (1 - F.col("mean")) + F.col("n") - F.col("bad"))
    return rows.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("mean", "strength", "sure")


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float) -> DataFrame:
    """host, n, bad, rate, bound for each host of hosts(host, domain, suffix); outcomes(host, bad): labelled pages."""
    labelled = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    known = table(hosts.join(labelled, "host", "left").fillna(0, ["n", "bad"]), "hosts")  # a row a host; all levels are sums of it
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = known.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(0))
    root = suffixes.groupBy("root").agg(*sums).withColumn("alpha", F.col("bad") + FEW[0]).withColumn("beta", F.col("n") - F.col("bad") + FEW[1])
    root = root.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    by_suffix = table(shrink(suffixes, "suffix", "root", root), "suffixes")
    by_domain = table(shrink(domains, "domain", "suffix", by_suffix), "domains").withColumnRenamed("suffix", "domain_suffix")
    found = shrink(known.drop("suffix"), "host", "domain", by_domain)
    size = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    return found.select("host", "n", "bad", "rate", (F.col("rate") - z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", threshold: float = 0.3, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound for each row of pages.

    outcomes(host, bad 0/1) are labelled pages. verdict is the longest fitting rule's, else 'block' where the host's
    lower posterior bound (mean less z deviations) exceeds the threshold, else 'allow'. A null url has empty host and
    path; empty hosts are one host. two_labels: the suffixes of two labels, as of a public list. Repeated rows are each judged; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    suffix, domain = suffix_and_domain(F.col("host"), two_labels)
    hosts = rows.select("host").distinct().withColumn("suffix", suffix).withColumn("domain", domain)
    known = reputation(outcomes, hosts, z).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = salted.join(known, ["host", "salt"])
    own = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("rate", 9).alias("bad_rate"), F.round("bound", 9).alias("bound"))
