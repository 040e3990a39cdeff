"""URL filter: rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted per host. The share of good
pages of a host has a beta prior whose mean is that of its registered domain,
whose prior in turn has the mean of its suffix, and that the mean of all pages.
The weight of a prior (how many pages it counts for) is estimated by the method
of moments from how far the groups of a level lie apart. A url is blocked if the
upper bound of its group's posterior stays below the wanted share of good pages:
little evidence never blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.session import stage

MIN_WEIGHT, MAX_WEIGHT = 1.0, 10_000.0


@dataclass(frozen=True)
class Rule:
    """`host/path...`: fits the host and its subdomains where the url's path starts with the rule's path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end; empty without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(pattern, verdict) of the longest rule that fits, or null. Ties go to the longer host, then to block."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), -len(r.host), r.verdict != "block"))
    pick = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pick = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(pick)
    return pick


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def domain_of(host: Column, deep_suffixes: Sequence[str] = ()) -> Column:
    """Registered domain: the label before the suffix. `deep_suffixes` are suffixes of two labels, such as co.uk."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    if not deep_suffixes:
        return two
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*deep_suffixes), three).otherwise(two)


def _posterior(groups: DataFrame, name: str, prior: Column) -> DataFrame:
    """Adds the posterior `a_<name>`, `b_<name>` and its mean `m_<name>` to (n, good) groups whose prior mean is `prior`.

    Weight by moments: with shares x, sizes n and prior means m, the excess of sum n (x - m)^2 over its binomial part
    sum m (1 - m) is sum (n - 1) m (1 - m) / (1 + weight). The driver reads the three sums.
    """
    m, n = prior, F.col("n").cast("double")
    noise, some = m * (1 - m), F.col("n") > 0
    r = groups.agg(F.sum(F.when(some, n * F.pow(F.col("good") / n - m, 2))).alias("s"), F.sum(F.when(some, noise)).alias("e"),
                   F.sum(F.when(some, (n - 1) * noise)).alias("d")).first()
    rho = (r["s"] - r["e"]) / r["d"] if r["d"] else 0.0
    weight = min(max(1 / rho - 1, MIN_WEIGHT), MAX_WEIGHT) if rho > 0 else MAX_WEIGHT
    a, b = weight * m + F.col("good"), weight * (1 - m) + n - F.col("good")
    return groups.withColumns({f"a_{name}": a, f"b_{name}": b, f"m_{name}": a / (a + b)})


def host_reputation(outcomes: DataFrame, deep_suffixes: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """host, n, good, a_host, b_host, m_host, low, high from (host, outcome) rows; a null outcome is an unlabelled page.

    `low` and `high` bound the posterior share of good pages, `z` standard deviations from its mean.
    """
    counts = outcomes.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double").alias("good"))
    hosts = stage(counts.withColumns({"domain": domain_of(F.col("host"), deep_suffixes), "suffix": suffix_of(F.col("host"))}), "hosts")

    def sums(df, *by):
        return df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    total = sums(hosts).first()
    mean = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] is not None else 0.5
    suffixes = stage(_posterior(sums(hosts, "suffix"), "suffix", F.lit(mean)).select("suffix", "m_suffix"), "suffixes")
    domains = sums(hosts, "suffix", "domain").join(suffixes, "suffix")
    domains = stage(_posterior(stage(domains, "domains"), "domain", F.col("m_suffix")).select("domain", "m_domain"), "domains")
    hosts = _posterior(stage(hosts.join(domains, "domain"), "hosts"), "host", F.col("m_domain"))
    a, b = F.col("a_host"), F.col("b_host")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "good", "a_host", "b_host", "m_host", F.greatest(F.col("m_host") - z * sd, F.lit(0.0)).alias("low"),
                        F.least(F.col("m_host") + z * sd, F.lit(1.0)).alias("high"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], min_good: float = 0.5, z: float = 1.96,
               deep_suffixes: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict, and the host's n, good, m_host, low, high.

    `labels` has (page id, outcome 1/0/null), any number of rows per page; a page's outcome is their mean. A null url,
    or one without `://`, has empty host and path and is judged by the reputation of the empty host. Each row of
    `pages` gives one row; a hot host is on the many side of a join whose other side has one row per host.
    """
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known = labels.select(F.col(id_col), F.col("outcome").cast("double").alias("outcome")).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg("outcome").alias("outcome"))
    seen = urls.select(id_col, "host").join(known, id_col, "left")
    reputation = stage(host_reputation(seen, deep_suffixes, z).select("host", "n", "good", "m_host", "low", "high"), "reputation")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("high") < min_good, "block").otherwise("allow")
    out = urls.join(reputation, "host", "left").withColumn("__fit", fit)
    return out.select(id_col, "host", "path", F.col("__fit.pattern").alias("rule"), F.coalesce("__fit.verdict", by_host).alias("verdict"),
                      F.coalesce("n", F.lit(0)).alias("n"), "good", "m_host", "low", "high")
