"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each level is shrunk towards the one above it by
a beta-binomial prior: the prior's mean is the posterior mean above, its strength is estimated from how much the units of
that level differ (method of moments). A host is blocked if its share of bad pages lies above the limit, TIMES as much as
that of all labelled pages, with posterior probability 1 - DOUBT, by the exact beta distribution; so hosts with little
evidence are judged by their domain and suffix, and none is blocked on thin evidence. Where labels don't differ by host,
priors are strong and no host is blocked.

For reputation the port is dropped; the suffix is the longest one of the suffix table that the host ends with, else its last
label; the registered domain has one label more; addresses are domains and suffixes of their own.

Cases: a null url, or one without ://, has empty host and path, fits no rule and is judged as a host of its own; hosts
without labels have their domain's or suffix's prior; pages with several outcomes count once, as bad if any is; without
any labels nothing but the rules blocks; repeated rows each get a row; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut, lower_ascii
from matchlake.llm.quality import let, log_gamma

#: (verdict, host, path): each holds for its host and all subdomains, for paths that start with its path; the longest wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Public suffixes of several labels; others are a host's last label.
SUFFIXES = tuple(f"{k}.{c}" for c, kinds in {"uk": "ac co gov ltd me net nhs org plc sch", "au": "com edu gov id net org", "nz": "ac co govt net org", "za": "ac co gov org", "jp": "ac co ed go ne or", "kr": "ac co go or", "in": "ac co gov net org", "br": "com edu gov net org", "mx": "com edu gob org", "ar": "com edu gob org", "cn": "ac com edu gov net org", "tw": "com edu gov org", "tr": "com edu gov org", "il": "ac co gov org"}.items() for k in kinds.split())
#: The limit as a multiple of all labelled pages' share of bad ones; the posterior probability of less that a block may have.
TIMES, DOUBT = 2.0, 0.05
#: Steps of the continued fraction of the beta distribution: enough for priors of 10,000 pages.
FRACTION = 400
#: The whole corpus' prior, and any without labels: so many pages, half of them bad; and the least and largest strength of other priors.
ROOT, STRENGTHS = 2.0, (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(after, "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def strength(units: DataFrame, mean: str) -> float:
    """How many pages the prior of such units is worth, from n, x (bad) and the mean that each is shrunk to: one number to the driver."""
    p, m = F.col("x") / F.col("n"), F.col(mean)
    spread, noise, share = (
        units.where("n > 0")
        .agg(
            F.sum(F.col("n") * (p - m) * (p - m)) / F.sum("n"),
            F.sum(F.col("n") * m * (1 - m)) / F.sum("n"),
            F.count("*") / F.sum("n"),  # one over the mean number of pages
        )
        .first()
    )
    if spread is None:
        return ROOT
    if (between := spread - noise * share) <= 0:
        return STRENGTHS[1]
    return max(STRENGTHS[0], min(STRENGTHS[1], (noise - spread) / between))


def shrunk(units: DataFrame, mean: str) -> DataFrame:
    """units with post, their posterior mean, and weight, the pages that it rests on."""
    m = strength(units, mean)
    return units.withColumn("weight", F.col("n") + m).withColumn("post", (F.col("x") + F.col(mean) * m) / F.col("weight"))


def without_port(host: Column) -> Column:
    return F.regexp_replace(host, ":[0-9]*$", "")


def log_gamma_above_0(x: Column) -> Column:
    return log_gamma(x + 1) - F.log(x)


def beta_below(a: Column, b: Column, top: Column) -> Column:
    """The probability of a beta distribution below top, by its continued fraction, from the side where this converges fast."""

    def fraction(s: Column) -> Column:
        a, b, z = s["a"], s["b"], s["z"]

        def step(f: Column, k: Column) -> Column:
            even = k * (b - k) * z / ((a + 2 * k - 1) * (a + 2 * k))
            odd = -(a + k) * (a + b + k) * z / ((a + 2 * k) * (a + 2 * k + 1))
            c, d = 1 + even / f["c"], 1 / (1 + even * f["d"])
            return F.struct((1 + odd / c).alias("c"), (1 / (1 + odd * d)).alias("d"), (f["f"] * d * c * (1 + odd / c) / (1 + odd * d)).alias("f"))

        first = 1 / (1 - (a + b) * z / (a + 1))
        f = F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION)), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f")), step, lambda f: f["f"])
        front = log_gamma_above_0(a + b) - log_gamma_above_0(a) - log_gamma_above_0(b) + a * F.log(z) + b * F.log(1 - z)
        return F.exp(front) * f / a

    lower = top < (a + 1) / (a + b + 2)
    sides = F.struct(F.when(lower, a).otherwise(b).alias("a"), F.when(lower, b).otherwise(a).alias("b"), F.when(lower, top).otherwise(1 - top).alias("z"))
    tail = let(sides, fraction)
    return F.when(lower, tail).otherwise(1 - tail)


def reputation(hosts: DataFrame, suffixes: tuple = SUFFIXES, times: float = TIMES) -> DataFrame:
    """hosts (host, without a port; n, x) with domain, suffix, the posterior mean, the limit, and the posterior probability below it. suffixes: those of several labels."""
    host = F.col("host")
    part = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, F.size(part)), "."))
    suffix = F.coalesce(F.get(F.filter(tails, lambda t: t.isin(*suffixes)), F.lit(0)), F.element_at(part, -1))
    alone = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | host.startswith("[")
    named = hosts.withColumn("suffix", F.when(alone, host).otherwise(suffix))
    at = F.size(part) - F.size(F.split("suffix", r"\."))
    named = named.withColumn("domain", F.when(alone | (at < 1), host).otherwise(F.array_join(F.slice(part, F.greatest(at, F.lit(1)), F.size(part)), ".")))
    named = cut(named)
    by_domain = cut(named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n, x = by_suffix.agg(F.sum("n"), F.sum("x")).first()
    root = ((x or 0) + ROOT / 2) / ((n or 0) + ROOT)
    suffixes = shrunk(by_suffix.withColumn("root_mean", F.lit(root)), "root_mean").select("suffix", F.col("post").alias("suffix_mean"))
    domains = shrunk(by_domain.join(suffixes, "suffix"), "suffix_mean").select("domain", F.col("post").alias("domain_mean"))
    units = shrunk(named.join(domains, "domain"), "domain_mean")
    a, limit = F.col("post") * F.col("weight"), min(0.999, times * root)
    below = beta_below(a, F.col("weight") - a, F.lit(limit))
    return units.select("host", "domain", "suffix", "n", "x", F.col("post").alias("mean"), F.lit(limit).alias("limit"), below.alias("below"))


def judged(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", times: float = TIMES, rules: tuple = RULES, suffixes: tuple = SUFFIXES) -> DataFrame:
    """id, host, path, rule, verdict, the host's posterior mean, the probability that its share is below the limit, and the limit. outcomes: (id, bad)."""
    seen = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    bad = outcomes.groupBy(id_col).agg(F.max("bad").cast("int").alias("bad"))
    hosts = seen.join(bad, id_col, "left").groupBy(without_port(F.col("host")).alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    known = reputation(hosts, suffixes, times).select(F.col("host").alias("_host"), "mean", "below", "limit")
    out = seen.join(known, without_port(F.col("host")) == F.col("_host"), "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("below") < DOUBT, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "mean", "below", "limit")
