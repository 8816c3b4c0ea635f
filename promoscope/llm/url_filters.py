"""URL filters: host and path rules, then empirical-Bayes host reputation.

Main path: DataFrame functions only.

*Rules* (host, path): a rule fits its host and every subdomain when the URL's
path starts with the rule's path; the longest rule that fits decides.

*Reputation*: labelled pages (bad or not) are counted per host. A host's bad
rate is shrunk towards its registered domain's, the domain's towards its
suffix's, and the suffix's towards the overall rate, each through a
beta-binomial prior whose weight is estimated from the spread of the level's
rates (method of moments). A host is blocked when the lower bound of its
posterior bad rate exceeds ``max_bad``; a host without labels has its domain's
(or suffix's, or the overall) posterior, whose bound is wide.

Counts are summed before every shuffle, so a host with a third of all pages
is one row a task. Defined cases: a NULL url, or one without ``://``, has an
empty host and path and the verdict ``allow`` or ``block`` of the overall rate;
rows with NULL outcomes teach nothing; without any labelled page nothing is
blocked by reputation; repeated rows are judged each; extra columns pass
through unless they bear the name of an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscope.llm.common import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which countries register names, as in ``com.cn`` or ``gov.uk`` (fixed values).
COUNTRY_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org")
#: Further suffixes of two labels whose names belong to different people (fixed values).
SHARED_SUFFIXES = ("blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app", "wordpress.com")
#: The suffix that addresses in numbers are counted under; each is a domain of its own.
ADDRESS = "(address)"
#: (rule, verdict); the rule's host reaches up to its first slash.
Rule = tuple[str, str]


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty for a NULL url or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return (df.drop("host", "path").withColumn("_rest", rest)
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def with_domains(df: DataFrame, shared: tuple[str, ...] = SHARED_SUFFIXES, labels: tuple[str, ...] = COUNTRY_LABELS) -> DataFrame:
    """Adds ``domain`` (registered name) and ``suffix`` for the column ``host``; user and port are left out.

    A suffix has two labels if it is one of ``shared`` (say, the two-label part of a public-suffix list) or one of
    ``labels`` under a two-letter country; else one. An address in numbers is a domain of its own."""
    bare = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.rlike(rf"^({'|'.join(labels)})\.[a-z][a-z]$") | two.isin(*shared)
    address = bare.rlike(r"^\d+(\.\d+){3}$|^\[")
    return (df.withColumn("suffix", F.when(address, F.lit(ADDRESS)).when(long, two).otherwise(F.substring_index(bare, ".", -1)))
            .withColumn("domain", F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)))


def rule_columns(rules: list[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The fitting rule and its verdict as columns (NULL when none fits); ties go to the first in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):    # the longest is asked first
        rule_host, _, rule_path = text.partition("/")
        fits = (((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host))
                & F.col(path).startswith("/" + rule_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


#: Bounds of a prior's weight in pages, the least spread that is told from none, and the weight of a level without data.
MIN_WEIGHT, MAX_WEIGHT, MIN_SPREAD, NO_DATA_WEIGHT = 2.0, 1000.0, 1e-4, 50.0


def _prior_weight(level: DataFrame, n: str, k: str, parent: str) -> float:
    """Weight (in pages) of the beta prior under the parent's rate, by the method of moments: a beta law of
    weight M spreads rates by p(1-p)/(M+1) beyond what counting noise gives. One number for a level."""
    p = F.col(parent)
    row = level.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - p, 2)).alias("seen"), F.sum(p * (1 - p)).alias("noise"),
        F.sum(F.col(n) * p * (1 - p)).alias("var"), F.sum(n).alias("n"), F.count("*").alias("groups")).first()
    if not row["groups"] or row["n"] <= row["groups"]:
        return NO_DATA_WEIGHT
    between = max(MIN_SPREAD, (row["seen"] - row["noise"]) / (row["n"] - row["groups"]))
    return min(MAX_WEIGHT, max(MIN_WEIGHT, row["var"] / row["n"] / between - 1))


def host_reputation(pages: DataFrame, bad: str = "bad", z: float = 2.0) -> DataFrame:
    """One row per host of ``pages`` (columns host, domain, suffix, and the outcome 0/1/NULL):
    labelled pages, posterior mean ``bad_rate`` and the bounds ``bad_low`` and ``bad_high``.

    Runs one aggregation over the pages, which is written (a row per host);
    the levels above are aggregates of it, and each level's prior weight is one
    number fetched by a small job."""
    scratch = Scratch(pages.sparkSession, "host-reputation")
    hosts = scratch.write(
        pages.groupBy("host", "domain", "suffix")
        .agg(F.count(bad).alias("n"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("k")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    row = suffixes.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    s = suffixes.withColumn("rate", F.lit(((row["k"] or 0) + 0.5) / ((row["n"] or 0) + 1.0)))
    m = _prior_weight(s, "sn", "sk", "rate")
    s = s.select("suffix", ((F.col("sk") + m * F.col("rate")) / (F.col("sn") + m)).alias("srate"))
    d = domains.join(s, "suffix")
    m = _prior_weight(d, "dn", "dk", "srate")
    d = d.select("domain", "suffix", ((F.col("dk") + m * F.col("srate")) / (F.col("dn") + m)).alias("drate"))
    h = hosts.join(d, ["domain", "suffix"])
    m = _prior_weight(h, "n", "k", "drate")
    rate = (F.col("k") + m * F.col("drate")) / (F.col("n") + m)
    sd = F.sqrt(rate * (1 - rate) / (F.col("n") + m + 1))
    return h.select("host", F.col("n").alias("n_labelled"), rate.alias("bad_rate"),
                    F.greatest(F.lit(0.0), rate - z * sd).alias("bad_low"),
                    F.least(F.lit(1.0), rate + z * sd).alias("bad_high"))


def judge(pages: DataFrame, rules: list[Rule], bad: str = "bad", url: str = "url", max_bad: float = 0.5,
          z: float = 2.0) -> DataFrame:
    """Adds host, path, domain, suffix, ``rule``, ``verdict`` and the host's reputation to every page.

    The pages meet the reputations (a row per host) in a join that Spark can split where a host is hot."""
    new = ("host", "path", "domain", "suffix", "rule", "verdict", "n_labelled", "bad_rate", "bad_low", "bad_high")
    known = with_domains(with_host_path(pages.drop(*new), url))
    rule, verdict = rule_columns(rules)
    joined = known.join(host_reputation(known, bad, z), "host")
    by_method = F.when(F.col("bad_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return joined.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_method))
