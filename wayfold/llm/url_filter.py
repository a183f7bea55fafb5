"""URL filters: domain and path rules, and an empirical-Bayes host reputation for urls that no rule fits.

Reputation.  Labelled page outcomes (good or bad) are summed by host, by registered domain and by suffix.  Each level's
rate is shrunk to the level above through a beta-binomial prior whose strength is fitted by moments: suffix to the
whole, domain to suffix, host to domain.  A host is blocked if the lower bound of its posterior, a quantile of the beta
distribution, is above `max_bad`.  Sums by key are small tables, written once; suffixes are broadcast if there are at
most `MAX_BROADCAST`, counted before.  Pages meet blocked hosts only.

Cases: null url or one without "://": host and path are empty, no rule fits, and the reputation is that of the empty
host.  Repeated rows: one result each.  No labels: nothing is blocked but by rules.  Of rules of equal length the one
with the longer host wins, then the smaller string.  Columns of the input other than page_id and url are not returned.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Suffixes of more than one label under which names are registered (fixed values, extend as needed).
MULTI_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.za")

#: Suffixes or blocked hosts up to this number are broadcast.
MAX_BROADCAST = 100_000
#: Posterior mass below the lower bound.
TAIL = 0.05

#: (rule, verdict): fixed values of the query's contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null or without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  Rules are a short list; they become one CASE."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    multi = two.isin(*MULTI_SUFFIXES)
    return F.when(multi, F.substring_index(name, ".", -3)).otherwise(two), F.when(multi, two).otherwise(F.substring_index(name, ".", -1))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz), for 0 < x < 1."""
    x, a, b = (np.asarray(v, float) for v in (x, a, b))
    far = x > (a + 1) / (a + b + 2)  # the fraction converges on the other side
    x, a, b = np.where(far, 1 - x, x), np.where(far, b, a), np.where(far, a, b)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if (np.abs(d * c - 1) < 1e-13).all():
            break
    below = front * f
    return np.where(far, 1 - below, below)


def beta_quantile(mass: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with beta_cdf(x, a, b) = mass, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(40):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < mass
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _with_bound(df: DataFrame, mass: float) -> DataFrame:
    """df (host, rate, a, b) as host, rate, lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(beta_quantile(mass, a, b))], ["host", "rate", "lower"])

    return df.mapInArrow(run, "host string, rate double, lower double")


def _strength(joined: DataFrame) -> float:
    """Prior strength by moments: how much the rates of groups (n, bad) vary around their parents' (up) beyond binomial noise."""
    n, bad, up = F.col("n"), F.col("bad"), F.col("up")
    total, noise, spread, pooled = joined.where("n > 0").agg(
        F.sum("n"), F.sum(up * (1 - up)), F.sum(n * (bad / n - up) * (bad / n - up)), F.sum(n * up * (1 - up))).first()
    if not total:
        return 10.0
    between = max(1e-4, (spread - noise) / total)
    return min(1e4, max(1.0, pooled / total / between - 1))


def reputation(labelled: DataFrame, hosts: DataFrame, tail: float = TAIL) -> DataFrame:
    """host, rate, lower: posterior mean and lower bound of the bad rate of each host of `hosts`.

    labelled: (host, bad) with bad 0 or 1; hosts: (host), repeated or not.
    """
    spark = labelled.sparkSession
    domain, suffix = domain_of(F.col("host"))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    seen = labelled.where("bad is not null").select("host", F.lit(1.0).alias("n"), F.col("bad").cast("double").alias("bad"))
    every = seen.unionByName(hosts.select("host", F.lit(0.0).alias("n"), F.lit(0.0).alias("bad")))
    by_host = table(spark, every.groupBy("host").agg(*sums).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    by_domain = table(spark, by_host.groupBy("domain", "suffix").agg(*sums), "domains")
    by_suffix = table(spark, by_domain.groupBy("suffix").agg(*sums), "suffixes")
    total = by_suffix.agg(F.count("*"), F.sum("n"), F.sum("bad")).first()
    whole = ((total[2] or 0.0) + 0.5) / ((total[1] or 0.0) + 1.0)

    def mean(joined: DataFrame) -> tuple[Column, Column, Column]:
        """Posterior mean, and the posterior's two parameters."""
        k = F.lit(_strength(joined))
        a, b = F.col("bad") + k * F.col("up"), F.col("n") - F.col("bad") + k * (1 - F.col("up"))
        return a / (a + b), a, b

    top = by_suffix.withColumn("up", F.lit(whole))
    suffixes = top.select("suffix", mean(top)[0].alias("up"))
    middle = by_domain.join(F.broadcast(suffixes) if total[0] <= MAX_BROADCAST else suffixes, "suffix")
    domains = table(spark, middle.select("domain", "suffix", mean(middle)[0].alias("up")), "domain-rates")
    last = by_host.join(domains, ["domain", "suffix"])
    rate, a, b = mean(last)
    return _with_bound(last.select("host", rate.alias("rate"), a.alias("a"), b.alias("b")), tail)


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.  labels: (page_id, bad)."""
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = parsed.select("page_id", "host").join(labels.select("page_id", "bad"), "page_id").select("host", "bad")
    blocked = table(spark, reputation(outcomes, parsed.select("host")).where(F.col("lower") > max_bad).select("host", F.lit("block").alias("learned")), "blocked")
    if blocked.count() <= MAX_BROADCAST:
        blocked = F.broadcast(blocked)
    return parsed.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, "learned", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((1 - F.min("quality")).alias("bad"))
    return judge(pages, labels)
