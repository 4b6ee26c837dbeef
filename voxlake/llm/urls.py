"""URL filter: path rules first, then empirical-Bayes reputation of hosts.

Labelled pages are trials of their host. A suffix's bad rate shrinks to the rate of all pages, a registered domain's to
its suffix's and a host's to its domain's, each through a beta-binomial prior whose strength is estimated from the data
by the method of moments; a host is blocked where even the lower posterior bound of its bad rate is over a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract, (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://' or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def applied_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; equal lengths: the first in the list."""
    fits = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(fit, value) if fits is None else fits.when(fit, value)
    return fits


def _level(rows: DataFrame, least: float, most: float) -> DataFrame:
    """rows(n, bad, prior): a rate for each row, shrunk to prior with the strength that the keys' spread
    about their priors supports: m = p(1-p) / v - 1 pooled over keys, kept in [least, most]."""
    spread = rows.agg(
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("noise"),
        F.sum("n").alias("trials"),
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) / F.col("n")).alias("chi"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("keys"),
    ).select(
        # E chi = sum of p(1-p)(1 + (n - 1) / (m + 1)) over keys.
        F.when(F.col("chi") > F.col("keys"), (F.col("noise") - F.col("keys")) / (F.col("chi") - F.col("keys")) - 1).otherwise(F.lit(most)).alias("m")
    )
    strength = F.least(F.greatest(F.round(F.coalesce("m", F.lit(most)), 6), F.lit(least)), F.lit(most))
    return rows.withColumn("m", spread.select(strength).scalar()).withColumn("rate", (F.col("bad") + F.col("m") * F.col("prior")) / (F.col("n") + F.col("m")))


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = 1.64, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """(host, bound): lower posterior bound of the share of bad pages of every host in pages(page_id, host).

    A page is bad if its label (labels.doc_id = page_id; the largest toxic and the smallest quality of repeated rows) is
    toxic or of low quality. Hosts without a labelled page have their domain's posterior, and so on upwards. Counts are
    added up per host before anything is joined, so a hot host is one row.
    """
    outcome = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    )
    known = pages.where("page_id is not null").join(outcome, pages.page_id == outcome.doc_id, "left")
    hosts = known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    parts = F.split("host", r"\.")
    hosts = hosts.withColumn("suffix", F.element_at(parts, -1)).withColumn(
        "domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host"))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = suffixes.agg(F.sum("n").alias("an"), F.sum("bad").alias("ab")).select(((F.col("ab") + 0.5) / (F.col("an") + 1)).alias("prior"))

    def shrunk(rows: DataFrame, key: str) -> DataFrame:
        known = _level(rows.where("n > 0"), least, most).select(F.col(key).alias("_k"), "rate", "m")
        out = rows.join(known, rows[key].eqNullSafe(F.col("_k")), "left").drop("_k")
        return out.withColumn("rate", F.coalesce("rate", "prior"))

    s = shrunk(suffixes.withColumn("prior", everything.scalar()), "suffix")
    d = shrunk(domains.join(s.select("suffix", F.col("rate").alias("prior")), "suffix"), "domain")
    h = shrunk(hosts.join(d.select("domain", F.col("rate").alias("prior")), "domain"), "host")
    strength = F.col("n") + F.coalesce("m", F.lit(least))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (strength + 1))
    return h.select("host", "rate", F.greatest(bound, F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) of every row of pages(page_id, url, ...).

    The longest rule that fits decides; other pages are blocked if their host's bound is over limit. Null urls and urls
    without '://' have empty host and path, which are judged as one host of their own. Repeated page ids stay as rows.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    reputation = host_reputation(split, labels).withColumnRenamed("host", "_host")
    ruled = split.withColumn("_rule", applied_rule(F.col("host"), F.col("path")))
    # Hot hosts are many rows of pages and one of reputation; adaptive execution splits their partition.
    return ruled.join(reputation, ruled.host == F.col("_host"), "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
        F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_bound"),
    )


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("page_id", "host", "path", "rule", "verdict")
