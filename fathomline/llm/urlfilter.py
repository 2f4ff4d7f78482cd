"""URL filters: rules by host and path, and a verdict by link graph where no rule fits.

The graph has an edge from a page's host to every other host its absolute links name, weighted by the
number of links.  Trust is a personalised PageRank from the hosts whose pages are allowed by rule, along
links; distrust is one from the hosts whose pages are blocked, against links (who links to the bad is
bad).  A host is blocked where its distrust is over ``ratio`` times its trust and its exposure is over
``floor``.  Exposure is the chance that a walk along the host's links, which goes on with the damping at
each step, meets a blocked host: it is normalised by the host's own links, so neither the number of other
hosts that link to the same blocked one nor any other host's score moves it.  Scores are a table by host, and each iteration is a join with the edges and a sum by
host; the edges are summed per pair of hosts first, so a host of many pages is one row per neighbour.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged as the host ``''``, which has no links; a null html has no links; repeated rows are judged row by
row; extra columns are dropped; an empty table gives an empty result; equal rule lengths go to the first
rule by text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))
DAMPING = 0.85
STEPS = 15


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as its text; null where none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        out = F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.text)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> a, b, links: absolute links between different hosts."""
    urls = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^"'\s>]*)"""), F.lit(1))
    found = pages.select(F.col("host").alias("a"), F.explode_outer(urls).alias("url")).select("a", host_of(F.col("url")).alias("b"))
    return found.filter("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("links"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """edges (a, b, links), seeds (host, seed) -> host, score; what leaves no host returns to the seeds."""
    out_weight = edges.groupBy("a").agg(F.sum("links").alias("whole"))
    shares = stored(edges.join(out_weight, "a").select("a", "b", (F.col("links") / F.col("whole")).alias("share")), "url-shares")
    mass = seeds.agg(F.sum("seed")).first()[0] or 0.0
    seeds = stored(seeds.filter("seed > 0").select("host", (F.col("seed") / (mass or 1.0)).alias("seed")), "url-seeds")
    scores = seeds.select("host", F.col("seed").alias("score"))
    if seeds.isEmpty() or shares.isEmpty():
        return scores
    for _ in range(steps):
        moved = scores.join(shares, scores["host"] == shares["a"]).groupBy("b").agg(F.sum(F.col("score") * F.col("share") * damping).alias("got"))
        moved = stored(moved.select(F.col("b").alias("host"), "got"), "url-moved")
        back = 1.0 - (moved.agg(F.sum("got")).first()[0] or 0.0)
        scores = moved.join(seeds, "host", "full_outer").select("host", (F.coalesce("got", F.lit(0.0)) + back * F.coalesce("seed", F.lit(0.0))).alias("score"))
        scores = stored(scores, "url-scores")
    return scores


def exposure(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """edges (a, b, links), seeds (host, seed) -> host, exposure: the damped chance to meet a seed along links."""
    out_weight = edges.groupBy("a").agg(F.sum("links").alias("whole"))
    shares = stored(edges.join(out_weight, "a").select("a", "b", (F.col("links") / F.col("whole")).alias("share")), "url-shares")
    seeds = stored(seeds.filter("seed > 0").select("host", "seed"), "url-seeds")
    met = seeds.select("host", F.col("seed").alias("exposure"))
    if seeds.isEmpty() or shares.isEmpty():
        return met
    for _ in range(steps):
        moved = met.join(shares, met["host"] == shares["b"]).groupBy("a").agg(F.sum(F.col("exposure") * F.col("share") * damping).alias("got")).withColumnRenamed("a", "host")
        # a seed of a part of the pages leaves the rest to the links
        met = moved.join(seeds, "host", "full_outer").select("host", (F.coalesce("seed", F.lit(0.0)) + (1 - F.coalesce("seed", F.lit(0.0))) * F.coalesce("got", F.lit(0.0))).alias("exposure"))
        met = stored(met, "url-exposure")
    return met


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, ratio: float = 1.0, floor: float = 0.05) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)])
    df = df.withColumn("ruled", F.when(F.col("rule").isNotNull(), by_rule[F.col("rule")]))
    edges = stored(host_links(df.select("host", "html")), "url-edges")
    hosts = df.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked")
    )
    hosts = stored(hosts, "url-hosts")
    # a host's seed is the share of its pages that the rules decide
    trust = personalised_rank(edges, hosts.select("host", (F.col("allowed") / F.col("pages")).alias("seed"))).withColumnRenamed("score", "trust")
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "links")
    blocked = hosts.select("host", (F.col("blocked") / F.col("pages")).alias("seed"))
    distrust = personalised_rank(turned, blocked).withColumnRenamed("score", "distrust")
    scores = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").join(exposure(edges, blocked), "host", "left")
    scores = stored(scores.na.fill(0.0, ["trust", "distrust", "exposure"]), "url-judged")
    bad = (F.col("distrust") > ratio * F.col("trust")) & (F.col("exposure") > floor)
    scores = scores.withColumn("by_links", F.when(bad, "block").otherwise("allow"))
    out = df.drop("html").join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_links", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
