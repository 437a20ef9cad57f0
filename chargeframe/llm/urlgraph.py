"""URL filters with DataFrame functions only: rules, and trust propagated over the graph of hosts.

Where no rule fits, the host decides. Trust starts at hosts whose ruled pages are allowed
and follows the links (personalised PageRank); distrust starts at hosts whose ruled
pages are blocked and goes against them, to those that link there. It is split among these, so the mean
distrust of what a host links to, which is not, counts as well. A host belongs to its parent domain, which counts as a
link both ways.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.runtime import durable, materialize, small_side

#: Share of a rank that goes on along the links, and the change that counts as none. Together
#: they fix the number of steps, since a step shrinks the change to this share at least.
DAMPING, TOLERANCE = 0.6, 1e-3
#: Steps between checkpoints.
STEPS_HELD = 3
#: A host is blocked if its distrust, or the mean distrust of what it links to, is at least this much and its distrust
#: exceeds its trust.
DISTRUST = 0.02
#: Attributes whose value is a link.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?([^"'\s>]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    rule: str


#: Host and path; a rule fits its host with all subdomains, and paths that begin like its own.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
         Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.rule)):
        own, _, start = r.rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): how many pages of a host link to another host; relative links stay on the host."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(LINK), F.lit(1)),
                                         lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))))
    each = pages.select(host_of(F.col(url)).alias("src"), F.explode(found).alias("dst"))
    return each.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _parents(hosts: DataFrame) -> DataFrame:
    """A host and its parent domain, for parents of two labels or more."""
    levels = F.size(F.split("host", r"\."))
    steps = F.transform(F.sequence(F.lit(0), levels - 3), lambda i: F.struct(
        F.array_join(F.slice(F.split("host", r"\."), i + 1, levels), ".").alias("host"),
        F.array_join(F.slice(F.split("host", r"\."), i + 2, levels), ".").alias("parent")))
    return hosts.filter(levels >= 3).select(F.explode(steps).alias("s")).select("s.host", "s.parent").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks per kind from edges (kind, src, dst, owner, n) and seeds (kind, host, seed); returns (kind, host, rank).

    What an edge passes on is its share of its owner's edges: owned by src, that is personalised PageRank;
    owned by dst, a host gets the weighted mean over its edges, which the number of edges at src does not change.
    Ranks are not scaled to a sum of one: a seed of 1 gives its host at least 1 - damping
    however many hosts there are."""
    total = edges.groupBy("kind", "owner").agg(F.sum("n").alias("total"))
    shares = durable(edges.join(total, ["kind", "owner"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    base = durable(seeds.filter("seed > 0").select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")))
    ranks = base
    for step in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + 1):
        passed = ranks.withColumnRenamed("host", "src").join(shares, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = base.union(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % STEPS_HELD == 0:
            ranks = durable(ranks)
    return ranks


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE,
          distrust: float = DISTRUST, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every url with its host, path, fitting rule and verdict.

    Returns per row: page_id, host, path, rule (or null), verdict (allow or block), trust and
    distrust of the host. A url that is null or has no ``://`` has empty host and path; no rule
    fits it and, having no place in the graph, it is blocked. A host that no seed reaches is
    allowed. Repeated rows and null ids each give a row; an empty table gives none; null html has no
    links; other columns are ignored.
    """
    host, path = host_of(F.col(url).cast("string")), path_of(F.col(url).cast("string"))
    parsed = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = materialize(parsed.withColumns({"rule": rule, "ruled": verdict}), "ruled-pages")
    known = durable(ruled.filter("host <> ''").groupBy("host").agg(
        F.count("ruled").alias("n"), F.sum((F.col("ruled") == "allow").cast("int")).alias("allowed"),
        F.sum((F.col("ruled") == "block").cast("int")).alias("blocked")))
    parents = _parents(known.select("host"))
    both_ways = parents.select("host", F.col("parent").alias("other")).union(parents.select(F.col("parent").alias("host"), F.col("host").alias("other")))
    graph = links(pages, url, html).unionByName(both_ways.select(
        F.col("host").alias("src"), F.col("other").alias("dst"), F.lit(1).cast("long").alias("n"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    graph = durable(graph)
    edges = graph.select(F.lit("trust").alias("kind"), "src", "dst", F.col("src").alias("owner"), "n").union(
        graph.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("dst"), F.col("n"))).union(
        graph.select(F.lit("linked"), F.col("dst"), F.col("src"), F.col("src"), F.col("n")))
    seeded = known.filter("n > 0")
    seeds = seeded.select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.col("n")).alias("seed")).union(
        seeded.select(F.explode(F.array(F.lit("distrust"), F.lit("linked"))), F.col("host"), F.col("blocked") / F.col("n")))
    ranks = propagate(edges, seeds, damping, tolerance)

    def rank(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)

    scores = small_side(ranks.groupBy("host").agg(rank("trust"), rank("distrust"), rank("linked")))
    out = ruled.join(scores, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust", "linked")})
    method = F.when((F.col("host") == "") | ((F.greatest("distrust", "linked") >= distrust) & (F.col("distrust") > F.col("trust"))), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
