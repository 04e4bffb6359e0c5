"""URL filters by link-graph propagation: personalised PageRank of trust and, over reversed edges, of distrust.

Hosts are nodes; an edge counts the absolute links of one host's pages to another host (relative links stay on their host
and carry nothing). Trust starts at hosts with pages that a rule allows, in proportion to these pages, and follows links;
distrust starts at hosts whose pages rules mostly block and follows links backwards: who links to blocked hosts is
distrusted. A host is blocked if its distrust is above its trust and above `factor` times the mean of all hosts. A url's
verdict is that of the longest rule that fits it, else its host's.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. A
rule (host, path) fits its host and all subdomains if the url's path starts with the rule's.

Cases: a null url, or one without `://`, has empty host and path, which no rule fits; the empty host is never blocked. Null
html has no links. Without edges between hosts, ranks are the seeds themselves and no iteration runs. Repeated rows count
as pages each. Ties of rules of one length go to the earlier one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """kind, host, rank: personalised PageRank for each kind, over edges (kind, a, b, share) from seeds (kind, host, seed).

    Shares of one a sum to 1, seeds of one kind to 1. What dangling hosts hold goes back to the seeds. Every five rounds
    the ranks are written to the shared folder, and the change over the last of them is compared with the tolerance.
    """
    hosts = edges.select("kind", F.col("a").alias("host")).union(edges.select("kind", F.col("b"))).union(seeds.select("kind", "host")).distinct()
    nodes = hosts.join(seeds, ["kind", "host"], "left").join(edges.groupBy("kind", F.col("a").alias("host")).agg(F.lit(1).alias("links")), ["kind", "host"], "left").fillna({"seed": 0.0, "links": 0})
    nodes = spool(nodes, "nodes")
    ranks = nodes.withColumn("rank", F.col("seed"))
    held = None
    for k in range(1, rounds + 1):
        before = ranks
        flow = edges.join(ranks.select("kind", F.col("host").alias("a"), "rank"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = ranks.filter("links = 0").groupBy("kind").agg(F.sum("rank").alias("loose"))  # a row for each of the two kinds
        ranks = nodes.join(flow, ["kind", "host"], "left").join(F.broadcast(loose), "kind", "left").fillna({"got": 0.0, "loose": 0.0})
        ranks = ranks.select("kind", "host", "seed", "links", ((1 - damping) * F.col("seed") + damping * (F.col("got") + F.col("loose") * F.col("seed"))).alias("rank"))
        if k % 5 == 0 or k == rounds:
            ranks = spool(ranks.join(before.select("kind", "host", F.col("rank").alias("old")), ["kind", "host"]), "ranks")
            change = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
            ranks = ranks.drop("old")
            if held is not None:
                drop_spool(held)
            held = ranks
            if change < tolerance:
                break
    return ranks.select("kind", "host", "rank")


def judge(pages: DataFrame, rules=RULES, factor: float = 2.0, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, says = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    links = F.transform(F.coalesce(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.array().cast("array<string>")), lower_ascii)
    pairs = rows.select("host", F.explode(F.array_distinct(links)).alias("to")).filter("host <> '' AND host <> to").groupBy("host", "to").agg(F.count("*").alias("n"))
    pairs = spool(pairs, "links")
    by_host = spool(rows.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("says") == "allow").alias("allowed"), F.count_if(F.col("says") == "block").alias("blocked")), "hosts")
    blocked = F.when(F.col("blocked") * 2 > F.col("pages"), F.col("blocked")).otherwise(0)
    sums = by_host.agg(F.count("*").alias("hosts"), F.sum("allowed").alias("trust"), F.sum(blocked).alias("distrust")).first()
    seeds = by_host.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / F.lit(float(sums.trust or 1))).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (blocked / F.lit(float(sums.distrust or 1))).alias("seed")))).alias("s")).select("s.kind", "host", "s.seed").filter("seed > 0")
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    if pairs.limit(1).count():
        ahead = pairs.join(pairs.groupBy("host").agg(F.sum("n").alias("all")), "host").select(F.lit("trust").alias("kind"), F.col("host").alias("a"), F.col("to").alias("b"), (F.col("n") / F.col("all")).alias("share"))
        back = pairs.join(pairs.groupBy("to").agg(F.sum("n").alias("all")), "to").select(F.lit("distrust").alias("kind"), F.col("to").alias("a"), F.col("host").alias("b"), (F.col("n") / F.col("all")).alias("share"))
        ranks = propagate(spool(ahead.union(back), "edges"), seeds, damping)
    known = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    bad = known.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.lit(sums.hosts or 1) > factor)).select("host", F.lit("block").alias("method"))
    verdict = F.coalesce("says", "method", F.lit("allow")).alias("verdict")
    return rows.drop("html").join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict)
