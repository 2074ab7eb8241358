"""URL filters: rules, and trust and distrust spread over the links between hosts.

The longest rule that fits a url decides. Other urls get the verdict of their host: personalised PageRank spreads
trust from the hosts of allowed pages along links, and distrust from the hosts of blocked pages against links, for a
page that links to bad hosts is suspect. A host is blocked if distrust is more than THRESHOLD of what reaches it; a host that nothing reaches is
allowed. Both ranks start with a host's share of the allowed or blocked pages; rank that has no link to follow returns to the start.

A rule is ``host/path``: it fits the host and its subdomains if the url's path starts with the rule's. Ties in length go to
the rule that is listed first.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and is allowed; a null html has no links;
relative links (whatever their query holds) and links inside a host carry nothing; repeated rows count twice; further columns are ignored; an empty table gives an
empty result. Links are reduced to a row a pair of hosts before any shuffle.

Ranks are iterated until a round changes them by less than CLOSE in all, so they are within 6 times CLOSE of their limit; a round shrinks the change by
DAMPING at least, so ROUNDS rounds always suffice. A host whose whole rank is below that bound may count as unreached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut

#: (rule, verdict) of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, CLOSE, THRESHOLD = 0.85, 1e-9, 0.5
ROUNDS = math.ceil(math.log(CLOSE / 4) / math.log(DAMPING)) + 1
LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*([^\"'\s>]+)"


def lower(c: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(c, "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):  # the last one wins
        h, _, p = rule.partition("/")
        found = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), F.lit(rule)).otherwise(found)
    return found


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): how many pages of a host link to another host."""
    href = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)
    target = F.transform(F.filter(href, lambda x: x.startswith("//") | x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")), lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)))
    each = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(target)).alias("dst"))
    return each.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Ranks (kind, host, rank) from starts (kind, host, start), whose starts sum to 1 a kind, over edges (kind, src, dst, w).

    A round joins ranks to edges and sums by host: sums are combined before the shuffle, so a host with very many links is no bottleneck.
    The driver sees two numbers a kind.
    """
    leaves = edges.select("kind", F.col("src").alias("host")).distinct().withColumn("out", F.lit(1.0))
    hosts = edges.select("kind", F.col("src").alias("host")).unionByName(edges.select("kind", F.col("dst").alias("host"))).unionByName(starts.select("kind", "host")).distinct()
    hosts = hosts.join(starts, ["kind", "host"], "left").join(leaves, ["kind", "host"], "left").fillna(0.0, ["start", "out"])
    ranks = cut(hosts.withColumn("rank", F.col("start")).withColumn("old", F.lit(0.0)))
    for _ in range(ROUNDS):
        seen = ranks.groupBy("kind").agg(F.sum(F.col("out") * F.col("rank")).alias("moves"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("gap")).collect()
        if sum(r["gap"] for r in seen) < CLOSE:
            return ranks.select("kind", "host", "rank")
        stays = F.lit(1.0)
        for r in seen:  # what has no link to follow returns to the start
            stays = F.when(F.col("kind") == r["kind"], F.lit(1 - DAMPING * r["moves"])).otherwise(stays)
        flow = edges.join(ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("rank") * F.col("w"))).alias("flow"))
        ranks = cut(ranks.join(flow, ["kind", "host"], "left").select("kind", "host", "start", "out", (F.coalesce("flow", F.lit(0.0)) + F.col("start") * stays).alias("rank"), F.col("rank").alias("old")))
    raise RuntimeError("ranks did not settle")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row."""
    url = F.col(url_col)
    seen = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    seen = seen.withColumn("said", said)
    by_host = cut(seen.where("said is not null and host <> ''").groupBy("host", F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
    total = by_host.groupBy("kind").agg(F.sum("n").alias("all"))  # two rows
    starts = cut(by_host.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("start")))
    found = cut(links(pages, url_col, html_col))

    def weighed(a: str, b: str, kind: str) -> DataFrame:
        out = found.groupBy(a).agg(F.sum("n").alias("all"))
        return found.join(out, a).select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("n") / F.col("all")).alias("w"))

    ranks = spread(cut(weighed("src", "dst", "trust").unionByName(weighed("dst", "src", "distrust"))), starts)
    hosts = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    # html has been left behind; hosts with ranks are broadcast if they are counted and few, else skewed partitions of the join are split
    hosts = cut(hosts)
    out = seen.join(F.broadcast(hosts) if hosts.count() <= common.BROADCAST else hosts, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_rank = F.when((F.col("distrust") > 0) & (F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust"))), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("said", by_rank).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
