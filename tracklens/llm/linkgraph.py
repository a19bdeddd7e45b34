"""URL filters: rules, and trust and distrust spread over the link graph of hosts.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; its path is what follows up to ``?``, ``#`` or the end.  A
null url, or one without ``://``, has both empty.  A rule (host, path) fits its
host and all subdomains if the url's path starts with the rule's; of those that
fit the longest decides.

For all other urls the host decides.  Hosts of allowed urls are trusted seeds and
hosts of blocked urls are blocked seeds, in proportion to those urls.  Trust is
the personalised PageRank from the trusted seeds along links between hosts;
distrust runs from the blocked seeds against the links: who links to bad hosts
is suspect.  A host is blocked where distrust makes up at least THRESHOLD of
both; hosts that neither reaches are allowed.

A page links its host to the hosts of its absolute and protocol-relative
addresses (href, src, also of base and canonical links).  Relative addresses stay on the
host.  Besides, a subdomain and its parent (www.a.org and a.org, as long as the
parent holds a dot) count as linked both ways once for each page of the
subdomain: who runs one answers for the other.  Hosts longer than a domain name can
be (253) have no parent.

The graph stays distributed: edges are counted per host pair before any join,
ranks are joined by host (AQE splits hot hosts), lineage is cut by tables in the
shared folder.  Rows with null or empty url or html, repeated rows and ties are
judged each by itself; repeated pages count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, written

DAMPING = 0.85
#: Share of the walk that may be undelivered when the rounds end; each round delivers 1 - DAMPING of what is left.
TOLERANCE = 1e-3
ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))
#: Rounds between tables that cut the lineage.
CUT_EVERY = 6
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, letters.upper(), letters)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (with host, path) plus rule and rule_verdict; rules are (verdict, host, path)."""
    options = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        options.append(F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    found = F.coalesce(*options) if options else F.lit(None).cast("struct<rule:string,verdict:string>")
    return df.withColumn("__found", found).withColumns({"rule": F.col("__found.rule"), "rule_verdict": F.col("__found.verdict")}).drop("__found")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    urls = pages.select(host_of(F.col("url")).alias("src"), F.coalesce("html", F.lit("")).alias("html")).where("src <> ''")
    links = F.regexp_extract_all("html", F.lit(r"(?i)(?<![\w-])(?:href|src)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s<>]+)"), 1)
    # A protocol-relative address has its host after //, as an absolute one.
    to = host_of(F.regexp_replace("link", "^//", "x://"))
    linked = urls.select("src", F.explode(links).alias("link")).select("src", to.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    # Every host with its ancestors that hold a dot; c.b.a.org is linked with b.a.org, and that with a.org.
    ancestors = urls.groupBy("src").agg(F.count("*").alias("n")).withColumn("labels", F.split("src", r"\."))
    depth = F.explode(F.sequence(F.lit(0), F.size("labels") - 3))
    name = lambda k: F.array_join(F.slice("labels", k + 1, F.size("labels")), ".")
    up = ancestors.where("size(labels) > 2 AND length(src) <= 253").select("labels", "n", depth.alias("k")).select(name(F.col("k")).alias("src"), name(F.col("k") + 1).alias("dst"), "n")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    edges = linked.unionByName(up).unionByName(down).where((F.col("src") != F.col("dst")) & (F.col("dst") != ""))
    return edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(walk, host, rank): for each walk the personalised PageRank from its seeds
    (walk, host, mass) along its edges (walk, src, dst, n).

    Ranks of a walk add up to 1.  Mass at hosts without links returns to the seeds:
    that is the same as letting it go and scaling what stays to 1.  ``rounds`` rounds
    leave at most 2 * DAMPING ** rounds of a walk undelivered, whatever the graph.
    """
    total = seeds.groupBy("walk").agg(F.sum("mass").alias("total")).where("total > 0")
    seeds = written(seeds.join(F.broadcast(total), "walk").select("walk", "host", (F.col("mass") / F.col("total")).alias("mass")), "seeds")  # one row a walk
    outgoing = edges.groupBy("walk", "src").agg(F.sum("n").alias("all_n"))
    shares = edges.join(outgoing, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all_n")).alias("share"))
    shares = written(shares, "shares")
    given = seeds.select("walk", "host", (F.col("mass") * (1 - DAMPING)).alias("rank"))
    ranks = seeds.withColumnRenamed("mass", "rank")
    for k in range(1, rounds + 1):
        sent = ranks.join(shares, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
        ranks = sent.unionByName(given).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        if k % CUT_EVERY == 0 and k < rounds:
            ranks = written(ranks, "ranks")
    ranks = written(ranks, "ranks")
    whole = ranks.groupBy("walk").agg(F.sum("rank").alias("whole"))
    return ranks.join(F.broadcast(whole), "walk").select("walk", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust and links (those from or
    to the host in the graph) of every row of pages."""
    urls = with_rule(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    mass = urls.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("trust"), F.count_if(F.col("rule_verdict") == "block").alias("distrust"))
    mass = mass.where("host <> ''").select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("walk", "mass")).where("mass > 0")
    edges = written(host_edges(pages), "edges")
    forth = edges.select(F.lit("trust").alias("walk"), "src", "dst", "n")
    back = edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    ranks = propagate(forth.unionByName(back), mass.withColumn("mass", F.col("mass").cast("double")))
    of_walk = [F.sum(F.when(F.col("walk") == w, F.col("rank"))).alias(w) for w in ("trust", "distrust")]
    degrees = forth.unionByName(back).select(F.col("src").alias("host"), F.lit(None).cast("string").alias("walk"), F.lit(None).cast("double").alias("rank"), "n")
    hosts = ranks.withColumn("n", F.lit(0).cast("bigint")).unionByName(degrees).groupBy("host").agg(*of_walk, F.sum("n").alias("links"))
    out = urls.join(maybe_broadcast(written(hosts, "hosts"), 128), "host", "left").fillna(0, ["trust", "distrust", "links"])
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= THRESHOLD * (F.col("trust") + F.col("distrust")))
    verdict = F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust", "links")
