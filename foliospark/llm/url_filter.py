"""URL rules, and link-graph propagation for the hosts that no rule settles.

A rule (``block net/``, ``allow example.net/en/``) fits its host and all subdomains if the url's path starts with the
rule's path; the longest fitting rule wins, block before allow at equal length. Pages that no rule fits are judged by
their host: personalised PageRank spreads trust from hosts with allowed pages along links, and distrust from hosts with
blocked pages against them, each host seeded with the share of its pages that rules allow or block. A host is blocked
where distrust exceeds trust by more than ``threshold``; 1 is what a wholly blocked host gives itself.

Scores are whole numbers (``ONE`` is 1), so sums don't depend on their order. Defined results: a null url, or one
without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links; repeated links count as
often as they occur; rows with the same ``page_id`` are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

# fixed values: the rules
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"
ONE = 1_000_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<verdict,rule>, or null."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chain = F.when(fits, hit) if chain is None else chain.when(fits, hit)
    return chain if chain is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _spread(edges: DataFrame, seeds: DataFrame, rounds: int, damping: int) -> DataFrame:
    """Scores (host, score): ``damping`` per cent of a host's score goes on along its edges (src, dst, share in ONE)."""
    base = seeds.select("host", F.expr(f"seed * {100 - damping} div 100").alias("score"))
    score = base
    for k in range(rounds):
        sent = edges.join(score, edges["src"] == score["host"]).select(F.col("dst").alias("host"), F.expr(f"cast(score as decimal(38, 0)) * share * {damping} div {100 * ONE}").alias("score"))
        score = base.unionByName(sent).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 3 == 2:
            score = materialize(score)
    return score


def _shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    out = edges.groupBy(F.col(src).alias("src")).agg(F.sum("n").alias("_all"))
    return materialize(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n").join(materialize(out), "src").select("src", "dst", F.expr(f"n * {ONE} div _all").alias("share")))


def host_scores(judged: DataFrame, links: DataFrame, rounds: int = 12, damping: int = 85) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host with pages, from judged pages (host, verdict) and links (src, dst)."""
    share = lambda v: F.expr(f"sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) * {ONE} div count(1)")
    hosts = materialize(judged.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    edges = materialize(links.where((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    trust, distrust = hosts.select("host", F.col("allowed").alias("seed")), hosts.select("host", F.col("blocked").alias("seed"))
    if edges.isEmpty():
        rounds = 0
    forward, backward = (_shares(edges, "src", "dst"), _shares(edges, "dst", "src")) if rounds else (edges, edges)
    scores = [_spread(e, s.where(F.col("seed") > 0), rounds, damping) for e, s in ((forward, trust), (backward, distrust))]
    named = [s.select("host", F.expr(f"score * 100 div {100 - damping}").alias(n)) for s, n in zip(scores, ("trust", "distrust"), strict=True)]
    joined = reduce(lambda a, b: a.join(b, "host", "left"), named, hosts.select("host"))
    return materialize(joined.fillna(0, ["trust", "distrust"]))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, rounds: int = 12, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust`` (1 = ONE)."""
    u = F.col(url)
    judged = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path")).withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))
    links = pages.where(F.col(html).contains("//")).select(host_of(u).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    scores = host_scores(judged, links, rounds)
    by_host = F.when(F.col("distrust") - F.col("trust") > int(threshold * ONE), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("host") == "", F.lit("allow")).otherwise(by_host), F.lit("allow")).alias("verdict"), "trust", "distrust")
