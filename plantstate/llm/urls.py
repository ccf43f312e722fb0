"""URL filters: host and path rules, and trust and distrust propagated over the links between hosts.

Hosts that rules allow are trusted seeds, hosts that rules block are distrusted ones.
Trust flows along links (personalised PageRank), distrust against them: who links to
blocked hosts is distrusted. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, numbered, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or protocol-relative link; group 1 is its host. A tag ends at its < or >, so each is read once.
LINK = r"""(?i)<a\s(?:[^<>]*?\s)??href\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*+:)?//([^\s"'<>/?#\\]++)"""
DAMPING, ROUNDS = 0.85, 12
#: A host is blocked by propagation above this share of what a fully blocked host has of itself, if its trust is less.
LEAST = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lower-cased; null or without ://: empty."""
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.locate("://", url) + 3)


def rule_table(like: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rule, verdict of a list of rules; of equal rules the first one counts."""
    first = dict(reversed([*rules]))
    return like.sparkSession.createDataFrame(sorted(first.items()), "rule string, verdict string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, fitting: for column host's distinct values the rules that fit it or a domain above it, longest first.

    A host is joined to rules by each of its suffixes, so work doesn't grow with rules x hosts."""
    slash = F.instr("rule", "/")
    start = F.when(slash > 0, F.substr("rule", slash)).otherwise("")
    named = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("name"), start.alias("start"))
    # Suffixes of more labels than any rule has can't fit one.
    most = named.agg(F.max(F.size(F.split("name", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.", -1)
    from_ = F.greatest(F.size(labels) - most + 1, F.lit(1))
    suffix = F.explode(F.transform(F.sequence(from_, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("name")
    found = hosts.where("host <> ''").select("host").distinct().select("host", suffix).join(named, "name")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("by"), "rule", "start", "verdict"))), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["verdict"].alias("verdict")))
    return found.groupBy("host").agg(ordered.alias("fitting"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from columns host and html."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(blank_if_null(F.col("html")), F.lit(LINK), F.lit(1))).alias("to"))
    dst = F.regexp_replace(F.regexp_replace(F.translate("to", UPPER, LOWER), r"^.*@", ""), r":\d*$", "")
    return found.select("src", dst.alias("dst")).where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind (trust or distrust), host, score for seeds kind, host, seed: personalised PageRank.

    A round gives each host (1 - damping) of its share of the seeds, damping x the shares of
    the hosts that point to it, and its share of what lies on hosts that point nowhere; for
    distrust links point backwards. So the whole stays the sum of the seeds. Scores are
    in units of what a host of seed 1 gets of itself: without links a score is a seed.
    Each round joins hosts to links and sums by host; sums are made before the shuffle, so
    that a host with many links is no bottleneck. What a round moves over all hosts is
    one row per kind."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    whole = both.groupBy("kind", "a").agg(F.sum("n").alias("whole"))
    shares = stage(both.join(whole, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("whole")).alias("share")), "edges")
    if shares.isEmpty():
        return seeds.select("kind", "host", F.col("seed").alias("score"))
    totals = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    base = stage(seeds.join(totals, "kind").select("kind", "host", "seed", "total"), "seeds")
    pointing = stage(whole.select("kind", F.col("a").alias("host")), "pointing")
    scores = base.select("kind", "host", F.col("seed").alias("score"))
    for _ in range(rounds):
        flow = scores.withColumnRenamed("host", "a").join(shares, ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        idle = scores.join(pointing, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("score").alias("idle"))
        own = _own(base, idle, damping)
        scores = stage(own.select("kind", "host", (F.col("seed") * F.col("own")).alias("score")).unionByName(flow).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
    idle = scores.join(pointing, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("score").alias("idle"))
    unit = _own(base, idle, damping).groupBy("kind").agg(F.max("own").alias("own"))
    return scores.join(unit, "kind").select("kind", "host", (F.col("score") / F.col("own")).alias("score"))


def _own(base: DataFrame, idle: DataFrame, damping: float) -> DataFrame:
    """base with own: what a host of seed 1 gets of itself, given what lies on hosts that point nowhere."""
    return base.join(idle, "kind", "left").withColumn("own", (1 - damping) + damping * F.coalesce("idle", F.lit(0.0)) / F.col("total")).drop("idle")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust for every url.

    rules: pairs, or a table of rule and verdict. A rule "example.com/en/" fits the host, its
    subdomains and paths that start with /en/; without a slash it fits all paths. verdict is the longest fitting rule's; else
    block if the host's distrust is above LEAST and above its trust, and allow otherwise
    (also for an empty host). A seed is the share of a host's pages that rules allow, or
    block. Null urls have an empty host and path, null html no links. Repeated rows count and are
    judged each. Of fitting rules of one length the first by code point wins. Pages of any
    length are searched whole. An empty table gives no rows."""
    d = numbered(pages)
    url = d[at(pages, url_col)]
    p = d.select(d[at(pages, id_col)].alias("key"), host_of(url).alias("host"), path_of(url).alias("path"), d[at(pages, html_col)].alias("html"))
    table = rules if isinstance(rules, DataFrame) else rule_table(pages, rules)
    fitting = stage(rules_by_host(p, table).withColumnRenamed("host", "f_host"), "rules")
    u = p.drop("html").join(fitting, F.col("host") == F.col("f_host"), "left").drop("f_host")
    u = u.withColumn("found", F.get(F.filter("fitting", lambda x: F.startswith(F.col("path"), x["start"])), F.lit(0))).drop("fitting")
    is_ = lambda v: F.coalesce(F.col("found.verdict") == v, F.lit(False)).cast("int")
    share = u.where("host <> ''").groupBy("host").agg(F.avg(is_("allow")).alias("trust"), F.avg(is_("block")).alias("distrust"))
    seeds = share.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)")).where("seed > 0").select("kind", "host", "seed")
    scores = propagated(host_edges(p), stage(seeds, "seeds"), rounds)
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
    by_host = stage(scores.groupBy("host").agg(side("trust"), side("distrust")), "scores")
    out = u.join(by_host, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    bad = (distrust > LEAST) & (distrust > trust)
    return out.select("key", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
