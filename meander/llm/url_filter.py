"""URL filters: rules by host and path, and trust and distrust that spread over links between hosts, in DataFrame functions.

A rule decides the pages it fits. For all others the page's host decides. Hosts of which rules allow half of the pages or
more are trusted seeds, those of which rules block half or more are blocked seeds. Trust is a personalised PageRank from
the trusted seeds along links; distrust is one from the blocked seeds against the links, as a host is answerable for what
it links to. Both go on until the rank that still moves is below TOLERANCE of all; what has not moved by then reaches no
host. A host is blocked if its share of distrust in the sum of both is over its threshold, BLOCK_SHARE unless a table has
one for the host; a host that neither reaches is allowed.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import stash

#: (verdict, host, path): a rule fits a host and its subdomains where the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE = 0.85, 1e-4
SEED_SHARE, BLOCK_SHARE = 0.5, 0.5
#: Hosts of absolute links; links without a host stay on their host and are no edge. A tag ends at the next < as well, and
#: what may repeat gives nothing back, so a page is read in time in proportion to its length, whatever it holds.
LINK = r"(?i)<a\s[^<>]*?href\s*+=\s*+[\"']?+\s*+(?:https?:)?//([^/?#\"'\s<>]++)"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, of, start = rule
    return ((host == of) | host.endswith("." + of)) & path.startswith(start)


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fit = fits(host, path, r)
        rule, verdict = F.when(fit, r[1] + r[2]).otherwise(rule), F.when(fit, r[0]).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) between different hosts. Links of a page are made distinct before they are shuffled."""
    src = host_and_path(F.col(url))[0]
    linked = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lowered))
    return pages.select(src.alias("src"), F.explode(linked).alias("dst")).where("src <> '' AND src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from `seeds` (host, weight) along `edges` (src, dst).

    rank = (1 - damping) * weight + damping * sum over links in of rank / links out. Rank that reaches a host without links
    out ends there. A round moves what the last one moved; the ranks are the sum of all rounds. What moves falls by the
    damping at least, so after log(tolerance) / log(damping) rounds (57) at most it is below `tolerance` of the seeds' rank,
    on any graph; each round is written, so a lost executor costs one.
    """
    # Links of one host are one group only as a sum; this is written, so that the join on a hub's name can be split.
    out = stash(edges.groupBy("src").agg(F.count("*").alias("links")), "links-out")
    weighted = stash(edges.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("links")).alias("part")), "links")
    moved, total = _written(seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank")))
    rounds, left = [moved], total
    while left > tolerance * total:
        step = moved.join(weighted, moved["host"] == weighted["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("part")).alias("rank"))
        moved, left = _written(step.groupBy("host").agg(F.sum("rank").alias("rank")))
        rounds.append(moved)
    return reduce(DataFrame.unionByName, rounds).groupBy("host").agg(F.sum("rank").alias("rank"))


def _written(ranks: DataFrame) -> tuple[DataFrame, float]:
    """A table of ranks, and their sum from the job that writes it; a stage that ran again may count some twice, which costs a round."""
    seen = Observation()
    out = stash(ranks.observe(seen, F.sum("rank").alias("sum")), "rank")
    return out, seen.get["sum"] or 0.0


def host_verdicts(hosts: DataFrame, edges: DataFrame, block_share: float = BLOCK_SHARE, thresholds: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust) of the hosts to block; hosts: (host, pages, allowed, blocked), pages and those that rules decide.

    thresholds: (host, block_share) of hosts that have one of their own, one row a host.
    """
    share = lambda c: F.col(c) / F.col("pages")
    allowed = hosts.where(share("allowed") >= SEED_SHARE).select("host", F.lit(1.0).alias("weight"))
    blocked = hosts.where(share("blocked") >= SEED_SHARE).select("host", F.lit(1.0).alias("weight"))
    trust = spread(edges, allowed).withColumnRenamed("rank", "trust")
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), blocked).withColumnRenamed("rank", "distrust")
    both = distrust.join(trust, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
    if thresholds is None:
        limit = F.lit(block_share)
    else:
        both = both.join(thresholds.select("host", F.col("block_share").alias("own_share")), "host", "left")
        limit = F.coalesce("own_share", F.lit(block_share))
    return both.where(F.col("distrust") > limit * (F.col("trust") + F.col("distrust"))).select("host", "trust", "distrust")


def report(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html", thresholds: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule, verdict of every row; a row of no host has the verdict allow.

    A null url has no host; a null or empty html has no links, and one of any length is searched whole. Repeated rows count
    as pages of their own and give repeated rows; a link counts once for its pair of hosts, however often it is there. Of
    rules that fit and are equally long there can be one host and path only, so there are no ties but for rules given twice.
    An empty table gives no rows; further columns are not read.

    Pages themselves are joined by host with the hosts to block only, without their html.
    """
    host, path = host_and_path(F.col(url))
    named = pages.select(key, host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "by_rule": verdict})
    of = lambda v: F.count_if(F.coalesce(F.col("by_rule") == v, F.lit(False)))
    hosts = stash(ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), of("allow").alias("allowed"), of("block").alias("blocked")), "hosts")
    edges = stash(host_edges(pages, url, html), "edges")
    gone = stash(host_verdicts(hosts, edges, thresholds=thresholds).select("host", F.lit("block").alias("by_host")), "blocked")
    # Only pages without a rule need their host's verdict.
    open_pages = ruled.where("by_rule IS NULL").join(gone, "host", "left").select(key, "host", "path", "rule", F.coalesce("by_host", F.lit("allow")).alias("verdict"))
    return ruled.where("by_rule IS NOT NULL").select(key, "host", "path", "rule", F.col("by_rule").alias("verdict")).unionByName(open_pages)


def oracle(rules=RULES) -> str:
    """SQL of the rules and of verdicts where no page has a link to another host: seeds then decide for themselves alone."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fit = lambda r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))"
    case = lambda k: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{k(r)}'" for r in ranked) + " END"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM a),
c AS (SELECT page_id, translate(h, '{upper}', '{lower}') AS host, regexp_extract(substring(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS by_rule FROM c),
e AS (SELECT host, count(*) FILTER (by_rule = 'block') >= {SEED_SHARE} * count(*) AND NOT count(*) FILTER (by_rule = 'allow') >= {SEED_SHARE} * count(*) AS bad FROM d WHERE host <> '' GROUP BY host)
SELECT page_id, d.host, path, rule, coalesce(by_rule, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM d LEFT JOIN e ON d.host = e.host"""
