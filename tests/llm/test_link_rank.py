"""Rank over links against a plain version that goes on for long: chains, rings, hubs, thresholds of hosts."""

import random

import pytest

from meander.llm import url_filter


def brute(edges, seeds, d=url_filter.DAMPING):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    now = dict.fromkeys(seeds, 1 - d)
    total = dict(now)
    for _ in range(400):
        new = {}
        for a, r in now.items():
            for b in out.get(a, ()):
                new[b] = new.get(b, 0) + d * r / len(out[a])
        for h, r in new.items():
            total[h] = total.get(h, 0) + r
        now = new
    return total


def graphs():
    rng = random.Random(4)
    yield {(f"c{i}", f"c{i + 1}") for i in range(25)}, ["c0"]  # a chain that twelve rounds do not walk
    yield {("a", "b"), ("b", "a"), ("b", "c")}, ["a", "c"]
    yield {(f"h{rng.randrange(40)}", f"h{rng.randrange(40)}") for _ in range(150)} | {("h0", f"h{i}") for i in range(1, 40)}, ["h0", "h3"]
    yield set(), ["a"]


@pytest.mark.parametrize("edges, seeds", list(graphs()))
def test_rank(spark, edges, seeds):
    table = spark.createDataFrame(sorted(edges), "src string, dst string")
    start = spark.createDataFrame([(s, 1.0) for s in seeds], "host string, weight double")
    found = {r["host"]: r["rank"] for r in url_filter.spread(table, start).collect()}
    wanted = brute(edges, seeds)
    assert all(found.get(h, 0) == pytest.approx(r, abs=url_filter.TOLERANCE * len(seeds)) for h, r in wanted.items()) and set(found) <= set(wanted)


def page(i, url, *hosts, pad=0):
    return i, url, "<p>" * pad + "".join(f'<a href="http://{h}/">x</a>' for h in hosts), "clash"


def test_verdicts_where_links_are(spark):
    """Distrust walks a long chain back from a blocked host; trust meets it; repeated pages and a very long one change nothing else."""
    chain = [page(i, f"http://k{i}.com/a", f"k{i + 1}.com") for i in range(20)]
    pages = [*chain, page(20, "http://k20.com/", "bad.net"), page(21, "http://bad.net/"), page(22, "http://fine.org/fr/", "k18.com"), page(23, "http://k0.com/a", pad=200_000), chain[3], chain[3], page(None, "http://k5.com/")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, rank string")
    found = url_filter.report(table).collect()
    assert len(found) == len(pages)
    edges = {(f"k{i}.com", f"k{i + 1}.com") for i in range(20)} | {("k20.com", "bad.net"), ("fine.org", "k18.com")}
    trust, distrust = brute(edges, ["fine.org"]), brute({(b, a) for a, b in edges}, ["bad.net"])
    for r in found:
        bad = distrust.get(r["host"], 0) > 0.5 * (trust.get(r["host"], 0) + distrust.get(r["host"], 0))
        assert r["verdict"] == ("allow" if r["host"] == "fine.org" else "block" if bad else "allow"), r["host"]
    assert {r["host"] for r in found if r["verdict"] == "block"} >= {"k0.com", "k5.com", "k20.com", "bad.net"}
    own = spark.createDataFrame([("k5.com", 1.0), ("k18.com", 0.01)], "host string, block_share double")
    again = {r["host"]: r["verdict"] for r in url_filter.report(table, thresholds=own).collect()}
    assert again["k5.com"] == "allow" and again["k18.com"] == "block" and again["k4.com"] == "block"
