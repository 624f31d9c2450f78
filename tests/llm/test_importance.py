"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.llm import importance
from meander.llm.common import stash

SCHEMA = "doc_id long, text string, k string, n_words long, score string, __at long"


def plain(docs, items, grams=1, buckets=10_000, least=20, percent=10):
    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))

    def found(text):
        w = words(text)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in items for b in found(x))
    total = lambda c: sum(c.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t))))
    rows = []
    for i, x in docs:
        own = found(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(repr((*r[:4], ranks.get(id(r)))) for r in rows)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y", 9) for i, t in rows], SCHEMA)


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def say(seed, n):
    return " ".join(f"W{x}" for x in np.random.default_rng(seed).integers(0, 300, n))


ROWS = [(1, None), (2, ""), (3, " ,; "), (4, say(4, 19)), (None, say(5, 40)), (None, say(6, 40)), *[(i, say(i, 15 + i)) for i in range(10, 120)], *[(50, say(50, 65))] * 5, (200, "é ü " * 30), (201, "one " * 50_000)]
ITEMS = [say(7, 50), None, "", say(90, 30)]


@pytest.mark.parametrize("block", [50, importance.BLOCK])
def test_report(spark, monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    found = importance.report(table(spark, ROWS), items(spark, ITEMS))
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain(ROWS, ITEMS)


def test_runs_of_two_words(spark):
    found = importance.resample(table(spark, ROWS), items(spark, ITEMS), grams=2).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain(ROWS, ITEMS, grams=2)


def test_empty_tables(spark):
    assert importance.report(table(spark, []), items(spark, ITEMS)).collect() == []
    found = importance.report(table(spark, ROWS), items(spark, [])).collect()
    assert sorted(repr(tuple(r)) for r in found) == plain(ROWS, [])


def test_ranks_over_many_ranges_and_ties(spark):
    rows = spark.range(5000).selectExpr("id % 700 AS doc_id", "id % 13 AS score", "id % 5 AS n_words")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = importance.ranked(stash(rows, "scored"), "doc_id", "score", F.col("n_words") >= 1, 30).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    able = sorted((-(i % 13), i % 700) for i in range(5000) if i % 5)
    assert [(-r["score"], r["doc_id"]) for r in drawn] == able[: 30 * len(able) // 100] and [r["rank"] for r in drawn] == list(range(1, len(drawn) + 1))
    assert len(found) == 5000 and all(r["n_words"] >= 1 for r in drawn)


def test_counts_are_those_of_sorted_runs(spark):
    blocks = importance.streams(table(spark, ROWS), "doc_id", "text", block=40)
    counts = Counter(zlib.crc32(w) % 10_000 for _, t in ROWS for w in importance.words_of((t or "").encode()))
    found = importance.counted(blocks)
    assert {b: int(found[b]) for b in np.flatnonzero(found)} == dict(counts)
