"""The language model and its bands against a version in plain dictionaries."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, low double, k int, l long"


def corpus(seed=1, n=60):
    rng = np.random.default_rng(seed)
    letters = {"en": "aeistnr", "de": "aeünrß", None: "xyz01", "": "qwv"}
    rows = []
    for i in range(n):
        lang = ["en", "en", "de", None, "", "rare"][i % 6] if i else "alone"
        words = ["".join(rng.choice(list(letters.get(lang, "opq")), rng.integers(1, 7))) for _ in range(int(rng.integers(40, 90)))]
        rows.append((i, "  ".join(words) + "\n", lang, 0.0, 1, 2))
    rows += [(1, rows[1][1], "en", 0.0, 1, 2), (None, rows[1][1], "en", None, None, None), (900, None, "en", 0.0, 1, 2), (901, "", None, 0.0, 1, 2), (902, " \n", "de", 0.0, 1, 2), (903, "lang " * 30_000, "en", 0.0, 1, 2)]
    return rows


def grams_of(text, order):
    raw = b" ".join(text.encode().split())
    runs = [r for r in re.findall(rb"[A-Za-z0-9+/=_.-]+", raw) if re.search(rb"[0-9]", r)]
    few = 10 * sum(map(len, runs)) <= len(raw)
    raw = re.sub(rb"[A-Za-z0-9+/=_.-]+", lambda m: b"0" if re.search(rb"[0-9]", m[0]) else m[0], raw) if few else re.sub(rb"[0-9]+", b"0", raw)
    raw = b" " * (order - 1) + raw + b" "
    return [raw[i : i + order] for i in range(len(raw) - order + 1)]


def brute_model(texts, order):
    """Probability of a byte after a context, by interpolated modified Kneser-Ney."""
    levels = {order: Counter(g for t in texts for g in grams_of(t, order))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, totals, back = {}, {}, {}
    for k, counts in levels.items():
        of = [sum(1 for n in counts.values() if n == j) for j in (1, 2, 3, 4)]
        if of[0] and of[1]:
            y = of[0] / (of[0] + 2 * of[1])
            d = [1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2] if of[2] else 0.9]
            d = [min(max(x, 0.05), j - 0.05) if j < 3 or of[2] else x for j, x in enumerate(d, 1)]
        else:
            d = [0.5, 0.75, 0.9]
        cuts[k] = d
        totals[k], back[k] = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            totals[k][g[:-1]] += n
            back[k][g[:-1]] += d[min(n, 3) - 1]

    def p(g, own=0):
        """own: occurrences (or left neighbours) of the n-gram that are the document's own."""
        k = len(g)
        if not k:
            return 1 / 256
        total, n = totals[k].get(g[:-1], 0), levels[k].get(g, 0)
        if n > own:
            return (n - cuts[k][min(n, 3) - 1] + back[k][g[:-1]] * p(g[1:])) / total
        lower = p(g[1:], 1 if n and own else 0)
        return back[k][g[:-1]] / total * lower if total > n else lower

    return p


def brute(rows, order):
    """(log perplexity, lower, upper) by row, and kept."""
    texts = defaultdict(list)
    for r in rows:
        if (r[1] or "").split():
            texts[r[2] or ""].append(r[1])
    models = {lang: brute_model(t, order) for lang, t in texts.items()}
    known = {}
    values = []
    for r in rows:
        if not (r[1] or "").split():
            values.append(None)
            continue
        key = (r[1], r[2] or "")
        if key not in known:
            own = Counter(grams_of(r[1], order))
            known[key] = -sum(n * math.log(models[r[2] or ""](g, n)) for g, n in own.items()) / sum(own.values())
        values.append(known[key])
    bounds = {}
    for lang in texts:
        cells = [math.floor(v / quality_rules.CELL) for v, r in zip(values, rows, strict=True) if v is not None and (r[2] or "") == lang and len(r[1].split()) >= 50]
        if cells:
            middle = np.median(cells)
            width = np.median(np.abs(np.array(cells) - middle)) * 1.4826 * quality_rules.CELL
            at = (middle + 0.5) * quality_rules.CELL
            bounds[lang] = at - max(quality_rules.BELOW * width, quality_rules.LEAST_WIDTH), at + max(quality_rules.ABOVE * width, quality_rules.LEAST_WIDTH)
    return values, [bounds.get(r[2] or "", (None, None)) for r in rows]


@pytest.mark.parametrize("order", [2, quality_rules.ORDER, 5])
def test_perplexity_and_bands(spark, order):
    rows = corpus()
    values, bounds = brute(rows, order)
    found = quality_rules.report(spark.createDataFrame(rows, SCHEMA), order=order).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for row, value, (low, high) in zip(rows, values, bounds, strict=True):
        r = by_id[row[0]]
        assert (r["log_ppl"] is None) == (value is None), row[0]
        if value is not None:
            assert r["log_ppl"] == pytest.approx(value, abs=1e-8)
        assert (r["low"], r["high"]) == ((pytest.approx(low), pytest.approx(high)) if low is not None else (None, None))
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        inside = value is None or low is None or low <= round(value, 9) <= high
        assert (r["base_failed"], r["kept"]) == (failed, not failed and inside)


def test_blocks_change_nothing(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    order = ["doc_id", "log_ppl", "n_words"]
    whole = quality_rules.report(docs).orderBy(*order).collect()
    parts = quality_rules.report(docs, block=150).orderBy(*order).collect()
    model = list(quality_rules.train(docs, "text", "lang", block=150))
    assert len(model) > quality_rules.PASSES and [r["kept"] for r in whole] == [r["kept"] for r in parts]
    assert [r["log_ppl"] for r in parts] == [pytest.approx(r["log_ppl"], abs=1e-8) if r["log_ppl"] else r["log_ppl"] for r in whole]


def test_verdicts_do_not_depend_on_the_size_of_the_corpus(spark):
    """The corpus twice, under other ids and in a language of its own beside: the same verdicts, as there are no switches by size."""
    docs = spark.createDataFrame(corpus(n=120), SCHEMA)
    other = docs.withColumn("lang", F.concat(F.coalesce("lang", F.lit("none")), F.lit("-2"))).withColumn("doc_id", F.col("doc_id") + 10_000)
    key = ["doc_id", "log_ppl"]
    small = quality_rules.report(docs).where("doc_id IS NOT NULL").orderBy(*key).collect()
    large = quality_rules.report(docs.unionByName(other)).where("doc_id < 10000").orderBy(*key).collect()
    assert [(r["doc_id"], r["log_ppl"], r["kept"]) for r in small] == [(r["doc_id"], r["log_ppl"], r["kept"]) for r in large]


def test_sums_to_one(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    (block,) = quality_rules.train(docs, "text", "lang", 3)
    lang = spark.range(1).select(quality_rules.language(F.lit("de")).alias("l")).first()["l"]
    for context in (b"  ", b" a", b"an", b"zz", b"\xc3\x9f"):
        head = context[0] << 16 | context[1] << 8
        assert math.isclose(block.probability(lang, np.arange(256, dtype=np.uint64) | np.uint64(head)).sum(), 1, rel_tol=1e-9), context


def test_keep_good_keeps_rows_whole(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = quality_rules.keep_good(docs)
    want = quality_rules.report(docs).where("kept").select("doc_id")
    assert kept.columns == docs.columns and sorted(kept.select("doc_id").collect(), key=str) == sorted(want.collect(), key=str)
    assert kept.exceptAll(docs).isEmpty()
    nothing = spark.createDataFrame([], SCHEMA)
    assert quality_rules.keep_good(nothing).count() == quality_rules.report(nothing).count() == 0
