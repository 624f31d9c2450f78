"""The classifier against plain versions: features of a text, gradient steps, scores."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meander.llm import quality_classifier as qc

M = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 33)) * qc.MIX & M
    return h ^ (h >> 29)


def polynomial(raw, kind):
    return mix((sum((c + 1) * pow(qc.BASE, i, 1 << 64) for i, c in enumerate(raw)) + kind) & M)


def brute_features(text):
    """(bucket, share) of all features of a text, with repeats: words as averages of their own, and bigrams."""
    words = text.split()
    out, numbers = [], []
    for w in words:
        raw = b" " + w + b" "
        own = [polynomial(raw, 0) % qc.BUCKETS]
        numbers.append(polynomial(raw, 0) & ((1 << 52) - 1))
        own += [polynomial(raw[i : i + n], n) % qc.BUCKETS for n in qc.GRAMS for i in range(len(raw) - n + 1)]
        out += [(b, 1 / len(own)) for b in own]
    for a, b in zip(numbers, numbers[1:], strict=False):
        out.append((mix(qc.BASE) % qc.BUCKETS if a == b else mix((a * qc.BASE + b) & M) % qc.BUCKETS, 1))
    return [(b, x / (2 * len(words) - 1)) for b, x in out]


def summed(found):
    total = np.zeros(qc.BUCKETS)
    for b, x in found:
        total[b] += x
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "abc", "é", "the", "long-word", "#"]), max_size=12).map(" ".join))
def test_features(text):
    at, share = qc.histogram(text.encode())
    total = summed(brute_features(text.encode()))
    assert at.tolist() == np.flatnonzero(total).tolist() and share == pytest.approx(total[at], rel=1e-5)


def test_a_text_in_parts_is_one_text():
    """More words than one step takes: bigrams over the cut count, and no word counts twice."""
    words = [b"w%d" % (i % 7) for i in range(200_001)]
    at, share = qc.histogram(b" ".join(words))
    found, count, numbers = qc.features(words)
    total = np.bincount(found, np.repeat(1 / count, count), qc.BUCKETS) + np.bincount(qc.bigrams(numbers), minlength=qc.BUCKETS)
    assert at.tolist() == np.flatnonzero(total).tolist() and share == pytest.approx(total[at] / total.sum(), rel=1e-5) and share.sum() == pytest.approx(1, rel=1e-4)


def brute_learn(y, rows, epochs):
    """The same steps over whole matrices, in double precision."""
    rng = np.random.default_rng(qc.SEED)
    vectors = rng.uniform(-0.5, 0.5, (qc.BUCKETS, qc.DIMENSION)) / qc.DIMENSION
    layer, bias = rng.normal(0, 0.3, (qc.DIMENSION, 2)), np.zeros(2)
    seen_v, seen_l, seen_b = np.full(qc.BUCKETS, 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs):
        rate = qc.RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for s in range(0, len(order), qc.BATCH):
            own = [r for r in order[s : s + qc.BATCH] if rows[r].any()]
            if not own:
                continue
            x = rows[own]
            logit = x @ vectors @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(2)[y[own]]) / len(own)
            to_vectors, to_layer = x.T @ (error @ layer.T), (x @ vectors).T @ error
            touched = x.any(0)
            seen_v[touched] += (to_vectors[touched] ** 2).mean(1)
            vectors[touched] -= rate * to_vectors[touched] / np.sqrt(seen_v[touched])[:, None]
            seen_l += to_layer**2
            layer -= rate * to_layer / np.sqrt(seen_l)
            seen_b += error.sum(0) ** 2
            bias -= rate * error.sum(0) / np.sqrt(seen_b)
    weights = vectors @ layer
    return weights[:, 1] - weights[:, 0], bias[1] - bias[0]


def texts_and_labels(n=60):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiourst"), 4)) for _ in range(60)]
    texts = [" ".join(w if i % 3 else w.upper() + "!" for w in rng.choice(words, 12)) for i in range(n)]
    return texts, np.array([int(i % 3 != 0) for i in range(n)])


def test_gradient_steps():
    texts, y = texts_and_labels()
    texts[5] = ""
    found = [qc.histogram(t.encode()) for t in texts]
    rows = np.zeros((len(texts), qc.BUCKETS))
    for row, (at, share) in zip(rows, found, strict=True):
        row[at] = share
    weights, bias = qc.learn(y, [f[0] for f in found], [f[1] for f in found], epochs=2)
    wanted, wanted_bias = brute_learn(y, rows, 2)
    assert weights == pytest.approx(wanted, abs=2e-3) and bias == pytest.approx(wanted_bias, abs=1e-3)


def test_scores_and_odd_rows(spark):
    texts, y = texts_and_labels()
    rows = [(i, t, "clash", 0.0, 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", None, None), (None, texts[1], None, None, None), (900, None, None, None, None), (901, "", None, None, None), (902, "word " * 250_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string, score double, y int")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(3, None), (None, 0), (4, int(y[4])), (4, int(y[4]))], "doc_id long, quality int")
    weights, bias = qc.fit(docs, labels.where(~qc.held_out()))
    found = sorted(qc.report(docs, labels).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, text, *_ in rows:
        if text is not None and len(text) > 10_000:
            continue
        own = brute_features((text or "").encode())
        value = bias + sum(float(weights[b]) * x for b, x in own)
        assert by_id[i]["score"] == pytest.approx(1 / (1 + math.exp(-value)), abs=1e-6)
        assert by_id[i]["predicted"] == int(by_id[i]["score"] >= 0.7) and by_id[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    assert len([r for r in found if r["doc_id"] == 0]) == 2 and len({r["score"] for r in found if r["doc_id"] == 0}) == 1
    nothing = docs.limit(0)
    assert qc.report(nothing, labels).count() == 0 and {r["score"] for r in qc.report(docs, labels.limit(0)).collect()} == {0.5}
