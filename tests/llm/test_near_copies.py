"""Near copies of the pipeline against all pairs, and rows that share an id or have none."""

import numpy as np
import pytest

import corpus_pipeline
from meander.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 3])
def test_all_links_of_five_word_shingles(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.choice(200, edits, replace=False):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, enumerate(texts)), "").collect()}
    assert kept == set(parent) and 12 <= len(kept) < len(texts)


@pytest.mark.parametrize("module", [near_copies, simhash])
def test_ids_that_are_null_or_clash(spark, module):
    say = lambda seed: " ".join(f"v{x}" for x in np.random.default_rng(seed).integers(0, 5000, 60))
    rows = [(None, say(1)), (None, say(2)), (5, say(3)), (5, say(4)), (4, say(4)), (5, say(3)), (None, say(6)), (9, say(6))]
    found = sorted((r["doc_id"] or -1, r["text"]) for r in module.deduplicate(table(spark, rows)).collect())
    assert found == sorted([(-1, say(1)), (-1, say(2)), (5, say(3)), (4, say(4)), (-1, say(6))])


def test_pairs_that_share_a_template(spark):
    """Pairs at a similarity over 0.8 whose texts are mostly what all others have as well, and no two of different pairs are similar."""
    rng = np.random.default_rng(9)
    template = [f"t{x}" for x in rng.integers(0, 5000, 780)]
    texts = []
    for _ in range(150):
        own = [f"o{x}" for x in rng.integers(0, 50_000, 220)]
        edited = list(own)
        for at in rng.choice(220, 19, replace=False):
            edited[at] = "edited"
        texts += [" ".join(template + own), " ".join(template + edited)]
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    links = sum(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 300, 2))
    assert links > 100 and len(sets[0] & sets[2]) < 0.7 * len(sets[0] | sets[2])
    kept = corpus_pipeline.near_duplicates(spark, table(spark, enumerate(texts)), "").count()
    assert kept == 300 - links


def test_crowd_of_edited_copies(spark):
    """A crowd of copies with one to sixty edits each against all pairs."""
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    texts = []
    for n in range(240):
        copy = list(base)
        for at in rng.choice(400, 1 + n % 60, replace=False):
            copy[at] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if parent[i] != parent[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, enumerate(texts)), "").select("doc_id").collect()}
    assert kept == set(parent) and len(kept) > 1


def test_texts_of_common_passages_only(spark):
    """Pairs of the same passages in two orders: all but their seams is in very many texts, so that sketches share what is common only."""
    rng = np.random.default_rng(5)
    passages = [[f"p{i}x{x}" for x in rng.integers(0, 5000, 300)] for i in range(20)]
    texts = []
    for _ in range(100):
        chosen = rng.choice(20, 6, replace=False)
        texts += [" ".join(w for i in order for w in passages[i]) for order in (chosen, chosen[::-1])]
    near = [(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= simhash.THRESHOLD for a, b in zip(texts[::2], texts[1::2], strict=True)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, enumerate(texts)), "").select("doc_id").collect()}
    assert sum(near) > 50 and not [k for k, n in enumerate(near) if n and {2 * k, 2 * k + 1} <= kept]
