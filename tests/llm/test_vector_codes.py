"""Codes of vectors against plain Lloyd rounds, and what bounds may rule out."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meander.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, k string, v string, __vector string"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """All distances, one row at a time, in Python's integers."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]], r[2]) for r in good]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min((away(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        chosen = nearest()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, chosen, strict=True) if n[p][1] == i]
                if own:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    chosen = nearest()
    errors = [sum(d for d, _ in n) for n in chosen]
    by_label = {}
    for r, e in zip(whole, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((r[0], "".join(f"{i:02x}" for _, i in n), e, by_label[r[2]], sha)) for r, n, e in zip(whole, chosen, errors, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def check(spark, rows):
    found = vc.report(table(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain(rows)


def test_ties_bad_rows_and_repeats(spark):
    rng = np.random.default_rng(3)
    some = [(int(i), [float(x) for x in rng.integers(-3, 4, 32) / 256], int(i) % 3 or None) for i in rng.permutation(150)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 32, 1), (903, [float("inf"), *[0.0] * 31], 2), (904, [None, *[0.1] * 31], 2)]
    check(spark, some + bad + [some[0]] * 40 + [(None, some[1][1], 7), (5, some[2][1], None)])


def test_fewer_rows_than_entries_and_none(spark):
    check(spark, [(i, [i / 7 + k / 5 for k in range(16)], 1) for i in range(9)])
    assert vc.report(table(spark, [])).collect() == []
    assert vc.report(table(spark, [(1, None, 1), (2, [float("nan")], None)])).collect() == []


def test_other_lengths_and_very_large_components(spark):
    rows = [(1, [1e30, -1e30, *[0.5] * 14], 1), (2, [0.25] * 16, 1), (3, [0.1] * 5, 2)]
    found = {r["vec_id"]: r for r in vc.report(table(spark, rows)).collect()}
    assert set(found) == {1, 2} and found[1]["error"] == 0
    odd = vc.compress(table(spark, [(1, [0.5] * 21, 1), (2, [0.7] * 21, 1)]))
    assert odd.entries.shape == (16, 2, 2) and odd.rows.count() == 2  # 21 is filled up to 32


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 32)], None) for i in range(64)]
    coded = vc.compress(table(spark, rows), rounds=0)
    for r in vc.decode(coded.rows, coded.entries).collect():
        assert np.abs(np.array(r["vector"]) - rows[r["vec_id"]][1]).max() <= 0.5 / 256 + 1e-9


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 4), st.integers(1, 20), st.sampled_from([3, 40, 100_000_000]))
def test_bounds_rule_out_nothing_that_is_nearest(seed, width, entries, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (60, width))
    books = [rng.integers(-spread, spread + 1, (1, entries, width))]
    for _ in range(3):
        books.append(books[-1] + rng.integers(-spread // 3, spread // 3 + 1, books[-1].shape))
    entry, upper, lower = vc.assigned(x, books[0][0])
    for before, now in zip(books, books[1:], strict=False):
        upper, lower = vc.restored(vc.stored_up(upper)), vc.restored(vc.stored_down(lower))
        entry, upper, lower, _ = vc.reassigned(x, entry, upper, lower, vc.Shift.of(now, before), 0)
        exact = vc.squared(x, now[0])
        assert (entry == exact.argmin(axis=1)).all()
        away = np.sqrt(exact.astype(float))
        assert (upper >= away[np.arange(60), entry]).all() and (lower <= away).all()


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 60, (3000, 4)).astype(np.int64)
    old = x[:64][None].copy()
    new = old + rng.integers(-1, 2, old.shape)
    entry, upper, lower = vc.assigned(x, old[0])
    assert vc.reassigned(x, entry, upper, lower, vc.Shift.of(new, old), 0)[3] < 0.2 * 3000 * 64


@pytest.mark.parametrize("x", [0.0, 1.0, 1.0000001, 3.3e7, 12345.678, 2.0**31 * 1.1, 1e-30])
def test_stored_bounds_never_cross(x):
    one = np.array([x])
    assert vc.restored(vc.stored_down(one))[0] <= x <= vc.restored(vc.stored_up(one))[0]
