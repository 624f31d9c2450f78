"""The search in one task: its memory, and what it is given."""

import tracemalloc

import numpy as np
import pyarrow as pa

from meander.operators import local


def test_depth_first_search_holds_numbers_not_objects():
    n = 100_000
    at = np.arange(n)
    src, dst = np.concatenate([at, at]), np.concatenate([(at + 1) % n, at // 2])  # one path through all vertices, and back
    tracemalloc.start()
    number = local.tarjan(n, src, dst)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (number == 0).all()
    assert peak < 40 * (n + len(src))


def sparse(n, m, top):
    """Vertices among many ids that are none, and edges of them, a third each into one of them and out of it."""
    rng = np.random.default_rng(5)
    v = np.sort(rng.choice(top, n, replace=False))
    src, dst = rng.choice(v, (2, m))
    src[: m // 3] = dst[m // 3 : 2 * m // 3] = v[n // 2]
    return v, src, dst


def test_one_task_holds_small_numbers():
    """It took 105 bytes above the input for each id that it was given, and takes 18."""
    v, src, dst = sparse(100_000, 300_000, 4_000_000)
    tracemalloc.start()
    ids, least = local.least_members(v, src, dst)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids == v).all() and (least <= ids).all()
    assert peak < 30 * (len(v) + 2 * len(src))


def test_places_of_dense_and_sparse_ids_are_the_same(monkeypatch):
    monkeypatch.setattr(local, "LOOKED_UP", 7)
    for shift in (0, 10**12, -50):
        v, src, dst = (x + shift for x in sparse(60, 100, 300))
        ids, place = local._numbering([v, src, dst])
        assert (ids == v).all()
        assert all((ids[place(x)] == x).all() for x in (v, src, dst))


def test_packed_edges_and_vertices():
    v, src, dst = sparse(500, 900, 3_000)
    ids, least = local.least_members(v, src, dst)
    rows = [pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["src", "dst"]) for a, b in ((src[:400], dst[:400]), (src[400:], dst[400:]), (v, v))]
    found = pa.Table.from_batches(local._unpacked(iter(rows)))
    assert (found["v"].to_numpy() == ids).all() and (found["scc"].to_numpy() == least).all()
    only = pa.Table.from_batches(local._unpacked(iter(rows[2:])))
    assert (only["v"].to_numpy() == v).all() and (only["scc"].to_numpy() == v).all()
    assert not list(local._unpacked(iter(())))
