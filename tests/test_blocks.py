"""Graphs over many small blocks, peeling, layers and parts against plain versions."""

import numpy as np
import pytest

from meander.graph import Graph
from meander.operators import blocks, local, pairs, partition, reach, trim
from meander.operators.scc import scc
from meander.sources import generators, text


@pytest.fixture(params=["many", "one", "joined"])
def layout(request, monkeypatch):
    """Many blocks of few edges, one block, and the joins that take the place of blocks that would be too large."""
    if request.param == "many":
        monkeypatch.setattr(blocks, "LEAST_EDGES", 40)
    if request.param == "joined":
        monkeypatch.setattr(blocks, "BLOCK_EDGES", 3)
    return request.param


def random_graph(spark, seed, n=60, m=80):
    edges = [tuple(map(int, e)) for e in np.random.default_rng(seed).integers(0, n, (m, 2))]
    return Graph.literal(spark, n, edges), n, edges


def levels(n, edges, start):
    depth, frontier = {start: 0}, [start]
    while frontier:
        frontier = sorted({b for a, b in edges if a in frontier} - set(depth))
        depth |= dict.fromkeys(frontier, max(depth.values()) + 1)
    return depth


def test_searches(spark, layout):
    graph, n, edges = random_graph(spark, 1)
    start = spark.createDataFrame([(edges[0][0],)], "v long")
    expected = levels(n, edges, edges[0][0])
    assert {r["v"]: r["depth"] for r in reach.bfs(graph, start).collect()} == expected
    assert {r["v"]: r["depth"] for r in reach.bfs(graph, start, most_rounds=2).collect()} == {v: d for v, d in expected.items() if d <= 2}
    down = [set(levels(n, edges, v)) for v in range(n)]
    pairs = {(r["v"], r["label"]) for r in reach.multi_reach(graph, graph.vertices).collect()}
    assert pairs == {(w, v) for v in range(n) for w in down[v]}
    rows = {r["v"]: (r["down"], r["up"]) for r in reach.extremes(graph).collect()}
    assert rows == {v: (min(u for u in range(n) if v in down[u]), min(down[v])) for v in range(n)}
    centres = spark.createDataFrame([(7, 0), (3, 1)], "v long, rank long")
    rows = {r["v"]: (r["down"], r["up"]) for r in reach.least_centres(graph, centres).collect()}
    least = lambda found: min(found, default=None)
    assert rows == {v: (least(r for c, r in ((7, 0), (3, 1)) if v in down[c]), least(r for c, r in ((7, 0), (3, 1)) if c in down[v])) for v in range(n)}


def peeled(n, edges):
    wave, now = {}, 0
    while True:
        now += 1
        left = [(a, b) for a, b in edges if a not in wave and b not in wave]
        going = [v for v in range(n) if v not in wave and (v not in {a for a, _ in left} or v not in {b for _, b in left})]
        if not going:
            return wave
        wave |= dict.fromkeys(going, now)


def test_peeling(spark, layout):
    graph, n, edges = random_graph(spark, 1)
    expected = peeled(n, edges)
    rest, gone = trim.trim(graph)
    assert {r["v"]: r["wave"] for r in gone.collect()} == expected
    stay = [(a, b) for a, b in edges if a not in expected and b not in expected]
    assert sorted(map(tuple, rest.edges.collect())) == sorted(stay) and rest.vertices.count() == n - len(expected)
    assert {r["v"] for r in trim.peel(graph)[1].collect()} == set(expected)
    if layout != "joined":
        assert {r["v"] for r in trim.trim(graph, 1)[1].collect()} == {v for v, w in expected.items() if w == 1}


def test_components(spark, layout):
    graph, n, edges = random_graph(spark, 4, 50, 70)
    down = [set(levels(n, edges, v)) for v in range(n)]
    expected = [min(w for w in down[v] if v in down[w]) for v in range(n)]
    for method, tau in (("colouring", 0), ("bgss", 4)) if layout == "many" else (("multi", 4),):
        found = {r["v"]: r["scc"] for r in scc(graph, method, tau=tau).collect()}
        assert [found[v] for v in range(n)] == expected, method


def test_labels_fall_along_edges_of_the_condensation(spark, layout):
    graph, n, edges = random_graph(spark, 5, 50, 60)
    labels = scc(graph, "tarjan")
    of = {r["v"]: r["scc"] for r in labels.collect()}
    found = {r["v"]: r["label"] for r in partition.topological(graph, labels).collect()}
    assert len(found) == n and all(found[a] > found[b] for a, b in edges if of[a] != of[b])
    assert sorted({found[v] for v in found}) == list(range(len(set(of.values())))) and all((found[a] == found[b]) == (of[a] == of[b]) for a in range(n) for b in range(n))


def test_a_lattice_moves_its_borders_only(spark, monkeypatch):
    """Every vertex of the grid is peeled, over twenty blocks, and each sends no more than its edges across them."""
    monkeypatch.setattr(blocks, "LEAST_EDGES", 1 << 10)
    graph = generators.lattice(spark, 40, 40)
    made = blocks.Blocks.of(graph)
    gone = trim.peeled_in(made)
    borders = -(-2 * 1600 >> made.bits)
    assert gone.count() == 1600 and borders > 3 and made.steps <= borders + 2
    assert made.sent <= 2 * 40 * borders
    # A search sends a vertex at a border once for each time that it becomes nearer, here once.
    state = made.run(blocks.least_step(1), made.messages(spark.createDataFrame([(0, 0)], "node long, value long")))
    assert made.sent <= 40 * borders and made.steps <= borders + 1
    assert state.count() == borders
    made.close()


def test_parts_are_solved_at_once_and_whole(spark, monkeypatch):
    monkeypatch.setattr(local, "AT_ONCE", 7)
    rows = [(10 * p + i, 10 * p + (i + 1) % 5, p % 3, p) for p in range(40) for i in range(5)] + [(1000, 1001, 9, 9)]
    edges = spark.createDataFrame(rows, "src long, dst long, down long, up long")
    found = {r["v"]: r["scc"] for r in local.components_of_parts(edges, ["down", "up"]).collect()}
    assert found == {10 * p + i: 10 * p for p in range(40) for i in range(5)} | {1000: 1000, 1001: 1001}


def test_edge_list_keeps_order_and_vertices(spark, tmp_path):
    graph, n, edges = random_graph(spark, 6, 40, 120)
    graph = Graph.literal(spark, n + 25, edges)
    path = str(tmp_path / "edges")
    text.write_edges(graph, path)
    again = text.read_edges(spark, path)
    assert again.vertices.count() == n + 25 and sorted(map(tuple, again.edges.collect())) == sorted(edges)
    lines = [line for f in sorted((tmp_path / "edges").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == [f"{a} {b}" for a, b in sorted(edges)]
    assert text.read_size(spark, path) == {"n": n + 25, "m": 120}
    files = [tuple(r) for r in text.read_manifest(spark, path).orderBy("file").collect()]
    assert sum(f[3] for f in files) == 120 and all(a[2] <= b[1] for a, b in zip(files, files[1:], strict=False))
    assert sorted(map(tuple, text.read_sources(spark, path, 5, 12).collect())) == sorted(e for e in edges if 5 <= e[0] < 12)
    assert text.read_sources(spark, path, 500, 600).isEmpty()
    text.write_edges(Graph.literal(spark, 3, []), str(tmp_path / "none"))
    assert text.read_edges(spark, str(tmp_path / "none")).vertices.count() == 3


def test_the_larger_side_is_filtered_before_it_is_joined(spark, monkeypatch):
    few = spark.range(300).selectExpr("id * 7 AS v", "id % 5 AS label")
    many = spark.range(40_000).selectExpr("id AS v", "id % 5 AS label")
    left = reach.possible(many, few, ["v", "label"])
    expected = {(7 * i, i % 5) for i in range(300)} & {(i, i % 5) for i in range(40_000)}
    assert expected <= set(map(tuple, left.collect())) and left.count() < len(expected) + 100
    monkeypatch.setattr(reach, "FILTER_ROWS", 10)
    for a, b in ((few, many), (many, few)):
        assert set(map(tuple, reach.both_ways(a, b).collect())) == expected


def test_waves_cost_a_superstep_a_border(spark, monkeypatch):
    """A long strip has hundreds of waves, which blocks go through by themselves; a superstep a wave took as many supersteps."""
    monkeypatch.setattr(blocks, "LEAST_EDGES", 1 << 9)
    made = blocks.Blocks.of(generators.lattice(spark, 400, 3))
    state = made.run(blocks.waves_step(), None)
    found = {r["v"]: r["wave"] for r in made.rows_of(state, trim._wave_of, "v long, wave long", "peeled").collect()}
    assert found == {v: min(v // 3 + v % 3, 401 - v // 3 - v % 3) + 1 for v in range(1200)}
    assert 2 < state.count() and made.steps <= state.count() + 2
    made.close()


def test_waves_with_corrections(spark, monkeypatch):
    """News that comes late makes waves earlier; loops and repeated edges count as edges."""
    monkeypatch.setattr(blocks, "LEAST_EDGES", 8)
    for seed in range(4):
        edges = [tuple(map(int, e)) for e in np.random.default_rng(seed).integers(0, 40, (44, 2))]
        edges += [edges[0], (3, 3)]
        found = {r["v"]: r["wave"] for r in trim.trim(Graph.literal(spark, 40, edges))[1].collect()}
        assert found == peeled(40, edges)


def test_pairs_by_components(spark, layout, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 3)
    if layout == "many":
        monkeypatch.setattr(pairs, "WHOLE", 0)
    graph, n, edges = random_graph(spark, 1)
    down = [set(levels(n, edges, v)) for v in range(n)]
    centres = graph.vertices.where("v % 3 = 1")
    expected = sorted((w, v) for v in range(1, n, 3) for w in down[v])
    assert sorted(map(tuple, pairs.reached(graph, centres).collect())) == expected
    assert sorted(map(tuple, pairs.mutual(graph, centres).collect())) == [(w, v) for w, v in expected if v in down[w]]
    assert sorted(map(tuple, pairs.totals(graph, graph.vertices).collect())) == [(v, len(down[v]), sum(down[v])) for v in range(n)]
