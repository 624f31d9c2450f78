import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meander import graph as g
from meander.graph import Graph
from meander.operators import partition
from meander.operators.local import least_members, tarjan
from meander.operators.reach import bfs, both_ways, multi_reach
from meander.operators.scc import METHODS, batches, permuted, scc
from meander.operators.trim import trim
from meander.sources import generators

LITERAL = {
    "cycle": (3, [(0, 1), (1, 2), (2, 0)], [{0, 1, 2}]),
    "two": (4, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)], [{0, 1}, {2, 3}]),
    "acyclic": (3, [(0, 1), (1, 2)], [{0}, {1}, {2}]),
    "empty": (0, [], []),
    "self_loops": (4, [(0, 0), (3, 3), (0, 3)], [{0}, {1}, {2}, {3}]),
    "repeated": (3, [(0, 1), (0, 1), (0, 1), (1, 0), (1, 2)], [{0, 1}, {2}]),
    "bridge": (8, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5)], [{0, 1, 2}, {3}, {4}, {5, 6, 7}]),
    "sparse_ids": (10, [(0, 9), (9, 0)], [{0, 9}, *({i} for i in range(1, 9))]),
}


def classes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["scc"], set()).add(r["v"])
    assert all(label == min(members) for label, members in out.items())
    return sorted(out.values(), key=min)


@pytest.mark.parametrize("name", LITERAL)
def test_literal_graphs(spark, name):
    n, edges, expected = LITERAL[name]
    for method in ("tarjan", "hybrid"):
        assert classes(scc(Graph.literal(spark, n, edges), method)) == expected


@pytest.mark.parametrize("method", METHODS)
def test_literal_graphs_beside_each_other(spark, method):
    """All literal graphs as one: no method may join or split what lies in another."""
    shift, edges, expected = 0, [], []
    for n, some, classes_ in LITERAL.values():
        edges += [(a + shift, b + shift) for a, b in some]
        expected += [{v + shift for v in c} for c in classes_]
        shift += n
    options = {"tau": 1} if method == "vgc" else {"beta": 4.0} if method in ("bgss", "multi") else {}
    assert classes(scc(Graph.literal(spark, shift, edges), method, **options)) == expected


@pytest.mark.parametrize("method", METHODS)
def test_empty_graph(spark, method):
    assert scc(Graph.literal(spark, 0, []), method).isEmpty()


@pytest.mark.parametrize("method", ["colouring", "multi"])
def test_disjoint_cycles_are_not_split(spark, method):
    found = classes(scc(generators.cycles(spark, 20, 5), method, **({"beta": 3.0} if method == "multi" else {})))
    assert found == [set(range(5 * i, 5 * i + 5)) for i in range(20)]


def naive(n, edges):
    reach = np.eye(n, dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k]
    both = reach & reach.T
    return both.argmax(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.data())
def test_local_kernel(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40))
    src, dst = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    ids, least = least_members(np.arange(n), src, dst)
    assert least.tolist() == naive(n, edges).tolist()
    order = tarjan(n, src, dst)
    assert all(order[a] >= order[b] for a, b in edges)  # reverse topological order of the condensation


def test_local_kernel_on_large_graphs(monkeypatch):
    from meander.operators import local

    monkeypatch.setattr(local, "SMALL", 5)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 40))
        src, dst = rng.integers(0, n, (2, int(rng.integers(1, 90))))
        ids, least = least_members(np.arange(n), src, dst)
        assert least.tolist() == naive(n, list(zip(src.tolist(), dst.tolist(), strict=True))).tolist()
    ids, least = least_members(np.array([10**15, 7]), np.array([10**15, 3]), np.array([3, 10**15]))
    assert dict(zip(ids.tolist(), least.tolist(), strict=True)) == {3: 3, 7: 7, 10**15: 3}


def test_long_chain_stays_off_the_stack():
    n = 200_000
    assert tarjan(n, np.arange(n - 1), np.arange(1, n)).max() == n - 1


@pytest.mark.parametrize("seed", range(2))
def test_methods_agree_on_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    n, m = 40, 60
    edges = [tuple(map(int, e)) for e in rng.integers(0, n, (m, 2))]
    graph = Graph.literal(spark, n, edges)
    expected = naive(n, edges).tolist()
    for method in ("tarjan", "colouring", "bgss", "hybrid"):
        options = {"beta": 2.0} if method == "bgss" else {}
        found = {r["v"]: r["scc"] for r in scc(graph, method, **options).collect()}
        assert [found[v] for v in range(n)] == expected, method


def test_one_task_with_many_vertices(spark):
    from meander.operators.scc import one_task

    n, edges, expected = LITERAL["sparse_ids"]
    assert classes(one_task(Graph.literal(spark, n, edges), most_vertices=3)) == expected


def test_properties(spark):
    graph = generators.kout(spark, 60, 2)
    base = scc(graph, "colouring")
    assert partition.compare(base, scc(graph.transpose(), "tarjan")).first()["equal"]
    assert partition.compare(base, scc(Graph(graph.vertices, graph.edges.union(graph.edges)), "tarjan")).first()["equal"]
    edges = partition.condensation(graph, base)
    again = scc(Graph.from_edges(edges, 60), "tarjan")
    assert again.where("scc <> v").isEmpty()  # a condensation is acyclic


def test_golden_counts(spark):
    for name, count, largest in (("graph_1k", 7, 994), ("graph_10k", 2, 9999), ("lattice_10k", 10_000, 1)):
        one = partition.summary(scc(generators.standard(spark, name))).first()
        assert (one["num_sccs"], one["max_scc_size"]) == (count, largest)


def test_golden_rows(spark):
    def row(n, k, i):
        return [r["dst"] for r in generators.kout(spark, n, k).edges.where(f"src = {i}").collect()]

    assert row(1000, 5, 0) == [484, 679, 82, 924, 903]
    assert row(10_000, 10, 1) == [8907 if i == 1 else x for i, x in enumerate([7713, 8907, 1508, 6191, 5377, 5599, 5238, 9463, 2391, 5992])]
    assert row(1_000_000, 5, 999_999) == [534007, 948637, 179848, 640657, 481490]


def test_trim(spark):
    n, edges, _ = LITERAL["self_loops"]
    rest, gone = trim(Graph.literal(spark, n, edges))
    assert {r["v"] for r in gone.collect()} == {1, 2} and rest.vertices.count() == 2
    n, edges, _ = LITERAL["bridge"]
    assert trim(Graph.literal(spark, n, edges))[1].isEmpty()
    _, gone = trim(Graph.literal(spark, 6, [(i, i + 1) for i in range(5)]))
    assert {r["v"]: r["wave"] for r in gone.collect()} == {0: 1, 5: 1, 1: 2, 4: 2, 2: 3, 3: 3}


def test_degrees_offsets_adjacency(spark):
    n, edges, _ = LITERAL["repeated"]
    graph = Graph.literal(spark, n, edges)
    assert [tuple(r) for r in g.degrees(graph).orderBy("v").collect()] == [(0, 3, 1), (1, 2, 3), (2, 0, 1)]
    assert [tuple(r) for r in g.csr_offsets(graph).orderBy("v").collect()] == [(0, 0), (1, 3), (2, 5), (3, 5)]
    assert {r["src"]: r["neighbors"] for r in g.adjacency(graph).collect()} == {0: [1, 1, 1], 1: [0, 2]}
    one = g.graph_stats(graph).first()
    assert (one["n_vertices"], one["n_edges"], one["self_loops"], one["repeated_edges"], one["max_degree"], one["top_vertex"]) == (3, 5, 0, 2, 5, 1)


def test_reach(spark):
    n, edges, _ = LITERAL["bridge"]
    graph = Graph.literal(spark, n, edges)
    start = spark.createDataFrame([(2,)], "v long")
    assert {r["v"]: r["depth"] for r in bfs(graph, start).collect()} == {2: 0, 0: 1, 3: 1, 1: 2, 4: 2, 5: 3, 6: 4, 7: 5}
    allowed = graph.vertices.where("v <> 4")
    assert {r["v"] for r in bfs(graph, start, allowed).collect()} == {0, 1, 2, 3}
    assert bfs(graph, start, graph.vertices.where("v > 4")).isEmpty()
    centres = spark.createDataFrame([(0,), (1,)], "v long")
    pairs = both_ways(multi_reach(graph, centres), multi_reach(graph.transpose(), centres))
    assert {tuple(r) for r in pairs.collect()} == {(v, c) for v in (0, 1, 2) for c in (0, 1)}


def test_batches_and_order(spark):
    sizes = [b - a for a, b in batches(120)]
    assert sizes[:13] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16] and sum(sizes) == 120
    order = permuted(spark.range(300).withColumnRenamed("id", "v")).collect()
    assert sorted(r["pos"] for r in order) == list(range(300)) and [r["v"] for r in sorted(order, key=lambda r: r["pos"])] != list(range(300))


def test_partitions(spark):
    a = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, None)], "v long, scc long")
    assert {r["v"]: r["label"] for r in partition.normalise(a).collect()} == {0: 0, 1: 1, 2: 0}
    b = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 5)], "v long, scc long")
    one = partition.compare(a, b).first()
    assert (one["only_a"], one["only_b"], one["different"], one["equal"]) == (0, 1, 1, False)
    assert partition.summary(a.limit(0)).first()["max_scc_size"] == 0
