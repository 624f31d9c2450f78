"""Dense graphs: the bulk of the largest component is found on few of the edges and put in one vertex."""

import numpy as np
import pytest

from meander.graph import Graph
from meander.operators import core, local, scc
from meander.operators.blocks import Blocks


def dense(n, k, seed, alone=0):
    """Random edges, without some into the last vertices and some out of those before them, loops and repeats among them."""
    rng = np.random.default_rng(seed)
    src, dst = rng.integers(0, n, (2, n * k))
    kept = (dst < n - alone) & ((src < n - 2 * alone) | (src >= n - alone))
    return src[kept], dst[kept]


def cliques(number, size):
    at = np.arange(number * size * size)
    return at // size, at // size**2 * size + at % size


def labels_of(spark, n, src, dst, **options):
    graph = Graph.from_edges(spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), strict=True)), "src long, dst long"), n)
    return np.array([r["scc"] for r in scc.scc(graph, "colouring", **options).orderBy("v").collect()])


@pytest.mark.parametrize("n, k, alone, seed", [(600, 10, 20, 1), (600, 10, 0, 2), (250, 30, 60, 3), (40, 8, 2, 4)])
@pytest.mark.parametrize("local_edges", [0, 100])
def test_dense_graphs(spark, monkeypatch, n, k, alone, seed, local_edges):
    src, dst = dense(n, k, seed, alone)
    searched, of = [], Blocks.of.__func__
    monkeypatch.setattr(Blocks, "of", classmethod(lambda cls, graph, whole=0: searched.append(graph.edges.count()) or of(cls, graph, whole)))
    monkeypatch.setattr(scc, "GIANT_EDGES", 1)
    assert (labels_of(spark, n, src, dst, local_edges=local_edges) == local.labels_of(n, src, dst)).all()
    if n == 600:
        assert searched and max(searched) < len(src) / 3


def test_a_search_that_finds_little_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(scc, "GIANT_EDGES", 1)
    src, dst = cliques(12, 10)
    assert (labels_of(spark, 120, src, dst) == np.arange(120) // 10 * 10).all()


def test_a_search_that_ends_early_only_leaves_more(spark, monkeypatch):
    monkeypatch.setattr(scc, "GIANT_EDGES", 1)
    monkeypatch.setattr(core, "TAIL", 0.9)
    src, dst = dense(600, 10, 5, 30)
    assert (labels_of(spark, 600, src, dst) == local.labels_of(600, src, dst)).all()


def test_the_bulk_is_in_no_block(spark, monkeypatch):
    """One block had all edges of the vertex that stands for the bulk, so a task's memory grew with the graph."""
    src, dst = dense(600, 10, 6, 30)
    most, of = [], Blocks.of.__func__
    monkeypatch.setattr(Blocks, "of", classmethod(lambda cls, graph, whole=0: most.append(max((r["count"] for end in ("src", "dst") for r in graph.edges.groupBy(end).count().collect()), default=0)) or of(cls, graph, whole)))
    monkeypatch.setattr(scc, "GIANT_EDGES", 1)
    assert (labels_of(spark, 600, src, dst) == local.labels_of(600, src, dst)).all()
    assert len(most) > 1 and max(most[1:]) < 12
