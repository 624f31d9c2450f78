"""Large dense graphs: the largest component is found by bits that vertices have, and edges stay where they are."""

import numpy as np
import pytest
from test_core import cliques, dense, labels_of

from meander.operators import bulk, local, scc
from meander.operators.blocks import Blocks
from meander.storage import stash


@pytest.mark.parametrize("row, alone, local_edges", [(10, 20, 0), (2, 0, 100)])
def test_the_bulk_of_many_edges_is_searched_where_it_is(spark, monkeypatch, row, alone, local_edges):
    """All edges were in shuffles and blocks, several times, so the disk grew by some 20 bytes an edge."""
    n = 600
    src, dst = dense(n, 10, 7, alone)
    monkeypatch.setattr(bulk, "ROW", row)
    most, of, written = [], Blocks.of.__func__, []
    monkeypatch.setattr(Blocks, "of", classmethod(lambda cls, graph, whole=0: most.append(graph.edges.count()) or of(cls, graph, whole)))
    monkeypatch.setattr(bulk, "stash", lambda df, name: written.append(stash(df, name)) or written[-1])
    for edges in ("GIANT_EDGES", "BULK_EDGES"):
        monkeypatch.setattr(scc, edges, 1)
    assert (labels_of(spark, n, src, dst, local_edges=local_edges) == local.labels_of(n, src, dst)).all()
    assert len(written) == 3 and max(most, default=0) < len(src) / 10 and max(df.count() for df in written) < len(src) / 5


@pytest.mark.parametrize("passes", [24, 2])
def test_a_bulk_that_is_not_there_or_far_changes_nothing(spark, monkeypatch, passes):
    for edges in ("GIANT_EDGES", "BULK_EDGES"):
        monkeypatch.setattr(scc, edges, 1)
    monkeypatch.setattr(bulk, "PASSES", passes)
    src, dst = cliques(12, 10)
    assert (labels_of(spark, 120, src, dst) == np.arange(120) // 10 * 10).all()
    src, dst = dense(600, 10, 9, 30)
    assert (labels_of(spark, 600, src, dst) == local.labels_of(600, src, dst)).all()


def test_a_search_that_has_found_the_most_goes_on(spark, monkeypatch):
    """600 vertices that all reach each other, and a way of 6 more: all passes but the last few find the most."""
    for edges in ("GIANT_EDGES", "BULK_EDGES"):
        monkeypatch.setattr(scc, edges, 1)
    monkeypatch.setattr(bulk, "PASSES", 5)
    src, dst = dense(600, 10, 10)
    way = np.arange(599, 606)
    src, dst = np.r_[src, way], np.r_[dst, way[1:], 0]
    passed, one = [], bulk._pass
    monkeypatch.setattr(bulk, "_pass", lambda edges, words: passed.append(1) or one(edges, words))
    assert (labels_of(spark, 606, src, dst) == 0).all()
    assert len(passed) > 5
