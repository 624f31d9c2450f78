"""Edges between ranges of ids that no cycle of ranges goes through."""

import numpy as np
import pytest

from meander.graph import Graph
from meander.operators import blocks, local, scc


def grid(rows, cols):
    u = np.arange(rows * cols)
    right, down = u[u % cols + 1 < cols], u[u + cols < rows * cols]
    return np.r_[right, down], np.r_[right + 1, down + cols]


@pytest.mark.parametrize("back, steps", [([], 1), ([(330, 190)], None), ([(399, 0)], None), ([(40, 35), (205, 5)], None)])
def test_components_where_ids_follow_the_edges(spark, monkeypatch, back, steps):
    """Peeling a grid went from block to block, two at a time, so it took supersteps as the graph grew."""
    monkeypatch.setattr(scc, "GIANT_EDGES", 1)
    monkeypatch.setattr(scc, "RANGE_BITS", 4)
    monkeypatch.setattr(blocks, "LEAST_EDGES", 1)
    ran, run = [], blocks.Blocks.run

    def counted(self, *args, **options):
        state = run(self, *args, **options)
        ran.append(self.steps)
        return state

    monkeypatch.setattr(blocks.Blocks, "run", counted)
    src, dst = grid(100, 4)
    src, dst = np.r_[src, [a for a, _ in back]].astype(int), np.r_[dst, [b for _, b in back]].astype(int)
    graph = Graph.from_edges(spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), strict=True)), "src long, dst long"), 400)
    found = {r["v"]: r["scc"] for r in scc.scc(graph, local_edges=0).collect()}
    assert [found[v] for v in range(400)] == local.labels_of(400, src, dst).tolist()
    assert steps is None or ran == [steps]
