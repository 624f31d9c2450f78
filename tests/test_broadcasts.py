"""Joins of vertex tables move by shuffles, not through the driver."""

from meander.graph import Graph
from meander.operators import scc as scc_module
from meander.sources import generators


def test_small_files_of_many_vertices_are_not_broadcast(spark):
    """Tables of ids are small as files, and joins of a graph with them went through the driver."""
    graph = generators.lattice(spark, 10, 10)
    graph = Graph(scc_module.stash(graph.vertices, "v"), scc_module.stash(graph.edges, "e"))
    kept = scc_module.stash(graph.vertices.where("v % 3 > 0"), "kept")
    labels = scc_module.canonical(kept.select("v", (kept["v"] % 5).alias("label")))
    for df in (graph.subgraph(kept).edges, labels, graph.vertices.join(labels, "v", "left_anti")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
