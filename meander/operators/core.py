"""The bulk of a dense graph as one vertex: a part of its largest component, found on few of its edges, and what is left.

The component of one vertex in a graph of fewer edges lies in its component in the whole graph, and putting one vertex in place of
vertices of one component changes no other. So a share of the vertices, with the edges between them, is searched from
one of many edges; a vertex with an edge from what is found and one into it belongs to it as well; and all of that is one vertex
of a graph of what is left, in which components are what they are in the whole graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import dealt, stash
from .blocks import Blocks, View, least_step

#: Edges a vertex from which a graph is dense, and edges a vertex among those that are searched.
DENSE, THIN = 8, 4
#: Of so many consecutive vertices the first ones are searched.
OF = 100
#: Of so many vertices one may be where the search begins.
STARTS = 64
#: The search ends when it sends less than this share of what it has sent in one superstep at most: what it misses is only left.
TAIL = 0.01


def searched(graph: Graph, kept: int) -> tuple[DataFrame, int] | None:
    """(v) of vertices of one component, one of them, by a search among the first `kept` of OF vertices; None where it finds few of them."""

    def number(end: str):
        return F.expr(f"({end} div {OF}) * {kept} + {end} % {OF}").alias(end)

    edges = stash(graph.edges.where((F.col("src") % OF < kept) & (F.col("dst") % OF < kept)).select(number("src"), number("dst")), "thinned")
    vertices = graph.vertices.where(F.col("v") % OF < kept).select(number("v"))
    ends = [edges.where(F.col(end) % STARTS == 0).select(F.col(end).alias("v"), F.lit(int(end == "src")).alias("o"), F.lit(int(end == "dst")).alias("i")) for end in ("src", "dst")]
    start = ends[0].unionByName(ends[1]).groupBy("v").agg(F.least(F.sum("o"), F.sum("i")).alias("least")).orderBy(F.desc("least"), "v").first()
    blocks = Blocks.of(Graph(vertices, edges)) if start is not None else None
    if blocks is None:
        return None

    def found(view: View, data: np.ndarray) -> dict:
        u = view.nodes[::2][(data[: len(view.nodes)].reshape(-1, 2) == 0).all(axis=1)] >> 1
        return {"v": u // kept * OF + u % kept}

    u = start["v"]
    first = graph.edges.sparkSession.createDataFrame([(2 * u, 0), (2 * u + 1, 0)], "node long, value long")
    members = blocks.finish(blocks.run(least_step(0), blocks.messages(first), tail=TAIL), found, "v long", "core")
    return (members, u // kept * OF + u % kept) if 2 * members.count() > vertices.count() else None


def contracted(graph: Graph, mean: float) -> tuple[Graph, int] | None:
    """A graph in which one vertex, that is given with it, stands for all vertices that are not in it; None where too few are found.

    mean: edges a vertex. Edges are shuffled by either end, once where that end is among what is searched and once whole.
    """
    kept = min(OF, max(1, -int(-OF * THIN // mean)))
    core = searched(graph, kept)
    if core is None:
        return None
    members, one = core
    edges, of = graph.edges, lambda end: (F.col(end) % OF < kept)
    by = {end: members.withColumnRenamed("v", end) for end in ("src", "dst")}
    into = edges.where(of("dst") & ~of("src")).join(by["dst"], "dst", "left_semi").select(F.col("src").alias("v"), F.lit(1).alias("way"))
    out = edges.where(of("src") & ~of("dst")).join(by["src"], "src", "left_semi").select(F.col("dst").alias("v"), F.lit(2).alias("way"))
    ways = graph.vertices.select("v", F.lit(0).alias("way")).unionByName(members.select("v", F.lit(3).alias("way"))).unionByName(into).unionByName(out)
    rest = dealt(stash(ways.groupBy("v").agg(F.bit_or("way").alias("ways")).where("ways <> 3").select("v"), "rest"))
    src, dst = (rest.withColumnRenamed("v", end) for end in ("src", "dst"))
    left_out = {end: rest.select(F.col("v").alias(end), F.col("v").alias("own")) for end in ("src", "dst")}
    ending = edges.join(dst, "dst", "left_semi").join(left_out["src"], "src", "left").select(F.coalesce("own", F.lit(one)).alias("src"), "dst")
    leaving = edges.join(src, "src", "left_semi").join(left_out["dst"], "dst", "left").where("own IS NULL").select("src", F.lit(one).cast("long").alias("dst"))
    between = stash(ending.unionByName(leaving).where("src <> dst").distinct(), "between")
    alone = rest.sparkSession.range(one, one + 1).select(F.col("id").alias("v"))
    return Graph(rest.unionByName(alone), between), one
