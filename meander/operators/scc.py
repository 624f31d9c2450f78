"""Strongly connected components by several methods. All give (v, scc), scc being the smallest vertex of the component.

tarjan    one task, linear time; for graphs that fit one
bgss      peeling, then the component of the vertex of the largest degree, then batches of centres on the rest
multi     peeling, then batches of centres in growing sizes
colouring of a dense graph the bulk of its largest component as one vertex; then peeling, then the smallest ancestor and the smallest descendant of every vertex: where they are one, the vertex is
          in its component; repeated on the rest. Two labels a vertex, whatever the graph
vgc       tarjan below a number of vertices, else bgss
hybrid    colouring, and tarjan for whatever is left as soon as it is small enough; the default

Every step of bgss, multi and colouring splits what is left into parts that no component crosses. Parts of few vertices are
solved at once, one task each at most, so long tails of small components cost no rounds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, pivot
from ..storage import dealt, stash_observed
from ..storage import stash as written
from . import local
from .blocks import Blocks, View, least_step
from .bulk import without_bulk
from .core import DENSE, contracted
from .reach import extremes, extremes_in, least_centres, ranks_in
from .trim import peel, peeled_in

#: Edges that one task may take: at some 100 bytes an edge in its arrays, about 600 MB.
LOCAL_EDGES = 6_000_000
BETA, SEED, TAU = 1.1, 12345, 1024
#: Growth of batches in the distributed methods: a batch costs its rounds, not its centres.
GROWTH = 8.0
#: Centres of the first batch: a search takes as many rounds with so many as with one.
FIRST = 64
#: Edges from which colouring begins with the component of the vertex of the largest degree.
GIANT_EDGES = 500_000
#: Edges from which a dense graph is searched where it is (bulk.py): blocks and shuffles of all its edges would take some 20 bytes of disk each.
BULK_EDGES = 20_000_000
#: Ranges of ids of which the cycles are looked at, by their power of two.
RANGE_BITS = 10
PHASES = ("trimming", "forward_reach", "backward_reach", "reachability", "labeling", "hash_bag", "big_scc", "others", "total")


#: Rows, counted before, that a join may send to all tasks (some 5 MB).
FEW = 100_000


def stash(df: DataFrame, name: str) -> DataFrame:
    return dealt(written(df, name))


class Clock:
    """Milliseconds by phase; phases end at an action."""

    def __init__(self):
        self.ms = dict.fromkeys(PHASES, 0.0)
        self.trimmed = 0

    def run(self, phase: str, work: Callable):
        began = time.perf_counter()
        try:
            return work()
        finally:
            self.ms[phase] += 1000 * (time.perf_counter() - began)


def batches(n: int, beta: float = BETA) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive batches of n centres, each larger than the last: 1, 2, 3, ... and later by the factor beta."""
    at, step = 0, 1
    while at < n:
        yield at, min(n, at + step)
        at, step = at + step, int(step * beta) + 1


def permuted(vertices: DataFrame, seed: int = SEED) -> DataFrame:
    """(v, pos): the vertices in a fixed pseudo-random order. Positions are counted within ranges of the hash, then shifted."""
    hashed = vertices.select("v", F.xxhash64("v", F.lit(seed)).alias("h")).withColumn("part", F.shiftrightunsigned("h", 54))
    inside = hashed.withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy("h", "v")))
    sizes = hashed.groupBy("part").agg(F.count("*").alias("size"))  # at most 1,024 rows
    first = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return inside.join(F.broadcast(first), "part").select("v", (F.col("first") + F.col("in_part") - 1).alias("pos"))


def canonical(labels: DataFrame) -> DataFrame:
    """Any labelling (v, label) with the smallest member of each class as scc."""
    least = labels.groupBy("label").agg(F.min("v").alias("scc"))
    return dealt(labels).join(least, "label").select("v", "scc")


def one_task(graph: Graph, most_vertices: int | None = None) -> DataFrame:
    """Components of a graph with a bounded number of edges. Vertices go to the task as well unless they are too many: ids may be sparse."""
    if graph.vertices.count() <= (LOCAL_EDGES if most_vertices is None else most_vertices):
        return local.components(graph.edges, graph.vertices)
    found = local.components(graph.edges)
    return graph.vertices.join(dealt(found), "v", "left").select("v", F.coalesce("scc", "v").alias("scc"))


def tarjan(graph: Graph, clock: Clock | None = None) -> DataFrame:
    """All of the graph in one task, whatever its size: for those who know that it fits. `hybrid` counts first."""
    return one_task(graph)


def _peel(graph: Graph, clock: Clock) -> tuple[Graph, DataFrame, Blocks | None]:
    """What peeling leaves, (v, scc) of what it takes, and blocks in which to search what is left.

    Edges of the rest are those of the graph: no path among the rest leaves it, and _split() takes edges of the rest only.
    """
    blocks = clock.run("trimming", lambda: Blocks.of(graph))
    if blocks is None:
        rest, gone = clock.run("trimming", lambda: peel(graph))
    else:
        gone = clock.run("trimming", lambda: peeled_in(blocks))
        rest = Graph(stash(graph.vertices.join(gone, "v", "left_anti"), "kept"), graph.edges)
    clock.trimmed += gone.count()
    return rest, gone.select("v", F.col("v").alias("scc")), blocks


def _ranks(rest: Graph, blocks: Blocks | None, centres: DataFrame | None) -> DataFrame:
    """(v, down, up) of the rest: the least centres either way, of all vertices where no centres are given."""
    if blocks is None:
        return extremes(rest) if centres is None else least_centres(rest, centres)
    ranks = extremes_in(blocks) if centres is None else ranks_in(blocks, centres)
    return ranks.join(rest.vertices, "v", "left_semi")


def big_scc(graph: Graph, within: DataFrame | None = None) -> DataFrame:
    """(v, scc): the component of the vertex of the largest degree, of those in `within`; one search goes both ways."""
    centre = stash(pivot(graph, within).select("v", F.lit(0).cast("long").alias("rank")), "pivot")
    searched = graph if within is None else graph.subgraph(within)
    members = least_centres(searched, centre).where("down = up").select("v", F.lit(0).alias("label"))
    return canonical(members)


def _split(rest: Graph, ranks: DataFrame, clock: Clock, tau: int) -> tuple[list[DataFrame], Graph]:
    """Labellings (v, scc) that ranks (v, down, up) settle, and what they leave.

    A vertex with the same number both ways is in the component of that centre. Two vertices with different pairs of numbers
    are in different components, so edges between them go, and vertices with one pair are a part by themselves. Parts of
    fewer than `tau` vertices are solved each in one task, all of them at once; others are left.
    """
    pairs = ranks.select("v", F.coalesce("down", F.lit(-1)).alias("down"), F.coalesce("up", F.lit(-2)).alias("up"))
    named, seen, _ = clock.run("labeling", lambda: stash_observed(pairs, "labels", {"left": F.count_if(F.col("down") != F.col("up"))}))
    found, left = [canonical(named.where("down = up").select("v", F.col("down").alias("label")))], named.where("down <> up")
    if not seen["left"]:
        return found, Graph(left.select("v"), rest.edges.limit(0))
    source, target = (left.select(F.col("v").alias(end), F.col("down").alias(f"down_{end}"), F.col("up").alias(f"up_{end}")) for end in ("src", "dst"))
    if seen["left"] <= FEW:  # then the edges, which may be very many, stay where they are
        source, target = F.broadcast(source), F.broadcast(target)
    # Differences are no keys: a table of one number as its key takes a megabyte in each task, one of several at least 64.
    # Only edges within a part can lie in a component; a vertex without one is a component of its own.
    same = rest.edges.join(source, "src").join(target, "dst").where("down_src - down_dst = 0 AND up_src - up_dst = 0").select("src", "dst", F.col("down_src").alias("down"), F.col("up_src").alias("up"))
    same, seen, _ = clock.run("labeling", lambda: stash_observed(same, "edges", {"edges": F.count(F.lit(1))}))
    if not seen["edges"]:
        return [*found, left.select("v", F.col("v").alias("scc"))], Graph(left.select("v").limit(0), rest.edges.limit(0))
    ends = stash(same.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), "ends")
    found.append(left.join(ends, "v", "left_anti").select("v", F.col("v").alias("scc")))
    if not tau:
        return found, Graph(ends, same.select("src", "dst"))
    part = ["down", "up"]
    sizes = stash(left.groupBy(*part).agg(F.count("*").alias("n")).where(F.col("n") < tau).select(*part), "parts")
    small = clock.run("others", lambda: stash(local.components_of_parts(same.join(sizes, part, "left_semi"), part), "solved"))
    found.append(small)
    large, seen, _ = stash_observed(same.join(sizes, part, "left_anti").select("src", "dst"), "edges", {"edges": F.count(F.lit(1))})
    rest = ends.join(small, "v", "left_anti") if seen["edges"] else ends.limit(0)
    return found, Graph(stash(rest, "vertices"), large)


def _together(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("v", "scc") for f in found])


def _in_batches(graph: Graph, clock: Clock, beta: float, tau: int, blocks: Blocks | None = None) -> DataFrame:
    """(v, scc) of all vertices by batches of centres. blocks: those of the graph, where they are there.

    In a batch each vertex takes the least centre that reaches it and the least that it reaches, two numbers however many
    centres there are. Centres that a batch does not find stay centres of the batches to come.
    """
    rest = graph
    order = stash(permuted(rest.vertices), "order")
    found, n = [], rest.vertices.count()
    sizes = [high for _, high in batches(n, beta) if high >= min(n, FIRST)]
    while n and not rest.edges.isEmpty():
        high = sizes.pop(0) if sizes else n
        centres = order.where(F.col("pos") < high).join(rest.vertices, "v", "left_semi").select("v", F.col("pos").alias("rank"))
        if sizes and centres.isEmpty():
            continue
        ranks = clock.run("reachability", lambda: _ranks(rest, blocks, centres))  # noqa: B023
        new, rest = _split(rest, ranks, clock, tau)
        found, blocks = found + new, None
    if blocks is not None:
        blocks.close()
    return _together([*found, rest.vertices.select("v", F.col("v").alias("scc"))])


def bgss(graph: Graph, clock: Clock | None = None, beta: float = GROWTH, tau: int = TAU) -> DataFrame:
    """tau: parts of fewer vertices are solved in one task each, after the giant step and after each batch; 0 for none."""
    clock = clock or Clock()
    simple = Graph(graph.vertices, stash(graph.simple().edges, "edges"))
    rest, gone, blocks = _peel(simple, clock)
    centre = stash(pivot(graph, rest.vertices).select("v", F.lit(0).cast("long").alias("rank")), "pivot")
    ranks = clock.run("big_scc", lambda: _ranks(rest, blocks, centre))
    found, rest = _split(rest, ranks, clock, tau)
    return _together([gone, *found, _in_batches(rest, clock, beta, tau)])


def multi(graph: Graph, clock: Clock | None = None, beta: float = GROWTH, tau: int = TAU) -> DataFrame:
    clock = clock or Clock()
    rest, gone, blocks = _peel(Graph(graph.vertices, stash(graph.simple().edges, "edges")), clock)
    return _together([gone, _in_batches(rest, clock, beta, tau, blocks)])


def _beside(graph: Graph, one: int, clock: Clock, local_edges: int, tau: int) -> DataFrame | None:
    """(v, scc), written, of all vertices that are not in the component of `one`, a vertex of very many edges; None without blocks.

    Its edges are in no block: what it has edges to and from is where the searches begin, among the others.
    """
    others = Graph(graph.vertices.where(F.col("v") != one), stash(graph.edges.where((F.col("src") != one) & (F.col("dst") != one)), "edges"))
    blocks = clock.run("big_scc", lambda: Blocks.of(others))
    if blocks is None:
        return None
    starts = [graph.edges.where(F.col(end) == one).select(node.alias("node")) for end, node in (("src", 2 * F.col("dst")), ("dst", 2 * F.col("src") + 1))]
    first = blocks.messages(starts[0].unionByName(starts[1]).distinct().withColumn("value", F.lit(0).cast("long")))

    def missed(view: View, data: np.ndarray) -> dict:
        return {"v": view.nodes[::2][(data[: len(view.nodes)].reshape(-1, 2) != 0).any(axis=1)] >> 1}

    left = clock.run("big_scc", lambda: blocks.finish(blocks.run(least_step(0), first), missed, "v long", "left"))
    within = others.subgraph(left)
    return stash(colouring(Graph(left, stash(within.edges, "edges")), clock, local_edges, tau), "labels")


def _by_core(graph: Graph, mean: float, clock: Clock, local_edges: int, tau: int) -> DataFrame | None:
    """(v, scc) of a dense graph by way of contracted(); None where that finds too little."""
    found = clock.run("big_scc", lambda: contracted(graph, mean))
    if found is None:
        return None
    rest, one = found
    others = _beside(rest, one, clock, local_edges, tau) if rest.edges.count() > local_edges else None
    if others is None:
        labels = stash(colouring(rest, clock, local_edges, tau), "labels")
        others = labels.where(F.col("scc") != labels.where(F.col("v") == one).first()["scc"])
    return _all_but(graph, others)


def _all_but(graph: Graph, others: DataFrame) -> DataFrame:
    """(v, scc) of all vertices, where those not in `others` (v, scc) are one component."""
    others = F.broadcast(others) if others.count() <= FEW else others
    least = graph.vertices.join(others, "v", "left_anti").agg(F.min("v").alias("v")).first()["v"]
    return graph.vertices.join(others, "v", "left").select("v", F.coalesce("scc", F.lit(least)).alias("scc"))


def _by_bulk(graph: Graph, n: int, clock: Clock, local_edges: int, tau: int) -> DataFrame | None:
    """(v, scc) of a dense graph of very many edges by way of without_bulk(); None where that finds no component of the most."""
    left = clock.run("big_scc", lambda: without_bulk(graph, n))
    return None if left is None else _all_but(graph, stash(colouring(left, clock, local_edges, tau), "labels"))


def within_ranges(graph: Graph) -> Graph:
    """The graph without edges between ranges of ids that no cycle of ranges goes through: these lie in no cycle of vertices.

    Where ids follow the edges, as in a grid, hardly any edge between ranges is left, and blocks have no one to wait for.
    """
    bits = max(0, (graph.vertices.agg(F.max("v").alias("v")).first()["v"] or 0).bit_length() - RANGE_BITS)
    src, dst = (F.shiftright(end, bits).alias(end) for end in ("src", "dst"))
    pairs = stash(graph.edges.select(src, dst).where("src <> dst").distinct(), "ranges")  # 2**(2 * RANGE_BITS) at most
    found = local.components(pairs).where("v <> scc").select("v", "scc")  # 2**RANGE_BITS at most
    other = stash(found, "cycles")
    of = {end: F.broadcast(other.select(F.col("v").alias(f"range_{end}"), F.col("scc").alias(f"scc_{end}"))) for end in ("src", "dst")}
    edges = graph.edges.select("src", "dst", src.alias("range_src"), dst.alias("range_dst")).join(of["src"], "range_src", "left").join(of["dst"], "range_dst", "left")
    return Graph(graph.vertices, edges.where(F.coalesce("scc_src", "range_src") == F.coalesce("scc_dst", "range_dst")).select("src", "dst"))


def colouring(graph: Graph, clock: Clock | None = None, local_edges: int = 0, tau: int = TAU) -> DataFrame:
    """local_edges: with no more edges than this, the rest goes to one task."""
    clock = clock or Clock()
    m, n = graph.edges.count(), graph.vertices.count()
    if local_edges and m <= local_edges:  # one task needs no distinct edges
        return clock.run("others", lambda: tarjan(graph))
    if m >= max(BULK_EDGES, DENSE * n) and (labels := _by_bulk(graph, n, clock, local_edges, tau)) is not None:
        return labels
    if m >= max(GIANT_EDGES, DENSE * n) and (labels := _by_core(graph, m / n, clock, local_edges, tau)) is not None:
        return labels
    within = clock.run("trimming", lambda: within_ranges(graph)) if m >= GIANT_EDGES else graph
    rest, found = Graph(graph.vertices, stash(within.simple().edges, "edges")), []
    giant = True
    while True:
        edges = rest.edges.count()
        if not edges:
            return _together([*found, rest.vertices.select("v", F.col("v").alias("scc"))])
        if edges <= local_edges:
            return _together([*found, clock.run("others", lambda: one_task(rest))])  # noqa: B023
        rest, gone, blocks = _peel(rest, clock)
        found.append(gone)
        if rest.vertices.isEmpty():
            if blocks is not None:
                blocks.close()
            return _together(found)
        centre = None
        if giant and edges >= GIANT_EDGES:
            # One label moves far less than one a vertex, and takes off the bulk of most large graphs.
            centre = stash(pivot(rest, rest.vertices).select("v", F.lit(0).cast("long").alias("rank")), "pivot")
        giant = False
        ranks = clock.run("big_scc" if centre is not None else "reachability", lambda: _ranks(rest, blocks, centre))  # noqa: B023
        new, rest = _split(rest, ranks, clock, tau)
        found += new


def hybrid(graph: Graph, clock: Clock | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    return colouring(graph, clock, local_edges)


def vgc(graph: Graph, clock: Clock | None = None, tau: int = TAU) -> DataFrame:
    """Below tau vertices one task; else bgss, in which every part that falls below tau is solved in one."""
    small = graph.vertices.count() < tau and graph.edges.count() <= LOCAL_EDGES
    return tarjan(graph, clock) if small else bgss(graph, clock, tau=tau)


METHODS: dict[str, Callable] = {"tarjan": tarjan, "bgss": bgss, "multi": multi, "colouring": colouring, "vgc": vgc, "hybrid": hybrid}


def scc(graph: Graph, method: str = "hybrid", clock: Clock | None = None, **options) -> DataFrame:
    """(v, scc) of every vertex; scc is the smallest vertex of v's component."""
    return dealt(METHODS[method](graph, clock, **options))
