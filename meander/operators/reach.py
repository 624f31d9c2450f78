"""Reachability: searches over blocks of adjacency, of which only borders are exchanged.

Graphs with a vertex of more edges than a block may have take fixpoint(), whose step is one join of the whole state with the
edges and one aggregation by their other ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import forget, stash, stash_observed
from .blocks import NONE, Blocks, View, bits_step, least_step
from .order import positions

#: Steps that one job takes before the state is written. The edges are shuffled once a job.
STEPS_A_TABLE = 4


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], value: str, name: str, most_steps: int | None = None) -> DataFrame:
    """The state after steps that change it no more, or after `most_steps`.

    A step may only add rows or lower `value`, so a state with as many rows and the same sum as before is the same. Every
    few steps the state is written in place of the one before, which is deleted: the lineage is that of a few steps, and
    the disk holds two states at a time.
    """
    found = {"rows": F.count(F.lit(1)), "sum": F.sum(F.col(value).cast("decimal(38,0)"))}
    state, seen, path = stash_observed(state, name, found)
    done = 0
    while most_steps is None or done < most_steps:
        steps = STEPS_A_TABLE if most_steps is None else min(STEPS_A_TABLE, most_steps - done)
        after = state
        for _ in range(steps):
            after = step(after)
        after, now, new_path = stash_observed(after, name, found)
        forget(state.sparkSession, path)
        state, path, done = after, new_path, done + steps
        if now == seen:
            break
        seen = now
    return state


def looped(vertices: DataFrame, edges: DataFrame, cost: int = 1) -> DataFrame:
    """(src, dst, cost), written: the edges, and every vertex to itself for nothing, so that a step keeps what it has."""
    own = vertices.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("long").alias("cost"))
    return stash(edges.select("src", "dst", F.lit(cost).cast("long").alias("cost")).unionByName(own), "looped")


def least(edges: DataFrame, start: DataFrame, value: str, most_steps: int | None = None) -> DataFrame:
    """(v, value): the least of value and costs over all paths from the rows of `start` (v, value). edges: looped() ones."""

    def step(state: DataFrame) -> DataFrame:
        return state.join(edges, state["v"] == edges["src"]).groupBy(F.col("dst").alias("v")).agg(F.min(F.col(value) + F.col("cost")).alias(value))

    return fixpoint(start, step, value, value, most_steps)


def _least_of(view: View, data: np.ndarray) -> np.ndarray:
    """Values by vertex: along the edges, against them."""
    return data[: len(view.nodes)].reshape(-1, 2)


def _known(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NONE)


def bfs(graph: Graph, sources: DataFrame, allowed: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame:
    """(v, depth) of every vertex that a source (v) reaches, sources themselves at depth 0.

    allowed: the vertices to go through; sources outside are no sources. most_rounds: the largest depth. A superstep goes as
    far as a block allows and sends on the vertices at its border whose depth has become less, so over a search no more is
    shuffled than such vertices; edges and depths stay where they are.
    """
    within = graph if allowed is None else graph.subgraph(allowed)
    start = sources.select("v").distinct()
    start = start if allowed is None else start.join(allowed.select("v"), "v", "left_semi")
    ends = within.vertices.select("v").unionByName(start).distinct()  # a source may be no vertex
    blocks = Blocks.of(Graph(ends, within.edges))
    if blocks is None:
        return least(looped(ends, within.edges), start.select("v", F.lit(0).cast("long").alias("depth")), "depth", most_rounds)

    def found(view: View, data: np.ndarray) -> dict:
        depth = _least_of(view, data)[:, 0]
        some = np.flatnonzero(depth < NONE)
        return {"v": view.nodes[2 * some] >> 1, "depth": depth[some]}

    first = blocks.messages(start.select((2 * F.col("v")).alias("node"), F.lit(0).alias("value")))
    state = blocks.run(least_step(1, most=NONE if most_rounds is None else most_rounds), first)
    return blocks.finish(state, found, "v long, depth long", "depths")


#: Words of 64 centres that a search takes at a time.
WORDS = 16


def multi_reach(graph: Graph, centres: DataFrame, allowed: DataFrame | None = None, whole: int = 0) -> DataFrame:
    """(v, label), distinct: all pairs of a vertex and a centre (v) that reaches it.

    Centres are numbered and searched for 64 to a bit set, WORDS sets a vertex at a time; pairs arise only in what is given
    back. Where a block would be too large, pairs themselves are joined. whole: see Blocks.of; a task then holds 8 * WORDS bytes
    a vertex, a few times.
    """
    within = graph if allowed is None else graph.subgraph(allowed)
    start = centres.select("v").distinct()
    start = start if allowed is None else start.join(allowed.select("v"), "v", "left_semi")
    ends = within.vertices.select("v").unionByName(start).distinct()
    blocks = Blocks.of(Graph(ends, within.edges), whole)
    if blocks is None:
        return _multi_reach_joined(ends, within.edges, start)
    order = stash(positions(start, ["v"], "number"), "centres")
    number, parts = order.count(), []
    for low in range(0, number, 64 * WORDS):
        own = order.where((F.col("number") >= low) & (F.col("number") < low + 64 * WORDS))
        words = -(-min(number - low, 64 * WORDS) // 64)
        labels = np.array([r["v"] for r in own.orderBy("number").collect()], np.int64)  # 64 * WORDS at most
        bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST((number - {low}) % 64 AS INT))")
        word = F.floor((F.col("number") - low) / 64)
        first = blocks.messages(own.select((2 * F.col("v")).alias("node"), F.array(*[F.when(word == w, bit).otherwise(F.lit(0).cast("long")) for w in range(words)]).alias("value")), several=True)

        def found(view: View, data: np.ndarray, words=words, labels=labels) -> dict:
            bits = data.reshape(-1, words)[: len(view.nodes) : 2]
            there = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")
            at, which = np.nonzero(there)
            return {"v": view.nodes[2 * at] >> 1, "label": labels[which]}

        parts.append(blocks.rows_of(blocks.run(bits_step(words), first), found, "v long, label long", "pairs"))
    blocks.close()
    none = start.select("v", F.col("v").alias("label")).limit(0)
    return reduce(DataFrame.unionByName, parts) if parts else none


def _multi_reach_joined(ends: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """The same by joins of pairs with edges, for graphs with a vertex of very many edges."""
    edges = looped(ends, edges)

    def step(state: DataFrame) -> DataFrame:
        return state.join(edges, state["v"] == edges["src"]).select(F.col("dst").alias("v"), "label").distinct()

    return fixpoint(start.select("v", F.col("v").alias("label")), step, "label", "pairs")


#: Rows from which the larger side of both_ways() is filtered, and bits of the filter (a megabyte), by its power of two.
FILTER_ROWS, FILTER_BITS = 1_000_000, 23
#: Bits of one bitmap of Spark's.
BITMAP = 32_768


def both_ways(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(v, label) in both: v and the centre reach each other.

    The smaller side is looked up by the larger. Where that is large, a bit for each hash of the smaller side, of a fixed
    number of bits, is sent to all tasks first, so that of the larger side only rows that can match are shuffled.
    """
    few, many = (forward, backward) if (a := forward.count()) <= (b := backward.count()) else (backward, forward)
    if max(a, b) >= FILTER_ROWS:
        many = possible(many, few, ["v", "label"])
    return many.join(few, ["v", "label"], "left_semi")


def possible(many: DataFrame, few: DataFrame, columns: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Rows of `many` without most of those that have no equal in `few`. The filter has 2**bits bits, whatever the tables."""
    place = F.xxhash64(*columns).bitwiseAND((1 << bits) - 1)
    at = place.bitwiseAND(BITMAP - 1)
    made = few.select(F.shiftright(place, 15).alias("__map"), at.alias("__at")).groupBy("__map").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    rows = many.select("*", F.shiftright(place, 15).alias("__map"), at.alias("__at")).join(F.broadcast(made), "__map")  # 2**bits / 8 bytes
    byte = F.conv(F.hex(F.expr("substring(__bits, CAST(__at div 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    return rows.where(F.expr("shiftleft(1, CAST(__at % 8 AS INT))").bitwiseAND(byte) != 0).select(*many.columns)


def least_ancestor(graph: Graph) -> DataFrame:
    """(v, colour): the smallest vertex that reaches v, itself included."""
    return extremes(graph).select("v", F.col("down").alias("colour"))


def _both(blocks: Blocks, state: DataFrame, name: str) -> DataFrame:
    def found(view: View, data: np.ndarray) -> dict:
        values = _least_of(view, data)
        return {"v": view.nodes[::2] >> 1, "down": _known(values[:, 0]), "up": _known(values[:, 1])}

    return blocks.finish(state, found, "v long, down long, up long", name)


def extremes(graph: Graph) -> DataFrame:
    """(v, down, up): the smallest vertex that reaches v, and the smallest that v reaches; v itself counts."""
    blocks = Blocks.of(graph)
    return _both_joined(graph, graph.vertices.select("v", F.col("v").alias("rank"))) if blocks is None else extremes_in(blocks)


def extremes_in(blocks: Blocks) -> DataFrame:
    """extremes() over blocks that are there, which are deleted then."""
    return _both(blocks, blocks.run(least_step(0, own=True), None), "extremes")


def least_centres(graph: Graph, centres: DataFrame) -> DataFrame:
    """(v, down, up) of every vertex: the least rank of the centres (v, rank) that reach v, and of those that v reaches; null for none.

    Both searches are one, with two numbers a vertex, however many centres there are.
    """
    blocks = Blocks.of(graph)
    return _both_joined(graph, centres) if blocks is None else ranks_in(blocks, centres)


def ranks_in(blocks: Blocks, centres: DataFrame) -> DataFrame:
    """least_centres() over blocks that are there, which are deleted then."""
    first = centres.select(F.explode(F.array(2 * F.col("v"), 2 * F.col("v") + 1)).alias("node"), F.col("rank").alias("value"))
    return _both(blocks, blocks.run(least_step(0), blocks.messages(first)), "ranks")


def _both_joined(graph: Graph, centres: DataFrame) -> DataFrame:
    """least_centres() by joins of the whole state with the edges, for graphs with a vertex of very many edges."""
    both = graph.edges.select("src", "dst", F.lit(0).alias("way")).unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way")))
    ways = F.explode(F.array(F.lit(0), F.lit(1))).alias("way")
    edges = stash(both.unionByName(graph.vertices.select(F.col("v").alias("src"), F.col("v").alias("dst"), ways)), "both-ways")

    def step(state: DataFrame) -> DataFrame:
        joined = state.withColumnRenamed("v", "src").join(edges, ["src", "way"])
        return joined.groupBy(F.col("dst").alias("v"), "way").agg(F.min("rank").alias("rank"))

    found = fixpoint(centres.select("v", "rank", ways), step, "rank", "ranks")
    of = lambda way: F.min(F.when(F.col("way") == way, F.col("rank")))
    return graph.vertices.join(found.groupBy("v").agg(of(0).alias("down"), of(1).alias("up")), "v", "left")
